"""The k-nearest join against all pairs: sides apart, clusters, outliers, copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import graph, spatial

DIMS = ["x", "y"]


def brute(q, p, k, skip):
    out = set()
    for i, a in q:
        near = sorted((float(np.sqrt(sum((s - t) * (s - t) for s, t in zip(a, b, strict=True)))), j) for j, b in p if not (skip and i == j))
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(near[:k])}
    return out


def rows(points, first=0):
    return [(first + i, tuple(map(float, x))) for i, x in enumerate(points)]


def frame(spark, points):
    return spark.createDataFrame([(i, *x) for i, x in points], "id long, x double, y double")


CASES = {
    "apart": lambda d: (d.normal(0, 1, (300, 2)), d.normal(1e6, 1, (300, 2))),
    "clusters": lambda d: (np.concatenate([d.normal(c, 0.01, (100, 2)) for c in (0, 50, 9e4)]),) * 2,
    "outlier": lambda d: (np.concatenate([d.normal(0, 1, (300, 2)), [[1e9, -1e9]]]),) * 2,
    "copies": lambda d: (np.concatenate([np.zeros((200, 2)), d.integers(0, 5, (100, 2)), [[1e5, 0]]]),) * 2,
    "line": lambda d: (np.stack([2.0 ** -np.arange(60), np.zeros(60)], axis=1),) * 2,
}


@pytest.mark.parametrize("case", CASES)
def test_equals_all_pairs(spark, case):
    q, p = CASES[case](np.random.default_rng(5))
    same = q is p
    q, p = rows(q), rows(p)
    got = spatial.knn_join(frame(spark, q), frame(spark, p), 3, DIMS, "id", "id", exclude_self=same)
    assert {(r["query_id"], r["neighbour_id"], r["rank"]) for r in got.collect()} == brute(q, p, 3, same)


def test_tree_alone_with_groups_and_few_points(spark):
    d = np.random.default_rng(2)
    points = [(i, f"g{i % 3}", float(x), float(y)) for i, (x, y) in enumerate(d.normal(0, 9, (400, 2)))] + [(900, "lone", 1.0, 1.0), (901, "lone", 2.0, 1.0)]
    df = spark.createDataFrame(points, "id long, g string, x double, y double")
    q, p = spatial._sides(df, df, DIMS, "id", "id", ["g"])
    got = {}
    for r in spatial.tree_search(q, p, 4, DIMS, ["g"], True).collect():
        got.setdefault(r["g"], set()).add((r["query_id"], r["neighbour_id"], r["rank"]))
    for g in ("g0", "g1", "g2", "lone"):
        own = [(i, (x, y)) for i, h, x, y in points if h == g]
        assert got[g] == brute(own, own, 4, True)


def test_few_pairs_are_measured(spark, monkeypatch):
    """Pairs whose distance is computed, of 3,000 x 3,000, in the cases that cells alone are bad at."""
    counted = []
    plain = spatial._first
    monkeypatch.setattr(spatial, "_first", lambda pairs, by, k: (counted.append(pairs.count()), plain(pairs, by, k))[1])
    d = np.random.default_rng(3)
    cases = {
        "apart": (d.normal(0, 1, (3000, 2)), d.normal(1e4, 1, (3000, 2))),
        "clusters": (np.concatenate([d.normal(c, 0.01, (1000, 2)) for c in (0, 50, 9e4)]),) * 2,
        "outlier": (np.concatenate([d.normal(0, 1, (2999, 2)), [[1e9, -1e9]]]),) * 2,
        "copies": (np.concatenate([np.zeros((2500, 2)), d.normal(0, 1, (500, 2))]),) * 2,
    }
    for name, (q, p) in cases.items():
        counted.clear()
        assert spatial.knn_join(frame(spark, rows(q)), frame(spark, rows(p)), 6, DIMS, "id", "id", exclude_self=q is p).count() == 3000 * 6
        assert sum(counted) < 100 * 6 * 3000, name


def test_data_sized_sides_are_not_sent_through_the_driver(spark):
    p = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 89).cast("double").alias("y"))
    pairs = spatial.range_join(p, p, 1.5, ["x", "y"], "k", "k", exclude_self=True)
    near = spatial.knn_join(p, p, 3, ["x", "y"], "k", "k", exclude_self=True)
    for df in (pairs, near, graph.radius_clusters(pairs, p, "k")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert pairs.count() and near.count() == 6000
