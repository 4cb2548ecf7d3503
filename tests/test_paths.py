"""Nearest visible nodes against Dijkstra, direction predictors against refits."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import graph, predict


def dijkstra(edges, start):
    around = {}
    for a, b, w in edges:
        around.setdefault(a, []).append((b, w))
        around.setdefault(b, []).append((a, w))
    best, heap = {}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for m, w in around.get(n, []):
                heapq.heappush(heap, (d + w, m))
    return best


def test_nearest_visible_equals_dijkstra(spark):
    rnd = random.Random(3)
    edges = [(i, rnd.randrange(60), float(rnd.randrange(1, 9))) for i in range(60) for _ in range(2)]  # whole lengths: many ties
    edges += [(7, i, 3.0) for i in range(60)] + [(100, 101, 1.0)] + edges[:5]  # a hub, a part without visible nodes, repeats
    visible = [i for i in range(60) if i % 3]
    e = spark.createDataFrame([*edges, (None, 3, 1.0), (1, 2, None)], "a long, b long, length double")
    got = {}
    hidden = spark.createDataFrame([(i,) for i in (0, 3, 6, 9, 100, 0)], "node long")
    for r in graph.nearest_visible(e, spark.createDataFrame([(i,) for i in visible], "node long"), "length", 4, hidden).collect():
        got.setdefault(r["node"], []).append((r["distance"], r["source"], r["rank"]))
    paths = {s: dijkstra(edges, s) for s in visible}
    for node in (0, 3, 6, 9):
        want = sorted((d[node], s) for s, d in paths.items() if node in d)[:4]
        assert sorted(got.pop(node)) == [(*w, i + 1) for i, w in enumerate(want)]
    assert not got


def test_nearest_visible_odd_input(spark):
    none = spark.createDataFrame([], "a long, b long, length double")
    one = spark.createDataFrame([(1,), (None,)], "node long")
    assert [tuple(r) for r in graph.nearest_visible(none, one, "length", 2).collect()] == [(1, 1, 0.0, 1)]
    line = spark.createDataFrame([(1, 2, 0.0), (2, 3, -1.0)], "a long, b long, length double")
    with pytest.raises(Exception, match="below zero"):
        graph.nearest_visible(line, one, "length", 2).collect()


def test_direction_predictors_equal_refits(spark):
    rnd = np.random.default_rng(5)
    n = 80
    normal = rnd.normal(size=(n, 3))
    normal /= np.linalg.norm(normal, axis=1)[:, None]
    axis = normal @ np.array([[0.0, 1, 0], [-1, 0, 0], [0, 0, 1]]) + 0.1 * rnd.normal(size=(n, 3))
    axis /= np.linalg.norm(axis, axis=1)[:, None]
    x, block = rnd.normal(size=(n, 2)), np.arange(n) % 4
    rows = [(i, int(block[i]), *map(float, (*x[i], *normal[i], *axis[i]))) for i in range(n)]
    df = spark.createDataFrame([*rows, (n, 0, 0.0, 0.0, None, 0.0, 1.0, 0.0, 0.0, 1.0)], "id long, block long, u double, v double, nx double, ny double, nz double, ax double, ay double, az double")
    out = predict.direction_predictors(df, "block", [F.col("u"), F.col("v")], ["nx", "ny", "nz"], ["ax", "ay", "az"])
    got = {(r["id"], r["method"]): r["angle"] for r in predict.direction_angles(out, "id", "block", ["ax", "ay", "az"]).collect()}
    assert len(got) == 4 * (n + 1) and all(got[n, m] is None for m in ("surface_normal", "surface_plus_tilt", "surface_global_rotation"))

    def ridge(k, y):
        mx, my = x[k].mean(0), y[k].mean(0)
        z = x[k] - mx
        return my + (x - mx) @ np.linalg.solve(z.T @ z + 0.001 * k.sum() * np.eye(2), z.T @ (y[k] - my))

    for b in range(4):
        k = block != b
        u, _, vt = np.linalg.svd(normal[k].T @ axis[k])
        turn = u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt
        ways = dict(zip(predict.DIRECTIONS, (normal, ridge(k, axis), normal + ridge(k, axis - normal), normal @ turn), strict=True))
        for m, p in ways.items():
            p = p / np.linalg.norm(p, axis=1)[:, None]
            for i in np.flatnonzero(~k):
                assert abs(got[i, m] - np.degrees(np.arccos(np.clip(p[i] @ axis[i], -1, 1)))) < 1e-5
    assert np.mean([got[i, "surface_global_rotation"] for i in range(n)]) < 12 < np.mean([got[i, "surface_normal"] for i in range(n)])


def test_harmonic_of_nodes_at_one_place(spark):
    """Infinite weights: the limit of ever larger ones, by hand and against large finite ones."""
    inf = float("inf")
    edges = [(1, 2, 1.0), (2, 3, inf), (3, 4, 3.0), (4, 5, inf), (5, 6, inf), (1, 7, inf), (4, 7, inf), (7, 8, 1.0), (8, 5, 1.0), (20, 21, inf), (1, 4, inf), (2, 6, 0.5)]
    known = spark.createDataFrame([(1, 0.0), (4, 10.0)], "node long, value double")
    got = {r["node"]: r["value"] for r in graph.harmonic(spark.createDataFrame(edges, "a long, b long, w double"), known, F.col("w")).collect()}
    both = (3 * 10 + 0.5 * 10) / 4.5
    assert got.keys() == {2, 3, 5, 6, 7, 8, 20, 21}
    assert all(abs(got[n] - x) < 1e-7 for n, x in {2: both, 3: both, 5: 10, 6: 10, 7: 5, 8: 7.5, 20: 0, 21: 0}.items())
    rnd = random.Random(3)
    edges = {tuple(sorted(rnd.sample(range(30), 2))): rnd.choice([inf, 1.0, 2.0, 0.3]) for _ in range(45)}
    values = {n: float(n * n % 17) for n in range(0, 30, 6)}
    left = np.zeros((30, 30))
    for (a, b), w in edges.items():
        w = min(w, 1e8)
        left[[a, b], [a, b]] += w
        left[[a, b], [b, a]] -= w
    known = spark.createDataFrame(list(values.items()), "node long, value double")
    got = {r["node"]: r["value"] for r in graph.harmonic(spark.createDataFrame([(*e, w) for e, w in edges.items()], "a long, b long, w double"), known, F.col("w")).collect()}
    free = sorted(got)
    assert free == [n for n in range(30) if n not in values and left[n, n]]
    wanted = np.linalg.lstsq(left[np.ix_(free, free)], -left[np.ix_(free, list(values))] @ np.array(list(values.values())), rcond=None)[0]
    assert np.abs(wanted - [got[n] for n in free]).max() < 1e-5
