"""Operators that SQL can't check, against brute force or hand-computed values, and bounds that are kept."""

import hashlib
import os
import random
from fractions import Fraction
from itertools import combinations, permutations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions import geometry as geo
from holdfast.operators import aggregates, graph, holdout, holes, joins, learners, matching, moments, predict, ranks, spatial, stats, surfaces
from holdfast.plans import QUERIES
from holdfast.sources import tables

SF = "/root/testdata/sf0.001"


def test_file_fingerprints(spark):
    got = {r["path"]: (r["bytes"], r["sha256"]) for r in QUERIES["A07_file_fingerprint"](spark, SF).collect()}
    for name, want in got.items():
        with open(os.path.join(SF, name), "rb") as f:
            raw = f.read()
        assert want == (len(raw), hashlib.sha256(raw).hexdigest())
    assert len(got) == len([n for n in os.listdir(SF) if n.endswith(".parquet")])


def test_surfaces_keep_every_cell(spark):
    rows = [(u, c, float(10 * u + c)) for u in (1, 2) for c in (3, 1, 2)]
    got = tables.surfaces(spark.createDataFrame(rows, "u int, c int, value double").repartition(3), ["u"], ["c"], "value").collect()
    assert len(got) == 2
    for r in got:
        arrays = [x for x in r.asDict(recursive=True).values() if isinstance(x, list)]
        text = str(arrays)
        assert all(str(float(10 * r["u"] + c)) in text for c in (1, 2, 3)) and text.index(str(10.0 * r["u"] + 1)) < text.index(str(10.0 * r["u"] + 3))


@pytest.mark.parametrize("shape", ["outlier", "cluster", "copies"])
def test_cells_stay_small_where_points_crowd(spark, shape):
    rnd = random.Random(3)
    rows = [(i, rnd.random(), rnd.random()) for i in range(1500)]
    if shape == "outlier":
        rows.append((9999, 1e7, -1e7))
    if shape == "cluster":
        rows += [(5000 + i, 0.5 + 1e-5 * rnd.random(), 0.5 + 1e-5 * rnd.random()) for i in range(1500)]
    if shape == "copies":
        rows += [(5000 + i, 0.25, 0.25) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    p = df.select(F.col("x").alias("p_x"), F.col("y").alias("p_y"))
    width = spatial.cell_width(p, [], ["p_x", "p_y"], 4, 1e7 if shape == "outlier" else 0.2)
    places = p.distinct()
    assert spatial.crowding(places, [], ["p_x", "p_y"], width) <= spatial.CROWD * 4
    got = {}
    for r in spatial.knn_join(df, df, 3, ["x", "y"], "id", "id", exclude_self=True).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"]))
    at = np.array([r[1:] for r in rows])
    for n in (0, 700, len(rows) - 1):
        d = np.sort(np.sqrt(((at - at[n]) ** 2).sum(1)))[1:4]
        assert np.allclose([x for _, x in sorted(got[rows[n][0]])], d, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("most", [5_000_000, 2_000])
def test_best_triples_equal_brute_force(spark, most):
    rnd = np.random.default_rng(11)
    sets = {1: rnd.normal(size=(40, 2)), 2: rnd.random((60, 2)), 3: rnd.random((3, 2)), 4: np.repeat(rnd.random((5, 2)), 6, axis=0), 5: rnd.random((2, 2)), 6: np.zeros((7, 2))}
    rows = [(g, i, *map(float, p)) for g, s in sets.items() for i, p in enumerate(s)]
    if most < 5000:
        rows = [r for r in rows if r[0] != 6]
    got = {r["g"]: (r["a"], r["b"], r["c"], r["score"]) for r in joins.best_triples(spark.createDataFrame(rows, "g int, id long, x double, y double"), ["g"], "id", ["x", "y"], most=most).collect()}
    for g, s in sets.items():
        if len(s) < 3 or g not in {r[0] for r in rows}:
            assert g not in got
            continue
        d = np.sqrt(((s[:, None] - s[None]) ** 2).sum(-1))
        away = np.sqrt(((s - s.mean(0)) ** 2).sum(-1))
        best = max((round(min(d[a, b], d[b, c], d[a, c]) - 0.05 * (away[a] + away[b] + away[c]) / 3, 10), -a, -b, -c) for a, b, c in combinations(range(len(s)), 3))
        assert got[g][:3] == tuple(-x for x in best[1:]) and abs(got[g][3] - best[0]) < 1e-9


def test_matching_then_gate(spark):
    rnd = np.random.default_rng(3)
    rows = [(g, s, i, float(a), float(b)) for g in range(6) for s, n in ((0, 4), (1, 3 + g % 3)) for i, (a, b) in enumerate(rnd.random((n, 2)))]
    df = spark.createDataFrame([*rows, (77, 0, 1, 0.0, 0.0)], "g int, s int, id long, x double, y double")
    sides = df.where("s = 0"), df.where("s = 1")
    got = {(r["g"], r["a"], r["b"]) for r in matching.match_then_gate(*sides, ["g"], "id", ["x", "y"], 0.4).collect()}
    want = set()
    for g in range(6):
        a, b = ([r[3:] for r in rows if r[0] == g and r[1] == s] for s in (0, 1))
        cost = np.sqrt(((np.array(a)[:, None] - np.array(b)[None]) ** 2).sum(-1))
        flip = len(a) > len(b)
        c = cost.T if flip else cost
        best = min(permutations(range(c.shape[1]), c.shape[0]), key=lambda p: sum(c[i, j] for i, j in enumerate(p)))
        want |= {(g, *((j, i) if flip else (i, j))) for i, j in enumerate(best) if c[i, j] <= 0.4}
    assert got == want
    with pytest.raises(Exception, match="points"):
        matching.match_then_gate(*sides, ["g"], "id", ["x", "y"], 0.4, most=5).collect()
    pairs = spark.createDataFrame([(i, j, 1.0) for i in range(4) for j in range(4)], "query_id long, neighbour_id long, distance double")
    got = matching.one_to_one(pairs, most=15).collect()
    assert len(got) == len({r["query_id"] for r in got}) == len({r["neighbour_id"] for r in got}) == 4


@pytest.mark.parametrize(("size", "per_task"), [((40, 30), 100_000), ((14, 9), 15)])
def test_auction_is_as_good_as_the_exact_solver(spark, size, per_task):
    """Sparse pairs, some alone, as one part and as several: as many pairs, and the least total within the slack."""
    rnd = np.random.default_rng(7)
    rows = [(i, 100 + j, float(c)) for i in range(size[0]) for j, c in enumerate(rnd.random(size[1]) * 36 / size[1] ** 0.5) if c < 1.8] + [(50, 150, 3.0)]
    edges = spark.createDataFrame(rows, "hf_a long, hf_b long, cost double")
    got = [(r["hf_a"], r["hf_b"]) for r in matching.auction(edges, 30, 1e-3, per_task).collect()]
    cost = {r[:2]: r[2] for r in rows}
    a, b = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    table = np.array([[cost.get((i, j), 1e4) for i in a] for j in b])
    best = [(a[i], b[j]) for j, i in enumerate(matching.assignment(table)) if (a[i], b[j]) in cost]
    assert len(got) == len(best) == len({i for i, _ in got}) == len({j for _, j in got})
    assert abs(sum(cost[p] for p in got) - sum(cost[p] for p in best)) <= 1e-3 * 3


def test_matching_of_odd_pairs(spark):
    kinds = "query_id long, neighbour_id long, distance double"
    assert matching.one_to_one(spark.createDataFrame([], kinds)).collect() == []
    rows = [(1, 1, 5.0), (1, 1, 2.0), (1, 2, 2.5), (2, 1, -1.0), (None, 1, 0.0), (3, None, 0.0), (3, 3, None), (3, 3, float("nan"))]
    for most in (100, 0):
        got = {tuple(r) for r in matching.one_to_one(spark.createDataFrame(rows, kinds), most=most).collect()}
        assert got == {(1, 2, 2.5), (2, 1, -1.0)}


def test_shift_scores_equal_all_pairs(spark):
    """Every shift's score against all distances; copies, missing coordinates, and shifts that need the whole plane."""
    rnd = np.random.default_rng(11)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(rnd.random((25, 2)))]
    b = [(i, float(x) + 3 * (i == 0), float(y)) for i, (x, y) in enumerate(rnd.random((18, 2)))]
    a, b = [*a, (25, *a[3][1:]), (26, *a[3][1:])], [*b, (18, *b[5][1:])]
    kinds = "id long, x double, y double"
    frames = [spark.createDataFrame([*s, (99, None, 0.5), (98, float("nan"), 0.5)], kinds) for s in (a, b)]
    got = {(round(r["da"], 6), round(r["db"], 6)): (r["score"], r["pairs"]) for r in matching.best_shift(*frames, "id", ("x", "y"), 2, 0.3, 6).collect()}
    assert len(got) == 25
    for (da, db), (score, pairs) in got.items():
        d = [[float(np.hypot(p[1] - q[1] - da, p[2] - q[2] - db)) for q in b] for p in a]
        least = [min(range(len(b)), key=lambda j: (d[i][j], j)) for i in range(len(a))]
        back = [min(range(len(a)), key=lambda i: (d[i][j], i)) for j in range(len(b))]
        mutual = sorted(d[i][j] for i, j in enumerate(least) if back[j] == i)[:6]
        assert pairs == len(mutual) and abs(score - float(np.median(mutual))) < 1e-8
    assert matching.best_shift(frames[0], frames[1].where("id < 0"), "id", ("x", "y"), 1, 0.3, 6).collect() == []


def test_shift_scores_need_no_search_of_copies(spark, monkeypatch):
    """Shifts at whose sides' tails few points meet are settled by wider radii; of a place with very many copies one row counts, and no
    pairs of copies are formed."""
    rnd = np.random.default_rng(4)
    a, b = [[(i, *map(float, p)) for i, p in enumerate(rnd.normal(0, 0.3, (1500, 2)))] for _ in "ab"]
    kinds = "id long, x double, y double"
    more = [[*a, *[(i, 0.01, 0.02) for i in range(2000, 12000)]], [*b, *[(i, 0.01, 0.02) for i in range(2000, 12000)]]]
    monkeypatch.setattr(matching, "far_scores", None)
    got = {(r["da"], r["db"]): (r["score"], r["pairs"]) for r in matching.best_shift(*[spark.createDataFrame(s, kinds) for s in more], "id", ("x", "y"), 2, 0.55, 8).collect()}
    p, q = [np.array([r[1:] for r in s] + [(0.01, 0.02)]) for s in (a, b)]
    assert len(got) == 25
    for (da, db), (score, pairs) in got.items():
        d = np.hypot(p[:, None, 0] - q[None, :, 0] - da, p[:, None, 1] - q[None, :, 1] - db)
        least = d.argmin(1)
        mutual = sorted(d[i, j] for i, j in enumerate(least) if d[:, j].argmin() == i)[:8]
        assert pairs == 8 and abs(score - float(np.median(mutual))) < 1e-12


def test_triples_are_dealt_to_tasks(spark, monkeypatch):
    """Triples of cells are formed in as many tasks as a shuffle has, however small the tables of cells are."""
    from holdfast import storage

    rnd, parts, write = np.random.default_rng(6), [], storage.materialise

    def watched(df):
        if "upper" in df.columns:
            parts.append(df.rdd.getNumPartitions())
        return write(df)

    monkeypatch.setattr(storage, "materialise", watched)
    rows = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(rnd.random((60, 2)))]
    assert len(joins.best_triples(spark.createDataFrame(rows, "g int, id long, x double, y double"), ["g"], "id", ["x", "y"], most=20).collect()) == 1
    assert len(parts) > 1 and min(parts) >= int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_exact_tests_of_many_values(spark):
    rows = [(1, 1.0 if i < 640 else -1.0) for i in range(1200)] + [(2, 1.0), (2, -1.0), (2, 0.0)]
    got = {r["g"]: r for r in stats.sign_test(spark.createDataFrame(rows, "g int, d double"), ["g"], "d").collect()}
    want = sum(comb(1200, i) for i in range(561)) * 2 / 2**1200
    assert got[1]["n"] == 1200 and abs(got[1]["p"] - want) < 1e-9 and got[2]["p"] == 1

    def slow(a, b, c, d):
        r1, c1, n = a + b, a + c, a + b + c + d
        mass = {x: comb(r1, x) * comb(n - r1, c1 - x) for x in range(max(0, c1 - (c + d)), min(r1, c1) + 1)}
        return sum(m for m in mass.values() if m <= mass[a] * (1 + 1e-7)) / comb(n, c1)

    tables_ = [(1, 3, 1, 1, 3), (2, 120, 80, 90, 130), (3, 0, 5, 6, 0), (4, 7, 0, 0, 0)]
    got = {r["g"]: r["p"] for r in stats.fisher(spark.createDataFrame(tables_, "g int, a long, b long, c long, d long"), ["g"]).collect()}
    assert all(abs(got[g] - slow(*t)) < 1e-9 for g, *t in tables_)


def test_loops_that_do_not_settle_are_errors(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    known = spark.createDataFrame([(0, 0.0), (12, 1.0)], "node long, value double")
    with pytest.raises(RuntimeError, match="settle"):
        graph.harmonic(edges, known, F.lit(1.0), rounds=2)
    rows = spark.createDataFrame([(1, float(i * i)) for i in range(40)], "g int, v double")
    with pytest.raises(RuntimeError, match="settle"):
        moments.two_layers(rows, ["g"], "v", rounds=1)


def test_best_row_and_axes(spark):
    rows = [(g, m, float((7 * m + g) % 5)) for g in range(3) for m in range(6)]
    got = {r["g"]: (r["m"], r["e"]) for r in aggregates.best_row(spark.createDataFrame(rows, "g int, m int, e double"), ["g"], [F.col("e"), F.col("m")], ["m", "e"]).collect()}
    assert got == {g: min(((m, e) for h, m, e in rows if h == g), key=lambda x: (x[1], x[0])) for g in range(3)}
    rnd = np.random.default_rng(2)
    pts = [(g, *map(float, p)) for g in (1, 2) for p in rnd.normal(size=(50, 3)) * (3, 1, 0.2)]
    axes = moments.principal_axes(spark.createDataFrame(pts, "g int, x double, y double, z double"), ["g"], ["x", "y", "z"]).collect()
    for g in (1, 2):
        c = np.cov(np.array([p[1:] for p in pts if p[0] == g]).T, bias=True)
        values, vectors = np.linalg.eigh(c)
        for r in (r for r in axes if r["g"] == g):
            want = vectors[:, 2 - r["axis"]]
            assert np.allclose(r["direction"], want * np.sign(want[np.abs(want).argmax()])) and abs(r["share"] - values[2 - r["axis"]] / values.sum()) < 1e-9


def blocks(spark, n=300, seed=4):
    rnd = np.random.default_rng(seed)
    rows = [(i, i % 4, float(a), float(b), float(3 * a - b + 0.05 * e)) for i, (a, b, e) in enumerate(rnd.normal(size=(n, 3)))]
    return rows, spark.createDataFrame(rows, "id long, block int, a double, b double, y double")


def test_learners_never_see_their_block(spark):
    rows, df = blocks(spark)
    turned = df.withColumn("y", F.when(F.col("block") == 2, 99.0).otherwise(F.col("y")))
    one, two = ({r["id"]: r for r in learners.tree_regressors(x, "block", ["a", "b"], "y").collect()} for x in (df, turned))
    assert len(one) == len(rows) and {r["choice"] for r in one.values()} == {"ridge"}
    for i, block, *_ in rows:
        if block == 2:
            assert all(abs(one[i][c] - two[i][c]) < 1e-6 for c in ("p_ridge", "prediction"))
            assert all(abs(one[i][c] - two[i][c]) < 3 for c in ("p_forest", "p_boosted"))  # their samples follow the order of files; a leak of 99 shows
        assert abs(one[i]["disagreement"] - np.std([one[i][f"p_{n}"] for n in ("ridge", "forest", "boosted")])) < 1e-9
    labels = df.withColumn("label", (F.col("y") > 0).cast("double"))
    got = learners.count_classifier(labels, "block", ["a", "b"], "label").collect()
    assert len(got) == len(rows) and np.mean([r["label"] == r["prediction"] for r in got]) > 0.95
    wrong = labels.withColumn("label", F.when(F.col("block") == 1, 1 - F.col("label")).otherwise(F.col("label")))
    again = {r["id"]: r["prediction"] for r in learners.count_classifier(wrong, "block", ["a", "b"], "label").where("block = 1").collect()}
    assert all(again[r["id"]] == r["prediction"] for r in got if r["block"] == 1)


def test_no_blocks_are_fitted_twice(spark, monkeypatch):
    _, df = blocks(spark, 80)
    fitted = []

    class Noted(learners.LinearRegression):
        def fit(self, rows, params=None):
            fitted.append(tuple(sorted(r[0] for r in rows.select("block").distinct().collect())))
            return super().fit(rows, params)

    monkeypatch.setattr(learners, "regressors", lambda target, seed: {n: Noted(featuresCol="hf_features", labelCol=target, regParam=r) for n, r in (("ridge", 0.1), ("other", 9.0))})
    got = learners.tree_regressors(df, "block", ["a", "b"], "y").collect()
    assert len(got) == 80 and {r["choice"] for r in got} == {"ridge"} and all(r["prediction"] == r["p_ridge"] for r in got)
    assert len(fitted) == 20 and set(fitted) == {t for n in (2, 3) for t in combinations(range(4), n)}  # six pairs, four threes, two learners


def test_folds_are_bounded(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, block int")
    assert sorted(map(tuple, holdout.dealt(df, "block", "fold", False).select("id", "fold").where("fold is not null").collect())) == [(1, 6), (2, 5)]
    with pytest.raises(ValueError, match="folds"):
        holdout.leave_block_out(spark.range(3), "id") and holdout.dealt(spark.range(3), "id", "fold", True, most=2)


def test_kmeans_blocks(spark):
    rnd = random.Random(5)
    rows = [(i, 10.0 * (i % 3) + rnd.random(), rnd.random()) for i in range(90)]
    got = {r["id"]: r["block"] for r in learners.kmeans_blocks(spark.createDataFrame(rows, "id long, x double, y double"), "id", ["x", "y"], 3).collect()}
    assert len({(i % 3, b) for i, b in got.items()}) == 3 == len(set(got.values()))


def test_direction_ridge_and_path_cv(spark):
    rows, df = blocks(spark)
    out = predict.direction_ridge(df, "block", [F.col("a"), F.col("b")], ["a", "y"]).collect()
    data = np.array([r[2:] for r in rows])
    for r in out[:20]:
        k = np.array([x[1] != r["block"] for x in rows])
        x, y = data[k, :2], data[k][:, [0, 2]]
        z, t = x - x.mean(0), y - y.mean(0)
        p = y.mean(0) + (np.array([r["a"], r["b"]]) - x.mean(0)) @ np.linalg.solve(z.T @ z + 0.001 * k.sum() * np.eye(2), z.T @ t)
        assert np.allclose([r["p_a"], r["p_y"]], p / np.linalg.norm(p), atol=1e-8)
    rnd = np.random.default_rng(8)
    tracks = [(1, d, float(d * d + rnd.normal()), float(d)) for d in range(23)] + [(2, d, 0.0, 0.0) for d in range(5)]
    got = {(r["track"], r["degree"]): r["error"] for r in predict.path_cv(spark.createDataFrame(tracks, "track int, depth int, r double, c double"), "track", "depth", "r", "c").collect()}
    for degree in (1, 2):
        t, fold = np.arange(23) / 23, np.arange(23) * 5 // 23
        y = np.array([x[2:] for x in tracks[:23]])
        off = np.zeros(23)
        for f in range(5):
            w = np.linalg.lstsq(np.vander(t[fold != f], degree + 1), y[fold != f], rcond=None)[0]
            off[fold == f] = np.linalg.norm(y[fold == f] - np.vander(t[fold == f], degree + 1) @ w, axis=1)
        assert abs(got[1, degree] - np.median(off)) < 1e-6
    assert set(got) == {(1, 1), (1, 2)}


def voxels(spark, f, n=10):
    return spark.createDataFrame([(i, j, k, float(f(i, j, k))) for i in range(n) for j in range(n) for k in range(n)], "i long, j long, k long, value double")


def test_scribbles(spark):
    cells = voxels(spark, lambda i, j, k: 200 if 3 <= i <= 5 else 20, 9)
    features = predict.scribble_features(cells, "value")
    got = {(r["i"], r["j"], r["k"]): r for r in features.collect()}
    assert len(got) == 729
    w = lambda s: np.exp(-0.5 * (np.arange(9) - 4) ** 2 / s**2)
    line = np.array([200 if 3 <= i <= 5 else 20 for i in range(9)]) / 255
    r = got[4, 4, 4]
    assert abs(r["raw"] - 200 / 255) < 1e-12 and abs(r["band"] - (r["smooth1"] - r["smooth4"])) < 1e-12
    assert abs(r["smooth1"] - (w(1) @ line) / w(1).sum()) < 2e-3 and got[2, 4, 4]["edge"] > got[4, 4, 4]["edge"]
    marks = cells.where("(i + 2 * j + 3 * k) % 5 = 0").select("i", "j", "k", (F.col("value") > 100).cast("int").alias("label"))
    p = predict.scribble_classifier(features, marks, ["i", "j", "k"], ["raw", "smooth1", "smooth2", "smooth4", "band", "edge"], trees=20)
    rows = p.collect()
    assert len(rows) == 729 and all((r["probability"] > 0.5) == (3 <= r["i"] <= 5) for r in rows)
    assert predict.mask_quality(p).first()["status"].startswith("fail") and predict.mask_quality(p.withColumn("probability", F.lit(0.1))).first()["status"] == "pass"
    with pytest.raises(ValueError, match="25 marks"):
        predict.scribble_classifier(features, marks.where("label = 0 or i + j + k < 10"), ["i", "j", "k"], ["raw"])


def test_residual_template(spark):
    rnd = np.random.default_rng(9)
    rows = [(u % 2, u, c, float(u + (u + 1) * c + rnd.normal())) for u in range(4) for c in range(12)]
    got = {(r["unit"], r["c"]): r for r in surfaces.residual_template(spark.createDataFrame(rows, "fold int, unit int, c int, value double"), "fold", "unit", ["c"], "value").collect()}
    own = {u: np.array([r[3] for r in rows if r[1] == u]) for u in range(4)}
    size = {u: max(np.percentile(v, 95) - np.percentile(v, 5), 1.0) for u, v in own.items()}
    for (u, c), r in got.items():
        t = np.median([(own[o][c] - np.median(own[o])) / size[o] for o in range(4) if o % 2 != u % 2])
        assert abs(r["prediction"] - (np.median(own[u]) + size[u] * t)) < 1e-9
    assert len(got) == 48


def test_derivatives_of_a_quadratic(spark):
    rows = [(i, j, 0.5 * i * i + i * j - 0.25 * j * j) for i in range(41) for j in range(41)]
    r = surfaces.derivative_maps(spark.createDataFrame(rows, "i long, j long, value double"), "value", (2.0,)).where("i = 20 and j = 20").first()
    assert abs(r["slope"] - np.hypot(40, 10)) < 1e-6 and abs(r["laplacian"] - 0.5) < 1e-6 and abs(r["determinant"] + 1.5) < 1e-6
    mid, gap = 0.25, np.sqrt(0.75**2 + 1)
    assert abs(r["anisotropy"] - gap / (mid + gap)) < 1e-6 and abs(r["smooth"] - 501) < 0.05  # the value, and half the variance times the Laplacian


def test_aligned_volumes_of_a_linear_field(spark):
    cells = voxels(spark, lambda i, j, k: 2 * i - j + 0.5 * k)
    n = np.array([1.0, 2.0, 2.0]) / 3
    units = spark.createDataFrame([(7, 4.5, 4.25, 4.75, *map(float, n))], "id long, x double, y double, z double, nx double, ny double, nz double")
    grid = geo.canonical_grid(spark, 1.0, 0.5)
    got = surfaces.aligned_volume(units, cells, "id", grid, [0.0, 0.5, 1.0]).collect()
    assert len(got) == 3 * grid.count()
    field = lambda p: 2 * p[0] - p[1] + 0.5 * p[2]
    centre = {r["depth"]: r["value"] for r in got if r["gi"] == r["gj"] == 0}
    assert all(abs(v - field(np.array([4.5, 4.25, 4.75]) - d * n)) < 1e-9 for d, v in centre.items())
    shells = {r["depth"]: r for r in surfaces.shell_features(spark.createDataFrame([tuple(r) for r in got], "id long, gi int, gj int, depth double, value double"), "id").collect()}
    for d, r in shells.items():
        own = [x["value"] for x in got if x["depth"] == d]
        assert abs(r["mean"] - np.mean(own)) < 1e-9 and abs(r["std"] - np.std(own)) < 1e-9
    assert abs(shells[0.5]["step"] + 0.5 * field(n)) < 1e-9 and abs(shells[1.0]["bend"]) < 1e-9 and shells[0.0]["step"] is None


def test_offset_scan_finds_the_surface(spark):
    cells = voxels(spark, lambda i, j, k: 100 if i < 5 else 0)
    surface = spark.createDataFrame([(n, 3.5, 3.0 + n % 3, 3.0 + n // 3, 1.0, 0.0, 0.0) for n in range(9)], "id long, x double, y double, z double, nx double, ny double, nz double")
    got = surfaces.offset_scan(surface, cells, "id", [(float(d), 0.0, 0.0) for d in (-1, 0, 1, 2)], 0.5).orderBy(F.col("score").desc()).collect()
    assert got[0]["offset"] == 2 and abs(got[0]["gradient"] - 100) < 1e-9 and abs(got[0]["contrast"] - 100) < 1e-9


def test_torn_edge_of_a_lattice_is_ranked(spark):
    n = 7
    points = [(i * n + j, float(j + 0.5 * (i % 2)), i * 3**0.5 / 2) for i in range(n) for j in range(n)]
    ring = [*range(n), *[n - 1 + n * r for r in range(1, n)], *[n * n - 1 - c for c in range(1, n)], *[n * r for r in range(n - 2, 0, -1)]]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = holes.torn_edges(df, "id", spark.createDataFrame(list(enumerate(ring)), "place int, node long"), 2).collect()
    assert all(r["rank"] >= 1 and r["distance"] >= 0 for r in got) and {r["trial"] for r in got} <= set(range(len(ring))) and len(got) > len(ring) / 2


def test_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return default

    from holdfast import storage

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Session)
    assert storage.shared_dir(spark)


@pytest.mark.parametrize("margin", [4, -1])
def test_quantiles_by_sketch(spark, monkeypatch, margin):
    monkeypatch.setattr(ranks, "MARGIN", margin)  # below 0 the sketch's values enclose no quantile
    rng = np.random.default_rng(3)
    values = {None: rng.normal(size=700), 1: np.repeat([3.0, 5.0], [640, 60]), 2: np.array([7.0]), 3: np.array([1.0, 2.0]), 4: np.array([])}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [(1, None), (4, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r for r in ranks.quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.9, "a": 0.0, "b": 1.0}).collect()}
    assert got.keys() == {None, 1, 2, 3}
    for g, r in got.items():
        assert r["n"] == len(values[g]) and np.allclose([r["m"], r["p"], r["a"], r["b"]], np.quantile(values[g], [0.5, 0.9, 0, 1]), atol=1e-12)
    whole = ranks.quantiles(df, [], "v", {"m": 0.5}).collect()
    assert len(whole) == 1 and abs(whole[0]["m"] - np.median([x for _, x in rows if x is not None])) < 1e-12
    plan = aggregates.method_summary(df, ["g"], "v")._jdf.queryExecution().analyzed().toString()
    assert "percentile(" not in plan  # a group's different values in one task


def test_offsets_and_tuning_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(int(b), int(u), float(x), float(2 * x + b + e)) for b in range(3) for u in range(4) for x, e in zip(rng.normal(size=3), rng.normal(size=3), strict=True)]
    df = spark.createDataFrame(rows, "b int, u int, x double, y double")
    scored = predict.offset_calibration(df, "b", "y")
    assert "percentile(" not in scored._jdf.queryExecution().analyzed().toString() and "median(" not in scored._jdf.queryExecution().analyzed().toString()
    got = {(r["b"], r["u"], r["y"]): r["after"] for r in scored.collect()}
    for b, u, _, y in rows:
        assert abs(got[b, u, y] - abs(y - np.median([r[3] for r in rows if r[0] != b]))) < 1e-12
    tuned = predict.tuned_ridge(df, "b", "u", [F.col("x")], "y", [0.5, 5.0])
    got = {(r["outer"], r["alpha"]): r["score"] for r in tuned.collect()}
    assert len(got) == 6
    for (outer, alpha), score in got.items():
        blocks = []
        for inner in {0, 1, 2} - {outer}:
            x, y = np.array([r[2:] for r in rows if r[0] not in (outer, inner)]).T
            s = ((x - x.mean()) @ (y - y.mean())) / x.std() / (((x - x.mean()) / x.std()) @ ((x - x.mean()) / x.std()) + alpha) / x.std()
            off = {}
            for _, u, a, c in [r for r in rows if r[0] == inner]:
                off.setdefault(u, []).append(abs(y.mean() + s * (a - x.mean()) - c))
            blocks.append(np.median([np.mean(e) for e in off.values()]))
        assert abs(score - np.median(blocks)) < 1e-9


def test_exact_tests_beyond_the_five_hundred_terms_of_their_sql(spark):
    rows = [(1, 1.0 if i < 2451 else -1.0) for i in range(4964)]
    got = stats.sign_test(spark.createDataFrame(rows, "g int, d double"), ["g"], "d").first()
    assert abs(got["p"] - float(Fraction(2 * sum(comb(4964, i) for i in range(2452)), 2**4964))) < 1e-9
    a, b, c, d = 1250, 1190, 1230, 1260
    mass = {x: comb(a + b, x) * comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
    want = float(Fraction(sum(m for m in mass.values() if m <= mass[a]), comb(a + b + c + d, a + c)))
    got = stats.fisher(spark.createDataFrame([(1, a, b, c, d)], "g int, a long, b long, c long, d long"), ["g"]).first()
    assert abs(got["p"] - want) < 1e-8 and abs(got["odds"] - a * d / (b * c)) < 1e-12


def test_huber_medians_are_not_gathered(spark, monkeypatch):
    asked = []
    own = moments.quantiles
    monkeypatch.setattr(moments, "quantiles", lambda rows, by, value, wanted: asked.append(value) or own(rows, by, value, wanted))
    df = spark.createDataFrame([(0, float(x), 2.0 * x + 1 + (50.0 if x == 7 else 0.0)) for x in range(12)], "g int, x double, y double")
    got = moments.huber(df, ["g"], [F.col("x")], F.col("y"), rounds=2).first()
    assert asked == ["hf_r", "hf_a"] * 2 and len(got["beta"]) == 2 and np.isfinite(got["rmse"])


def test_penalties_share_one_pass(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (1, 3, 2.0), (1, 5, 0.5), (2, 2, 1.0)], "c int, k int, loss double")
    out = predict.penalised_choice(df, "c", "k", "loss", [0.0, 2.0])
    assert {tuple(r) for r in out.collect()} == {(0.0, 1, 5), (0.0, 2, 2), (2.0, 1, 1), (2.0, 2, 2)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # rows aren't multiplied before they are grouped


def test_fisher_takes_one_step_for_each_table(spark):
    """Large margins: the bound of what counts is worked out once, not anew for each of the 40,000 tables."""
    import time
    from math import exp, lgamma, log

    a, b, c, d = 20_100, 20_000, 20_050, 20_300
    start = time.monotonic()
    got = stats.fisher(spark.createDataFrame([(1, a, b, c, d)], "g int, a long, b long, c long, d long"), ["g"]).first()
    assert time.monotonic() - start < 60
    terms = [-lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) for i in range(max(0, a - d), min(a + b, a + c) + 1)]
    most, own = max(terms), terms[a - max(0, a - d)]
    every = [exp(t - most) for t in terms]
    kept = sum(e for t, e in zip(terms, every, strict=True) if t <= own + log(1 + 1e-7))
    assert abs(got["p"] - kept / sum(every)) < 1e-6


def test_cross_group_median_gathers_no_group(spark):
    """The median of a group's errors is found by counting; no aggregate holds a group's different values."""
    got = QUERIES["I34_cross_group_holdout"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan and "ObjectHashAggregate" not in plan
    assert [r["eye"] for r in got.orderBy("eye").collect()] == [0, 1]


def test_trees_are_fitted_on_profiles(spark, monkeypatch):
    """Rows with equal xs are fitted as one or two weighted ones: ridge and boosted trees equal those of all rows, forests are near them."""
    rnd = random.Random(8)
    rows = [(i, i % 3, float(rnd.randrange(5)), float(rnd.randrange(4))) for i in range(1500)]
    rows = [(*r, 2 * r[2] - r[3] * r[2] + rnd.gauss(0, 1)) for r in rows]
    df = spark.createDataFrame(rows, "id long, block int, a double, b double, y double")
    sizes, kept = [], learners.moments_kept
    monkeypatch.setattr(learners, "moments_kept", lambda few, target: (sizes.append(few.groupBy("hf_tree").count().agg(F.max("count")).first()[0]), kept(few, target))[1])
    got = {r["id"]: r for r in learners.tree_regressors(df, "block", ["a", "b"], "y").collect()}
    assert len(got) == 1500 and sizes == [3 * 20]
    assert list(got[0].asDict()) == ["id", "block", "a", "b", "y", "p_ridge", "p_forest", "p_boosted", "choice", "prediction", "disagreement"]
    own = learners.VectorAssembler(inputCols=["a", "b"], outputCol="hf_features").transform(df)
    for n in ("ridge", "boosted"):
        model = learners.regressors("y", 1)[n].setPredictionCol("p").fit(own.where("block <> 1"))
        assert max(abs(r["p"] - got[r["id"]][f"p_{n}"]) for r in model.transform(own.where("block = 1")).collect()) < 1e-8
    forest = learners.RandomForestRegressor(numTrees=10, seed=1, featuresCol="hf_features", labelCol="y").fit(own.where("block <> 1")).transform(own.where("block = 1")).collect()
    error = [np.mean([abs(p - r["y"]) for r, p in ((r, of(r)) for r in forest)]) for of in (lambda r: r["prediction"], lambda r: got[r["id"]]["p_forest"])]
    assert abs(error[1] / error[0] - 1) < 0.2
    with pytest.raises(Exception, match="null or NaN"):
        learners.tree_regressors(df.withColumn("y", F.when(F.col("id") != 3, F.col("y"))), "block", ["a", "b"], "y")


def test_large_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """A (sparse) file of over 2 GB, which no row can hold, and small ones by either way; names that aren't plain in URIs."""
    from holdfast.sources import tables

    for name, content in (("a b%20#c?.bin", b"x" * 1000), ("z.gz", b"\x1f\x8b no archive")):
        (tmp_path / name).write_bytes(content)
    files = lambda: {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in tables.file_fingerprints(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    own = {f.name: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in tmp_path.iterdir()}
    assert files() == own
    monkeypatch.setattr(tables, "WHOLE", -1)
    assert files() == own
    monkeypatch.undo()
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate((1 << 31) + 5)
    digest = hashlib.sha256()
    for _ in range(1 << 11):
        digest.update(bytes(1 << 20))
    digest.update(bytes(5))
    assert files() == own | {"large.bin": ((1 << 31) + 5, digest.hexdigest())}
