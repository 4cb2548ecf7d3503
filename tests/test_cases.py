"""Hand-made cases and invariants of operators that SQL can't check."""

import random
from math import cos, pi, sin

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions import geometry as geo
from holdfast.operators import aggregates, graph, holdout, joins, moments, predict, ranks, spatial, stats, volume, windows
from holdfast.sources import tables


def points(spark, rows, schema="id long, x double, y double, value double"):
    return spark.createDataFrame(rows, schema)


def test_weighted_neighbours_by_hand(spark):
    train, test = points(spark, [(1, 0.0, 0.0, 0.0), (2, 3.0, 0.0, 12.0)]), points(spark, [(9, 1.0, 0.0, 5.0), (8, 3.0, 0.0, 0.0)])
    got = {r["query_id"]: r for r in spatial.idw(spatial.knn_join(test, train, 2, ["x", "y"], "id", "id"), train, "id", "value").collect()}
    assert got[9]["prediction"] == 4 and got[9]["nearest"] == 1 and got[8]["prediction"] == 12


@pytest.mark.parametrize("dims", [["x"], ["x", "y"], ["x", "y", "z"]])
def test_knn_equals_brute_force(spark, dims):
    rnd = random.Random(len(dims))
    rows = [(i, rnd.choice((0.0, rnd.gauss(0, 1), 100 * rnd.random())), rnd.gauss(0, 5), float(rnd.randrange(4)), i % 3) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, g int")
    place = {r[0]: [r[1 + "xyz".index(d)] for d in dims] for r in rows}
    got = {}
    for r in spatial.knn_join(df, df, 5, dims, "id", "id", ("g",), exclude_self=True).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["neighbour_id"]
    for i, *_, g in rows:
        d = sorted((np.sqrt(sum((a - b) * (a - b) for a, b in zip(place[i], place[r[0]], strict=True))), r[0]) for r in rows if r[0] != i and r[4] == g)
        assert [got[i][k] for k in range(1, 6)] == [x[1] for x in d[:5]]


def test_knn_of_few_and_no_points(spark):
    one = points(spark, [(1, 0.0, 0.0, 1.0)])
    assert spatial.knn_join(one, one, 3, ["x", "y"], "id", "id", exclude_self=True).count() == 0
    assert spatial.knn_join(one, one.limit(0), 3, ["x", "y"], "id", "id").count() == 0
    assert spatial.knn_join(points(spark, [(5, 1e6, -1e6, 0.0), (6, None, 0.0, 0.0)]), one, 3, ["x", "y"], "id", "id").count() == 1


def test_splits_are_covers_and_buffers_hold(spark):
    rnd = random.Random(7)
    df = points(spark, [(i, rnd.random(), rnd.random(), rnd.random()) for i in range(200)])
    roles = holdout.make_splits(df, "id", "x", "y")
    assert windows.multiply_assigned(roles, ["strategy"], "id").count() == 0 and roles.count() == 600
    at = {r["id"]: (r["x"], r["y"]) for r in df.collect()}
    b = {r["id"]: r["assignment"] for r in roles.where("strategy = 'buffered'").collect()}
    xs, ys = zip(*at.values(), strict=True)
    radius = 0.12 * max(max(xs) - min(xs), max(ys) - min(ys))
    gap = lambda i, j: np.hypot(at[i][0] - at[j][0], at[i][1] - at[j][1])
    test = [i for i, a in b.items() if a == "test"]
    assert len(test) == 50 and all((min(gap(i, j) for j in test) < radius) == (a == "excluded") for i, a in b.items() if a != "test")
    moved = df.withColumn("value", F.lit(-1.0))
    assert sorted(map(tuple, holdout.make_splits(moved, "id", "x", "y").collect())) == sorted(map(tuple, roles.collect()))


def test_scores_of_constant_targets_and_all_excluded(spark):
    rnd = random.Random(1)
    df = points(spark, [(i, rnd.random(), rnd.random(), 2.0) for i in range(60)])
    scores = {r["strategy"]: r for r in predict.compare_splits(df, "id", "x", "y", "value", buffer=5.0)[0].collect()}
    assert scores["random"]["rmse"] == 0 and scores["random"]["r2"] is None
    assert scores["buffered"]["test"] == 15 and scores["buffered"]["rmse"] is None


def test_invalid_points(spark):
    bad = points(spark, [(1, float("nan"), 0.0, 0.0), (2, 1e13, 0.0, 0.0), (3, 1.0, 1.0, None), (4, 1.0, 1.0, 2.0)])
    reasons = sorted(r["reason"] for r in tables.validate_points(bad, key="id").collect())
    assert reasons == ["coordinates repeat", "too few rows", "value is not finite", "x is not finite", "x is too large"]
    with pytest.raises(ValueError, match="value, y"):
        tables.validate_points(bad.drop("y", "value"), key="id")


def test_offsets_come_from_other_blocks(spark):
    cases = spark.createDataFrame([("a", 0, 100.0), ("b", 0, 100.0), ("c", 1, 4.0), ("d", 1, 6.0)], "case_id string, b int, o double")
    got = {r["case_id"]: r["shift"] for r in predict.offset_calibration(cases, "b", "o").collect()}
    assert got == {"a": 5, "b": 5, "c": 100, "d": 100}


def test_higher_quantile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "e double").withColumn("g", F.lit(1))
    assert aggregates.higher_quantile(df, ["g"], "e", 0.9, "w").first()["w"] == 10 and aggregates.higher_quantile(df, ["g"], "e", 0.5, "w").first()["w"] == 6


def test_rotation_and_axes(spark):
    rnd = np.random.default_rng(1)
    a = rnd.normal(size=(40, 3)) * (3, 1, 0.3)
    r = np.array([[cos(1), -sin(1), 0], [sin(1), cos(1), 0], [0, 0, 1]])
    rows = [(1, *map(float, p), *map(float, r @ p)) for p in a]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double, a double, b double, c double")
    got = moments.kabsch(df, ["g"], ["x", "y", "z"], ["a", "b", "c"]).first()["rotation"]
    assert np.allclose(np.array(got).reshape(3, 3), r)
    axes = {r["axis"]: r for r in moments.principal_axes(df, ["g"], ["x", "y", "z"]).collect()}
    values, vectors = np.linalg.eigh(np.cov(a.T, ddof=0))
    assert all(abs(abs(np.dot(axes[k]["direction"], vectors[:, 2 - k])) - 1) < 1e-9 and abs(axes[k]["share"] - values[2 - k] / values.sum()) < 1e-9 for k in range(3))


def test_ridge_and_leave_one_out_equal_numpy(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(60, 2)) * (5, 1) + 3
    y = x @ (2, -1) + rnd.normal(size=60)
    df = spark.createDataFrame([(i % 3, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "b int, p double, q double, y double")

    def fit(xs, ys, alpha):
        m, s = xs.mean(0), xs.std(0)
        z = (xs - m) / s
        w = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (ys - ys.mean()))
        return lambda v: ys.mean() + (v - m) / s @ w

    got = moments.block_ridge(df, "b", [F.col("p"), F.col("q")], F.col("y"), 4.0).collect()
    for r in got:
        keep = np.arange(60) % 3 != r["b"]
        assert abs(r["prediction"] - fit(x[keep], y[keep], 4.0)(np.array([r["p"], r["q"]]))) < 1e-9
    loo = {r["alpha"]: r["score"] for r in moments.leave_one_out(df, [F.col("p"), F.col("q")], F.col("y"), [0.1, 10.0]).collect()}
    m, s = x.mean(0), x.std(0)
    z = np.c_[(x - m) / s]
    for alpha, score in loo.items():  # the scaler stays that of all rows
        e = []
        for i in range(60):
            k = np.arange(60) != i
            zc, yc = z[k] - z[k].mean(0), y[k] - y[k].mean()
            w = np.linalg.solve(zc.T @ zc + alpha * np.eye(2), zc.T @ yc)
            e.append(abs(y[i] - y[k].mean() - (z[i] - z[k].mean(0)) @ w))
        assert abs(score - np.mean(e)) < 1e-6


def test_huber_shrugs_off_outliers(spark):
    rows = [(1, float(i), 2.0 * i + 1 + (500.0 if i % 17 == 0 else 0.0)) for i in range(100)]
    r = moments.huber(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], [F.col("x")], F.col("y")).first()
    assert abs(r["beta"][0] - 1) < 3 and abs(r["beta"][1] - 2) < 0.05


def test_two_layers(spark):
    rows = [(g, v + g) for g in (1, 2) for v in (0.0, 0.1, 0.2, 5.0, 5.2)]
    got = {r["g"]: (r["low"], r["high"]) for r in moments.two_layers(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect()}
    assert all(np.allclose(got[g], (0.1 + g, 5.1 + g)) for g in (1, 2))


def test_graph_jobs_on_a_path(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0 + i % 2) for i in range(20)], "a long, b long, length double")
    s = spark.createDataFrame([(0, 0)], "source long, node long")
    assert {r["node"]: r["hop"] for r in graph.bfs(e, s).collect()} == {i: i for i in range(21)}
    paths = {r["node"]: r["distance"] for r in graph.shortest_paths(e, s, "length", 100.0).collect()}
    assert paths[20] == 30 and paths[3] == 4
    known = spark.createDataFrame([(0, 0.0), (20, 20.0)], "node long, value double")
    values = {r["node"]: r["value"] for r in graph.harmonic(e, known, F.lit(1.0)).collect()}
    assert all(abs(values[i] - i) < 1e-5 for i in range(1, 20))
    assert {r["root"] for r in graph.connected_components(e).collect()} == {0}
    seeds = [r["node"] for r in graph.separated_seeds(e, spark.createDataFrame([(0,)], "node long"), 2, 5, 7).collect()]
    assert seeds[0] == 20 and abs(seeds[0] - seeds[1]) >= 7
    with pytest.raises(Exception, match="only 3 seeds|only 2 seeds"):
        graph.separated_seeds(e, spark.createDataFrame([(0,)], "node long"), 6, 5, 7)
    patch = graph.grown_patches(e, spark.createDataFrame([(1, 10), (2, 0)], "attempt long, node long"), 4, "s").groupBy("attempt").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).collect()
    assert all(r["n"] == 4 and r["hi"] - r["lo"] == 3 for r in patch)


def test_voxel_components(spark):
    cells = [(0, 0, 0), (1, 1, 1), (2, 2, 2), (5, 5, 5), (5, 5, 6)]
    df = spark.createDataFrame([("r", *c) for c in cells], "region string, i long, j long, k long")
    assert sorted(r["count"] for r in graph.grid_components(df, ["region"]).groupBy("component").count().collect()) == [2, 3]


def test_resampled_paths_pass_through_nodes_and_stay_monotone(spark):
    rows = [(1, d, float(v)) for d, v in ((0, 0), (4, 1), (6, 9), (10, 10))] + [(2, 0, 0.0), (2, 5, 10.0), (3, 7, 3.0)]
    got = {}
    for r in volume.resample_path(spark.createDataFrame(rows, "t int, d int, v double"), "t", "d", ["v"]).collect():
        got.setdefault(r["t"], {})[r["depth"]] = r["v"]
    assert sorted(got[1]) == list(range(11)) and [got[1][d] for d in (0, 4, 6, 10)] == [0, 1, 9, 10]
    assert all(a <= b for a, b in zip(list(dict(sorted(got[1].items())).values()), list(dict(sorted(got[1].items())).values())[1:], strict=False))
    assert got[2].keys() == set(range(6)) and all(abs(v - 2 * i) < 1e-9 for i, v in got[2].items()) and got[3] == {7: 3.0}


def test_interpolation_is_exact_for_linear_fields(spark):
    cells = spark.createDataFrame([(i, j, 2.0 * i + 3 * j) for i in range(4) for j in range(4)], "i long, j long, v double")
    q = spark.createDataFrame([(1, 1.25, 2.5), (2, 3.0, 3.0), (3, 3.5, 0.0)], "id long, a double, b double")
    assert {r["id"]: r["value"] for r in volume.gather(q, cells, "id", ["a", "b"], ["i", "j"], "v").collect()} == {1: 10.0, 2: 15.0, 3: None}


def test_maxima_equal_greedy_suppression(spark):
    rnd = random.Random(3)
    rows = [(i * 20 + j, float(i), float(j), rnd.randrange(12) / 10) for i in range(20) for j in range(20)]  # with ties
    got = {r["id"] for r in volume.local_maxima(spark.createDataFrame(rows, "id long, x double, y double, v double"), "id", ["x", "y"], "v", 1.5, 0.5, 4.0).collect()}
    far = lambda r, s: max(abs(r[1] - s[1]), abs(r[2] - s[2]))
    top = [r for r in rows if r[3] > 0.5 and all(r[3] >= s[3] for s in rows if far(r, s) <= 1.5)]
    kept = []
    for r in sorted(top, key=lambda r: (-r[3], r[0])):
        if all(far(r, s) >= 4 for s in kept):
            kept.append(r)
    assert got == {r[0] for r in kept}


def test_signed_rank_equals_enumeration(spark):
    d = [1.5, -2.0, 3.0, 3.0, -0.5, 4.0, 0.0]
    r = stats.signed_rank(spark.createDataFrame([(1, x) for x in d], "g int, d double"), ["g"], "d").first()
    v = [x for x in d if x]
    ranks = [sum(abs(y) < abs(x) for y in v) + (sum(abs(y) == abs(x) for y in v) + 1) / 2 for x in v]
    sums = [sum(k for i, k in enumerate(ranks) if p >> i & 1) for p in range(64)]
    w = sum(k for k, x in zip(ranks, v, strict=True) if x > 0)
    low = min(w, sum(ranks) - w)
    assert r["n"] == 6 and r["w"] == w and abs(r["p"] - min(1, 2 * np.mean([s <= low for s in sums]))) < 1e-12


def test_large_groups_are_sampled(spark):
    rnd = np.random.default_rng(4)
    d = rnd.normal(0.35, 1, 18)
    df = spark.createDataFrame([(1, float(x)) for x in d] + [(None, float(x)) for x in d], "g int, d double")
    for test, least in ((stats.sign_flip, 1), (stats.signed_rank, 1)):
        whole = {r["g"]: r for r in test(df, ["g"], "d").collect()}
        drawn = {r["g"]: r for r in test(df, ["g"], "d", most=least, draws=4000).collect()}
        assert whole.keys() == drawn.keys() == {1, None}
        for g, r in drawn.items():
            p = whole[g]["p"]
            assert r["patterns"] == 4000 and r["n"] == 18 and abs(r["p"] - p) < 4 * np.sqrt(p * (1 - p) / 4000) + 1e-3
    assert {r["patterns"] for r in stats.sign_flip(df, ["g"], "d").collect()} == {1 << 18}


def test_hops_of_several_sources_and_how_much_seeds_write(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rnd.integers(0, 60, (75, 2))} | {(i, i + 1) for i in range(60, 75)}  # loops of one node too
    want = {}
    for source, starts in ((1, [0, 5]), (2, [60]), (3, [99])):
        front, hop = set(starts), 0
        while front:
            want |= {(source, n): hop for n in front}
            front = {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in front and (source, y) not in want}
            hop += 1
    sources = spark.createDataFrame([(1, 0), (1, 5), (1, 5), (2, 60), (3, 99)], "source long, node long")
    e = spark.createDataFrame(sorted(pairs), "a long, b long")
    got = graph.bfs(e, sources).collect()
    assert len(got) == len(want) and {(r["source"], r["node"]): r["hop"] for r in got} == want
    assert max(r["hop"] for r in graph.bfs(e, sources, 3).collect()) == 3
    written, kept = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df: written.append(1) or kept(df))
    line = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    assert [r["node"] for r in graph.separated_seeds(line, spark.createDataFrame([(0,)], "node long"), 2, 2, 3).orderBy("seed").collect()] == [12, 2]
    assert len(written) <= 36  # edges once, and hops for all seeds but the last one


def test_a_round_of_harmonic_writes_one_table(spark, monkeypatch):
    written, kept = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df: written.append(1) or kept(df))
    rnd = np.random.default_rng(1)
    e = spark.createDataFrame([(i, i + 1, float(w)) for i, w in enumerate(rnd.uniform(1, 3, 9))], "a long, b long, w double")
    got = {r["node"]: r["value"] for r in graph.harmonic(e, spark.createDataFrame([(0, 0.0), (9, 1.0)], "node long, value double"), F.col("w")).collect()}
    steps = np.cumsum([1 / r["w"] for r in e.orderBy("a").collect()])
    assert all(abs(got[i] - steps[i - 1] / steps[-1]) < 1e-7 for i in range(1, 9))
    assert len(written) <= 3 + 9  # eight unknown values: about as many rounds


def test_sampled_signs_are_those_of_the_hash_and_copy_no_row(spark):
    rnd = np.random.default_rng(6)
    rows = [(g, "a" if i % 3 else None, float(x)) for g in (1, 2, None) for i, x in enumerate(rnd.normal(0, 1, 70))]
    df = spark.createDataFrame(rows, "g int, h string, d double")
    for by in ([], ["g"], ["g", "h"]):
        got = stats.sampled_flips(df, by, "d", "d", 50, "s")
        assert "Generate explode(sequence" not in got._jdf.queryExecution().toString()
        each = ranks.numbered(df, by, ["d"], "i").select(*by, "d", "i", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("draw"))
        sign = F.when(F.xxhash64(F.lit("s"), "draw", "i") % 2 != 0, 1.0).otherwise(-1.0)
        want = {tuple(r)[:-1]: r["t"] for r in each.groupBy(*by, "draw").agg(F.sum(sign * F.col("d")).alias("t")).collect()}
        assert {tuple(r)[:-1] for r in got.collect()} == set(want)
        assert all(abs(r["total"] - want[tuple(r)[:-1]]) < 1e-9 for r in got.collect())


def test_bootstraps_of_large_groups(spark):
    rnd = np.random.default_rng(7)
    values = rnd.normal(0, 1, 300)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(values)], "g int, i int, v double")
    exact = stats.bootstrap_median(df, ["g"], "i", "v", 600, "a").first()
    poisson = stats.bootstrap_median(df, ["g"], "i", "v", 600, "a", most=10).first()
    assert poisson["low"] < np.median(values) < poisson["high"]
    assert abs(exact["low"] - poisson["low"]) < 0.06 and abs(exact["high"] - poisson["high"]) < 0.06


def test_order_statistics_of_one_large_group(spark):
    """A group that lies in many ranges, with ties, beside small ones and a null one."""
    rnd = random.Random(6)
    rows = [("big", i, rnd.randrange(200)) for i in range(3000)] + [("small", i, i % 3) for i in range(7)] + [(None, i, i) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = ranks.numbered(df, ["g"], ["v", "i"], "n", ranges=9)
    want = {}
    for g in ("big", "small", None):
        want |= {(g, i): n for n, (_, i) in enumerate(sorted((v, i) for h, i, v in rows if h == g), 1)}
    assert {(r["g"], r["i"]): r["n"] for r in got.collect()} == want
    spread = df.repartitionByRange(9, "g", "v", "i").where("g = 'big'").groupBy(F.spark_partition_id()).count().count()
    assert spread > 4
    ranked = {(r["g"], r["i"]): r["r"] for r in aggregates.average_rank(df, ["g"], "v", "r").collect()}
    for g in ("big", "small", None):
        own = [(i, v) for h, i, v in rows if h == g]
        assert all(ranked[g, i] == sum(w < v for _, w in own) + (sum(w == v for _, w in own) + 1) / 2 for i, v in own[:100])
    medians = {r["g"]: r["median"] for r in ranks.medians(df, ["g"], "v").collect()}
    assert medians == {g: float(np.median([v for h, _, v in rows if h == g])) for g in ("big", "small", None)}


def test_balanced_folds_deal_one_after_another(spark):
    rnd = random.Random(2)
    for sizes in ([rnd.choice((1, 2, 3, 50, 51, 400, 0)) for _ in range(300)], [7] * 10, [0, 0, 5], [10**12, 3, 2, 1, 1, 1]):
        load, want = [0] * 4, {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            want[i] = load.index(min(load))
            load[want[i]] += sizes[i]
        df = spark.createDataFrame(list(enumerate(sizes)), "g long, n long")
        assert {r["g"]: r["fold"] for r in holdout.balanced_folds(df, "g", "n", 4).collect()} == want


def test_components_across_tiles_equal_brute_force(spark):
    rnd = random.Random(8)
    cells = {(rnd.randrange(-20, 40), rnd.randrange(-3, 4), rnd.randrange(14, 19)) for _ in range(300)} | {(i, 30, 16) for i in range(-40, 60)}
    df = spark.createDataFrame([("r", *c) for c in cells] + [("s", *c) for c in list(cells)[:50]], "region string, i long, j long, k long")
    left, parts = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            c = todo.pop()
            part.add(c)
            near = {(c[0] + a, c[1] + b, c[2] + d) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)} & left
            left -= near
            todo += near
        parts.append(frozenset(part))
    got = {}
    for r in graph.grid_components(df, ["region"]).collect():
        got.setdefault((r["region"], r["component"]), set()).add((r["i"], r["j"], r["k"]))
    assert {frozenset(x) for (g, _), x in got.items() if g == "r"} == set(parts)


def test_patches_are_different_sets(spark):
    e = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    got = graph.grown_patches(e, spark.createDataFrame([(i, i % 3) for i in range(9)], "attempt long, node long"), 3, "s").collect()
    assert sorted((r["attempt"], r["node"]) for r in got) == [(0, 0), (0, 1), (0, 2)]


def test_repeated_keys_are_an_error(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert joins.validated_join(left, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"]).count() == 3
    with pytest.raises(Exception, match="repeated key on the right"):
        joins.validated_join(left, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"]).collect()
    with pytest.raises(Exception, match="repeated key on the left"):
        joins.validated_join(left, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"], one_to_one=True).collect()


def test_models_freeze_once_and_are_checked(spark, tmp_path):
    model = spark.createDataFrame([("one", 1.0), ("x", 2.0)], "term string, value double")
    path = str(tmp_path / "m")
    tables.freeze_model(model, ["term"], "value", path)
    frozen = tables.load_frozen(spark, path, ["term"], "value")
    out = predict.apply_frozen(spark.createDataFrame([(3.0,)], "x double"), frozen, {"one": F.lit(1.0), "x": F.col("x")})
    assert out.first()["prediction"] == 7
    with pytest.raises(Exception, match="exists"):
        tables.freeze_model(model, ["term"], "value", path)
    spark.read.parquet(path).withColumn("value", F.lit(9.0)).write.parquet(path + "2")
    with pytest.raises(ValueError, match="not what was frozen"):
        tables.load_frozen(spark, path + "2", ["term"], "value")


def test_hexagon_has_no_gap(spark):
    rows = [(1, k * pi / 3) for k in range(6)] + [(2, 0.0), (2, 0.1)]
    got = {r["g"]: r["max_gap"] for r in windows.angular_gap(spark.createDataFrame(rows, "g int, a double"), ["g"], "a").collect()}
    assert abs(got[1] - pi / 3) < 1e-12 and abs(got[2] - (2 * pi - 0.1)) < 1e-12


def test_vectors_without_length_are_an_error(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")
    with pytest.raises(Exception, match="vector without length"):
        df.select(geo.unit(geo.vec())[0]).collect()


def test_plans_have_no_cartesian_product(spark):
    from holdfast.plans import QUERIES

    for name in ("C02_knn_join", "C04_range_join", "H01_knn_graph", "D19_template_stack", "C06_label_overlap"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
