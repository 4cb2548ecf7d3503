"""Matching, holes and local surfaces on shapes whose answers are known."""

from itertools import permutations
from math import cos, pi, sin

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions import geometry as geo
from holdfast.operators import holes, matching, predict, surfaces


def test_assignment_is_optimal():
    rnd = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5)):
        c = rnd.random((n, m))
        got = matching.assignment(c)
        assert len(set(got)) == n
        assert abs(sum(c[i, j] for i, j in enumerate(got)) - min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(m), n))) < 1e-12


def test_matches_are_one_to_one(spark):
    pairs = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.1), (2, 1, 1.2), (3, 9, 0.5), (4, 9, 0.4)], "query_id long, neighbour_id long, distance double")
    got = {(r["query_id"], r["neighbour_id"]) for r in matching.one_to_one(pairs).collect()}
    assert got == {(1, 2), (2, 1), (4, 9)}


def hexagons(n=7):
    return [(i * n + j, float(j + 0.5 * (i % 2)), i * 3**0.5 / 2) for i in range(n) for j in range(n)]


def test_hole_of_a_lattice_is_the_strongest(spark):
    lost = hexagons()[3 * 7 + 3]
    df = spark.createDataFrame([(1, *p) for p in hexagons() if p != lost], "g int, id long, x double, y double")
    top = holes.hole_candidates(df, "id", ("g",)).orderBy(F.col("score").desc()).first()
    assert abs(top["x"] - lost[1]) < 1e-6 and abs(top["y"] - lost[2]) < 1e-6 and abs(top["radius"] - 1) < 1e-6
    filled = holes.greedy_insertion(df, "id", "g", 1).first()
    assert abs(filled["x"] - lost[1]) < 1e-6 and filled["step"] == 1


def test_triangulation_of_a_lattice_has_unit_edges(spark):
    df = spark.createDataFrame(hexagons(5), "id long, x double, y double")
    e = holes.triangulation_edges(df, "id").collect()
    assert all(abs(r["length"] - 1) < 1e-6 for r in e if r["length"] < 1.3) and len([r for r in e if r["length"] < 1.3]) == 56


def test_hull_area(spark):
    rnd = np.random.default_rng(2)
    inside = [(1, float(a), float(b)) for a, b in rnd.random((300, 2))]
    circle = [(2, cos(2 * pi * k / 50), sin(2 * pi * k / 50)) for k in range(50)] + [(2, 0.0, 0.0)]
    df = spark.createDataFrame([*inside, (1, 0.0, 0.0), (1, 1.0, 0.0), (1, 1.0, 1.0), (1, 0.0, 1.0), *circle, (3, 0.5, 0.5)], "g int, u double, v double")
    got = {r["g"]: r for r in holes.hull_area(df, ["g"], "u", "v").collect()}
    assert got[1]["corners"] == 4 and abs(got[1]["area"] - 1) < 1e-12
    assert got[2]["corners"] == 50 and abs(got[2]["area"] - 25 * sin(2 * pi / 50)) < 1e-9 and got[3]["area"] == 0


def test_tracks_are_linked_both_ways(spark):
    rows = [(1, f, 10 * t + f, 5.0 * t + 0.1 * f, 0.0) for t in range(3) for f in range(5) if not (t == 2 and f == 4)]
    df = spark.createDataFrame(rows, "region int, frame int, id long, x double, y double")
    got = matching.link_tracks(df, "region", "frame", "id", ["x", "y"], 2, 1.0).collect()
    assert len(got) == 14 and all(r["track"] // 10 == r["id"] // 10 for r in got)


def test_shift_is_found(spark):
    a = spark.createDataFrame(hexagons(4), "id long, x double, y double")
    b = a.select("id", (F.col("x") - 0.2).alias("x"), (F.col("y") + 0.4).alias("y"))
    best = matching.best_shift(a, b, "id", ("x", "y"), 3, 0.2, 8).orderBy("score").first()
    assert abs(best["da"] - 0.2) < 1e-9 and abs(best["db"] + 0.4) < 1e-9 and best["score"] < 1e-9


def test_thin_plate_reproduces_planes(spark):
    rnd = np.random.default_rng(3)
    sites = [(i, float(a), float(b), float(2 * a - b + 1)) for i, (a, b) in enumerate(rnd.random((80, 2)))]
    df = spark.createDataFrame(sites, "id long, x double, y double, value double")
    q = spark.createDataFrame([(1000, 0.3, 0.6), (1001, 0.5, 0.5)], "id long, x double, y double")
    got = {r["query_id"]: r["prediction"] for r in surfaces.thin_plate(q, df, "id", "value", 20).collect()}
    assert abs(got[1000] - 1.0) < 1e-6 and abs(got[1001] - 1.5) < 1e-6


def test_normals_of_a_sphere_point_outwards(spark):
    rows = []
    for k in range(200):
        z = 1 - 2 * (k + 0.5) / 200
        t, r = k * pi * (3 - 5**0.5), (1 - z * z) ** 0.5
        rows.append((k, r * cos(t), r * sin(t), z))
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = surfaces.local_normals(df, "id", 8).join(df, "id").collect()
    assert min(r["nx"] * r["x"] + r["ny"] * r["y"] + r["nz"] * r["z"] for r in got) > 0.97


def test_registration_error_is_checked(spark):
    rnd = np.random.default_rng(4)
    a = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rnd.random((12, 3)))], "id long, x double, y double, z double")
    b = a.select("id", (F.col("x") * 2 + 1).alias("x"), (F.col("y") - F.col("x")).alias("y"), "z")
    assert max(r["error"] for r in surfaces.registration_check(a, b, "id", 1e-6).collect()) < 1e-9
    with pytest.raises(Exception, match="registration error"):
        surfaces.registration_check(a, b.withColumn("z", F.when(F.col("id") == 3, 9.0).otherwise(F.col("z"))), "id", 1e-6).collect()


def test_mapping_choice_equals_refits(spark):
    rnd = np.random.default_rng(5)
    x = rnd.random((9, 2))
    y = x @ [[1.5, 0.2], [-0.3, 0.8]] + 0.01 * rnd.normal(size=(9, 2))
    df = spark.createDataFrame([(1, *map(float, (*a, *b))) for a, b in zip(x, y, strict=True)], "g int, a double, b double, c double, d double")
    r = predict.mapping_choice(df, ["g"], ["a", "b"], ["c", "d"]).first()
    t, f = [], []
    for i in range(9):
        k = np.arange(9) != i
        t.append(np.linalg.norm(y[i] - x[i] - np.median(y[k] - x[k], axis=0)))
        w = np.linalg.lstsq(np.c_[np.ones(8), x[k]], y[k], rcond=None)[0]
        f.append(np.linalg.norm(y[i] - np.r_[1, x[i]] @ w))
    assert abs(r["translation"] - np.median(t)) < 1e-9 and abs(r["affine"] - np.median(f)) < 1e-9 and r["choice"] == "affine"


def test_turned_patches_keep_linear_fields(spark):
    rows = [(1, a, b, 2.0 * a + b) for a in range(-5, 6) for b in range(-5, 6)]
    df = spark.createDataFrame(rows, "unit long, da long, db long, value double")
    got = surfaces.turned_patches(df, "unit", "value", [(0.0, 1.0, 0.0, 0.0), (0.0, 1.0, 0.5, 0.0)]).where("abs(da) < 4 AND abs(db) < 4").collect()
    assert all(abs(r["value"] - (2 * (r["da"] - 0.5 * r["setting"]) + r["db"])) < 1e-9 for r in got)


def surface(units=(1, 2, 3), n=13, seed=6):
    rnd = np.random.default_rng(seed)
    return [(u, u % 3, i, j, i / 6 - 1, j / 6 - 1, float((i / 6 - 1) ** 2 + u * (j / 6 - 1) + 0.1 * rnd.normal())) for u in units for i in range(n) for j in range(n)]


SURFACE = "unit int, block int, gi int, gj int, u double, v double, value double"
MASKS = geo.region_masks


def test_gap_fill_of_a_quadratic_is_exact(spark):
    cells = [(*c[:6], c[4] ** 2 + c[0] * c[5]) for c in surface()]
    df = spark.createDataFrame(cells, SURFACE)
    got = surfaces.gap_fill(df, "unit", "block", MASKS(F.col("u"), F.col("v")), "value", alphas=(1e-9, 1e-3, 0.1)).collect()
    assert len(got) >= 9 and all(r["quadratic"] < 1e-6 and r["hidden"] >= 12 for r in got)


def test_gap_fill_by_hand_and_without_hidden_values(spark):
    cells = surface((1, 2, 3, 4))
    masks = MASKS(F.col("u"), F.col("v"))
    fills = surfaces.FILLS
    df = spark.createDataFrame(cells, SURFACE)
    got = surfaces.gap_predictions(df, "unit", "block", masks, "value").collect()
    turned = df.withColumn("value", F.when((F.col("unit") == 1) & masks["half_plane"], 1000.0).otherwise(F.col("value")))
    own = lambda rows: sorted((r["gi"], r["gj"], *[r[f] for f in fills]) for r in rows if r["unit"] == 1 and r["mask"] == "half_plane")
    after = surfaces.gap_predictions(turned, "unit", "block", masks, "value").collect()
    assert own(got) and own(got) == own(after)
    value = {(c[0], c[2], c[3]): c[6] for c in cells}
    r = next(r for r in got if r["unit"] == 1 and r["mask"] == "quadrant")
    at = (r["gi"], r["gj"])
    assert r["uncalibrated"] == np.median([value[u, *at] for u in (2, 3)])  # block 1 has units 1 and 4
    keep = [c for c in cells if c[0] == 1 and not (c[4] > 0 and c[5] > 0)]
    t = np.array([np.median([value[u, c[2], c[3]] for u in (2, 3)]) for c in keep])
    y = np.array([c[6] for c in keep])
    slope = ((t - t.mean()) @ (y - y.mean())) / (((t - t.mean()) ** 2).sum() + 0.1)
    assert abs(r["template"] - (y.mean() + slope * (r["uncalibrated"] - t.mean()))) < 1e-9 and r["visible"] == len(keep)
    q = lambda a, b: np.array([a, b, a * a, b * b, a * b])
    x = np.array([q(c[4], c[5]) for c in keep])
    z = (x - x.mean(0)) / x.std(0)
    b = np.linalg.solve(z.T @ z + 0.1 * np.eye(5), z.T @ (y - y.mean()))
    assert abs(r["quadratic"] - (y.mean() + (q(at[0] / 6 - 1, at[1] / 6 - 1) - x.mean(0)) / x.std(0) @ b)) < 1e-9


def test_unfolded_plane_is_flat_and_edge_region_is_connected(spark):
    plane = spark.createDataFrame([(i * 10 + j, float(i), float(j), 0.5 * i - j) for i in range(10) for j in range(10)], "id long, x double, y double, z double")
    assert max(abs(r["height"]) for r in surfaces.unfolded_patch(plane, "id", 55, 4.0).collect()) < 1e-9
    cells = spark.createDataFrame([(i, j, k, 1.0 if (i < 3) == (k > 1) and not (i == 4 and j == 0) else 9.0) for i in range(5) for j in range(2) for k in range(4)], "i long, j long, k long, value double")
    got = {(r["i"], r["j"]): r["top"] for r in surfaces.edge_region(cells, 5.0, (0, 0, 3)).collect()}
    assert got[0, 0] == 2 and got.get((3, 0)) == 0


def test_crop_stays_inside(spark):
    mask = spark.createDataFrame([(i, j, k) for i in range(12) for j in range(12) for k in range(3 if (i, j) != (6, 6) else 9)], "i long, j long, k int")
    r = surfaces.automatic_crop(mask, 1.0, (6, 6)).first()
    assert (r["ci"], r["cj"]) == (6, 6) and 0 <= r["lo_i"] <= 6 and 0 <= r["lo_j"] <= 6


def test_plates_equal_the_whole_system():
    """Every smoothing against the one linear system that defines it."""
    rnd = np.random.default_rng(5)
    p, v, q = rnd.random((3, 20, 2)), rnd.random((3, 20)), rnd.random((3, 2))
    got = surfaces.plates(p, v, q, (0.01, 10.0))
    kernel = lambda d2: 0.5 * d2 * np.log(np.maximum(d2, 1e-300))
    for n in range(3):
        m = p[n].mean(0)
        s = np.abs(p[n] - m).max()
        z, y = (p[n] - m) / s, (q[n] - m) / s
        line = np.column_stack([np.ones(20), z])
        for j, smooth in enumerate((0.01, 10.0)):
            a = np.block([[kernel(((z[:, None] - z) ** 2).sum(-1)) + smooth * np.eye(20), line], [line.T, np.zeros((3, 3))]])
            w = np.linalg.solve(a, np.append(v[n], [0, 0, 0]))
            assert abs(kernel(((z - y) ** 2).sum(-1)) @ w[:20] + w[20] + y @ w[21:] - got[n, j]) < 1e-8
    assert np.abs(surfaces.plates(np.stack([np.linspace(0, 1, 9)[:, None] * [1, 2]]), np.linspace(0, 1, 9)[None], np.array([[0.5, 1.0]]), (0.1,)) - 0.5).max() < 1e-8


def test_smoothing_is_tuned_without_the_fold(spark):
    """Noise about a plane takes the largest smoothing, a wave the smallest; predictions equal refits over all other blocks' k nearest."""
    rnd = np.random.default_rng(9)
    rows = [(i, i % 3, float(x), float(y), float(x + rnd.normal())) for i, (x, y) in enumerate(rnd.random((60, 2)))]
    smoothings = (0.01, 1.0, 100.0)
    df = spark.createDataFrame([*rows, (99, None, 0.5, 0.5, 1.0), (98, 1, 0.5, 0.5, None)], "id long, b int, x double, y double, value double")
    got = surfaces.tuned_thin_plate(df, "id", "value", "b", 12, smoothings).collect()
    assert len(got) == 60 and {r["query_id"] for r in got} == set(range(60))

    def guess(r, out):
        near = sorted((float(np.hypot(r[2] - o[2], r[3] - o[3])), o[0]) for o in rows if o[1] not in out)[:12]
        s = np.array([rows[i][2:] for _, i in near])
        return surfaces.plates(s[None, :, :2], s[None, :, 2], np.array([r[2:4]]), smoothings)[0]

    for fold in range(3):
        losses = np.mean([np.abs(guess(r, {fold, r[1]}) - r[4]) for r in rows if r[1] != fold], 0)
        place = int(losses.argmin())
        for r in got:
            if r["block"] == fold:
                assert r["smoothing"] == smoothings[place] and abs(r["prediction"] - guess(rows[r["query_id"]], {fold})[place]) < 1e-8


def test_neighbour_lists_of_boxes(spark):
    """Lists of a query and a box hold its k nearest points with what they carry, over several boxes; copies, groups, a query beyond all points."""
    from holdfast.operators import boxes, spatial

    rnd = np.random.default_rng(12)
    p = [(i % 2, i, float(x), float(y), float(-i)) for i, (x, y) in enumerate(rnd.random((3000, 2)))]
    p += [(0, 3000 + i, p[0][2], p[0][3], 1.0) for i in range(20)]
    q = [(g, i, float(x), float(y)) for i, (x, y) in enumerate([*rnd.random((40, 2)), (9.0, 9.0), p[0][2:4]]) for g in (0, 1)]
    sites, asks = spark.createDataFrame(p, "g int, neighbour_id long, p_x double, p_y double, p_v double"), spark.createDataFrame(q, "g int, query_id long, q_x double, q_y double")
    tree = spatial.tree_of(sites, 7, ["x", "y"], ["g"])
    rows = boxes.box_search(asks, tree, 7, ["x", "y"], ["g"], False, ["v"]).collect()
    assert len(tree[0]) > 2 and len(rows) < 7 * len(q)
    got: dict = {}
    for r in rows:
        got.setdefault((r["g"], r["query_id"]), []).extend(map(tuple, r["s"]))
    assert len(got) == len(q)
    for g, i, x, y in q:
        near = sorted((float(np.sqrt((x - r[2]) ** 2 + (y - r[3]) ** 2)), *r[1:]) for r in p if r[0] == g)[:7]
        assert sorted(got[g, i])[:7] == near


def test_unfolded_stack_goes_inward(spark):
    """Layers of a flat block: the depth counts from its surface towards the side with the label, whichever it is."""
    points = spark.createDataFrame([(i * 9 + j, float(i), float(j), 4.0) for i in range(9) for j in range(9)], "id long, x double, y double, z double")
    for way in (1, -1):
        cells = spark.createDataFrame([(i, j, k, 10.0 * k, 3 if (k - 4) * way > 0 else 1) for i in range(9) for j in range(9) for k in range(9)], "i int, j int, k int, value double, label int")
        got = surfaces.unfolded_stack(points, cells, "id", 40, 2.0, 2.0, 1.0, 3, "label", 3).collect()
        assert len(got) == 5 * 5 * 4
        assert all(abs(r["value"] - 10 * (4 + way * r["depth"])) < 1e-6 and r["label"] == (3 if r["depth"] else 1) for r in got)
    with pytest.raises(ValueError, match="no point"):
        surfaces.unfolded_stack(points, cells, "id", 999, 2.0, 2.0, 1.0, 3, "label", 3)


def test_small_groups_are_matched_without_components(spark, monkeypatch):
    """Groups of few pairs equal the components' path, and no component is sought for them; keys may be text."""
    rng = np.random.default_rng(4)
    rows = [(g, f"a{rng.integers(9)}", f"b{rng.integers(9)}", round(float(rng.random()), 6)) for g in range(12) for _ in range(3 * g + 1)]
    pairs = spark.createDataFrame(rows, "g int, query_id string, neighbour_id string, distance double")
    plain = {tuple(r) for r in matching.one_to_one(pairs, ("g",), most=1000).collect()}  # groups of over 31 pairs go the other way
    monkeypatch.setattr(matching, "connected_components", lambda *_: pytest.fail("components of small groups"))
    assert {tuple(r) for r in matching.one_to_one(pairs, ("g",)).collect()} == plain and len(plain) > 30


def test_boxes_take_ids_of_several_columns(spark):
    """Structs (and arrays) as ids: neighbours, their order at equal distances and the query's own id as for plain ids."""
    from holdfast.operators import boxes, spatial

    rnd = np.random.default_rng(17)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rnd.integers(0, 12, (1500, 2)))]
    df = spark.createDataFrame(rows, "n long, x double, y double").withColumn("id", F.struct(F.floor(F.col("n") / 7).alias("a"), F.array(F.col("n") % 7).alias("b")))

    def found(key, own):
        sites = df.select(F.col(key).alias("neighbour_id"), F.col("x").alias("p_x"), F.col("y").alias("p_y"))
        asks = df.where("n % 50 = 0").select(F.col(key).alias("query_id"), F.col("x").alias("q_x"), F.col("y").alias("q_y"))
        got = spatial.searched(asks, spatial.tree_of(sites, 9 + own, ["x", "y"], []), 9, ["x", "y"], [], own)
        plain = (lambda c: F.col(f"{c}.a") * 7 + F.col(f"{c}.b")[0]) if key == "id" else F.col
        return sorted(map(tuple, got.select(plain("query_id"), plain("neighbour_id"), "distance", "rank").collect()))

    for own in (False, True):
        assert found("id", own) == found("n", own) and len(found("n", own)) == 30 * 9
    assert boxes.plain({"a": None, "b": 1}) < boxes.plain({"a": 1.0, "b": 0}) < boxes.plain({"a": float("nan"), "b": 0})
