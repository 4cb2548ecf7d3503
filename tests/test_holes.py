"""Empty circles against all triples of points."""

from itertools import combinations

import numpy as np
import pytest

from holdfast.operators import holes


def brute(points):
    """Triples of distinct places (lowest id each) whose circle holds no place."""
    first = {}
    for i, x, y in sorted(points):
        first.setdefault((x, y), i)
    xy, ids = np.array(list(first)), list(first.values())
    extent = (xy.max(axis=0) - xy.min(axis=0)).max()
    found = {}
    for t in combinations(range(len(ids)), 3):
        (ax, ay), b, c = xy[t[0]], xy[t[1]] - xy[t[0]], xy[t[2]] - xy[t[0]]
        det = 2 * (b[0] * c[1] - b[1] * c[0])
        if abs(det) <= 1e-12:
            continue
        u = np.array([c[1] * (b @ b) - b[1] * (c @ c), b[0] * (c @ c) - c[0] * (b @ b)]) / det
        r = np.hypot(*u)
        if r < 1e3 * extent and np.hypot(*(xy - (u + (ax, ay))).T).min() >= r * (1 - 1e-9):
            found[tuple(sorted(ids[i] for i in t))] = r
    return found, extent


CASES = {
    "clusters": lambda d: np.concatenate([d.normal(c, 1, (16, 2)) for c in (0, 200)]),
    "ring around a hole": lambda d: np.concatenate([[(np.cos(a), np.sin(a)) for a in np.arange(7) * 2 * np.pi / 7 + 0.1], d.normal(0, 1, (20, 2)) + (5, 0)]),
    "copies": lambda d: np.concatenate([np.repeat(d.normal(0, 1, (8, 2)), 20, axis=0), d.normal(0, 3, (15, 2))]),
    "lattice": lambda d: np.array([(i, j) for i in range(5) for j in range(5)], float),
    "three": lambda d: np.array([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]),
}


@pytest.mark.parametrize("case", CASES)
def test_circles_equal_all_triples(spark, case):
    xy = CASES[case](np.random.default_rng(4))
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    df = spark.createDataFrame([(i, "g", x, y) for i, x, y in points], "id long, g string, x double, y double")
    want, extent = brute(points)
    got = {(r["a"], r["b"], r["c"]): r["radius"] for r in holes.circles(df, "id", ("g",), k=4).collect()}
    assert {t for t, r in got.items() if r < 1e3 * extent} == set(want) and want
    assert all(abs(got[t] - r) < 1e-6 * r for t, r in want.items())


def test_few_points_and_nulls(spark):
    schema = "id long, x double, y double"
    for rows in ([], [(1, 0.0, 0.0)], [(1, 0.0, 0.0), (2, 1.0, 1.0)], [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, None, 1.0)], [(i, float(i), 0.0) for i in range(6)]):
        assert holes.circles(spark.createDataFrame(rows, schema), "id").count() == 0


def recomputed(spark, points, steps):
    """Each step's strongest hole by hole_candidates over all points and those put in so far."""
    points, out = list(points), []
    for i in range(1, steps + 1):
        df = spark.createDataFrame(points, "g string, id long, x double, y double")
        best = {}
        for r in holes.hole_candidates(df, "id", ("g",)).where("score is not null").collect():
            best[r["g"]] = max(best.get(r["g"], (-1.0,)), (r["score"], -r["x"], -r["y"]))
        out += [(g, i, -nx, -ny, s) for g, (s, nx, ny) in best.items()]
        points += [(g, -i, -nx, -ny) for g, (s, nx, ny) in best.items()]
    return sorted(out)


def test_greedy_insertion_equals_recomputation(spark):
    d = np.random.default_rng(11)
    points = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(d.normal(0, 1, (60, 2)))]
    points += [("b", 100 + i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in range(6) for y in range(6) if (x, y) not in {(2, 2), (3, 3), (2, 3)})]  # a lattice: ties, points on circles
    points += [("few", 200 + i, float(i), float(i * i)) for i in range(4)] + [("copies", 300 + i, float(i % 5), float(i % 3)) for i in range(15)]
    rows = [*points, ("a", 999, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double")
    got = sorted(tuple(r) for r in holes.greedy_insertion(df, "id", "g", 3).select("g", "step", "x", "y", "score").collect())
    want = recomputed(spark, points, 3)
    assert [r[:2] for r in got] == [r[:2] for r in want] and {r[0] for r in want} >= {"a", "b"}
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], atol=1e-8)


def test_greedy_insertion_of_nothing(spark):
    assert holes.greedy_insertion(spark.createDataFrame([], "g string, id long, x double, y double"), "id", "g", 3).count() == 0


def test_small_regions_are_as_exact_as_large_ones():
    """Regions a millionth of the points' extent wide: no listed place is nearer to a corner than the region's own point."""
    rnd = np.random.default_rng(8)
    for scale in (1e-2, 1e-4, 1e-6):
        near = sorted(((float(x), float(y)) for x, y in rnd.normal(0, scale, (60, 2))), key=lambda n: n[0] ** 2 + n[1] ** 2)
        for x, y, *_ in holes.region(near, holes.FAR):
            assert min(np.hypot(x - a, y - b) for a, b in near) >= np.hypot(x, y) * (1 - holes.ROUND)


def test_torn_edges_equal_searches_of_what_is_left(spark):
    """Every trial against hole_candidates of the points without its lost nodes: scattered points, a lattice's corner, a point that shares a lost one's place."""
    rnd = np.random.default_rng(31)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate([*rnd.normal(size=(70, 2)), *[(3.0 + a, 3.0 + b) for a in range(3) for b in range(3)]])]
    rows.append((200, *rows[5][1:]))
    by_x = sorted(rows[:70], key=lambda r: r[1])
    ring = [by_x[0][0], by_x[1][0], 78, 5, by_x[30][0]]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r["trial"]: (r["rank"], r["distance"]) for r in holes.torn_edges(df, "id", spark.createDataFrame(list(enumerate(ring)), "place int, node long"), 2).collect()}
    lost = {t: (ring[t], ring[(t + 1) % 5]) for t in range(5)}
    left = spark.createDataFrame([(t, *r) for t, gone in lost.items() for r in rows if r[0] not in gone], "trial long, id long, x double, y double")
    found: dict = {}
    for r in holes.hole_candidates(left, "id", ("trial",), gap=180.0).collect():
        found.setdefault(r["trial"], []).append((r["score"], r["x"], r["y"]))
    at = {r[0]: np.array(r[1:]) for r in rows}
    assert got.keys() == found.keys()
    for t, c in found.items():
        c.sort(key=lambda s: (-s[0], *s[1:]))
        cx, cy = (at[lost[t][0]] + at[lost[t][1]]) / 2
        d = [float(np.hypot(s[1] - cx, s[2] - cy)) for s in c]
        assert abs(got[t][1] - min(d)) < 1e-9 and d[got[t][0] - 1] < min(d) + 1e-9
