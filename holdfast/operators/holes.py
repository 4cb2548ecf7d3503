"""Missing members of point lattices and triangulation neighbours (inventory H12, H13, H15, H16, H19).

Candidates are circumcentres of triples of points whose circle holds no point: the corners between three
regions of influence. Each point's region is cut out of a box by the bisectors towards its nearest neighbours; around every corner
of it, those on the box too, points are looked for that are nearer than the region's own point. Their bisectors
cut the region again, until no corner has such a point. Then all corners are right, so the (convex) regions are, and no circle is
missing, however wide the gaps between clusters. Points at one place count once, with the lowest key. Circles of radii beyond
FAR times the points' extent count as lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise
from .boxes import meeting
from .spatial import _sides, knn_join, searched, tree_of
from .windows import angular_gap


def _near(points: DataFrame, key: str, by: list[str], k: int) -> DataFrame:
    return knn_join(points, points, k, ["x", "y"], key, key, tuple(by), exclude_self=True)


FAR = 1e4  # extents
ROUND = 1e-9  # share of a radius by which points on a circle may lie beside it


def _crossing(m: tuple[float, float], n: tuple[float, float]) -> tuple[float, float] | None:
    """Where the bisectors towards m and n meet. On an edge that began as wide as the box, a place between its ends would be off by the
    box's rounding, which is more than ROUND of a small region."""
    det = m[0] * n[1] - m[1] * n[0]
    if not det:
        return None
    u, v = (m[0] * m[0] + m[1] * m[1]) / 2, (n[0] * n[0] + n[1] * n[1]) / 2
    return (u * n[1] - v * m[1]) / det, (v * m[0] - u * n[0]) / det


def region(near: list[tuple[float, float]], half: float) -> list[tuple[float, float, int, int]]:
    """Corners (x, y, and the two neighbours whose bisectors meet there, -1: the box) of the region of a point at 0, 0 within
    a box. near: neighbours, nearest first."""
    ring = [(-half, -half, -1), (half, -half, -1), (half, half, -1), (-half, half, -1)]  # a corner, and what the side after it is of
    for i, (nx, ny) in enumerate(near):
        middle = (nx * nx + ny * ny) / 2
        side = [nx * x + ny * y - middle for x, y, _ in ring]
        if max(side) <= 0:
            if middle > 2 * max(x * x + y * y for x, y, _ in ring):
                break  # farther than twice the farthest corner, and so are all that follow
            continue
        cut = []
        for j, (x, y, of) in enumerate(ring):
            (x2, y2, _), s, s2 = ring[(j + 1) % len(ring)], side[j], side[(j + 1) % len(ring)]
            if s <= 0:
                cut.append((x, y, of))
            if (s <= 0) != (s2 <= 0):
                t = s / (s - s2)
                spot = _crossing(near[of], (nx, ny)) if of >= 0 else None
                cut.append((*(spot or (x + t * (x2 - x), y + t * (y2 - y))), i if s <= 0 else of))
        ring = cut
    return [(x, y, ring[j - 1][2], of) for j, (x, y, of) in enumerate(ring)]


def corners(near: DataFrame, by: list[str], half: float) -> DataFrame:
    """(by, a, b, c, x, y, r, no): all regions' corners. near: by, a, ax, ay, near (array of struct n, x, y). b and c are null on the box."""
    kind = near.schema["a"].dataType
    schema = T.StructType([*[near.schema[c] for c in by], *[T.StructField(n, kind) for n in "abc"], *[T.StructField(n, T.DoubleType()) for n in "xyr"], T.StructField("no", T.IntegerType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):  # a short list of neighbours each
                ax, ay = row["ax"], row["ay"]
                own = sorted(row["near"], key=lambda n: ((n["x"] - ax) ** 2 + (n["y"] - ay) ** 2, n["n"]))
                ids = [n["n"] for n in own] + [None]
                for no, (x, y, i, j) in enumerate(region([(n["x"] - ax, n["y"] - ay) for n in own], half)):
                    out.append((*(row[c] for c in by), row["a"], ids[i], ids[j], ax + x, ay + y, float(np.hypot(x, y)), no))
            frame = pd.DataFrame(out, columns=schema.names)
            yield frame.astype({"b": "Int64", "c": "Int64"}) if isinstance(kind, (T.LongType, T.IntegerType)) else frame

    return near.mapInPandas(run, schema)


def places_of(points: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(by, x, y, a): each place once, with its lowest key; points without a place are left out."""
    whole = F.col("x").isNotNull() & F.col("y").isNotNull()
    return materialise(points.where(whole).groupBy(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min(key).alias("a")))


def box_of(places: DataFrame) -> float:
    ends = places.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    return FAR * (max(ends[0] or 0.0, ends[1] or 0.0) or 1.0)


def cutters(lists: DataFrame, tree: tuple, by: list[str], half: float) -> DataFrame:
    """(by, a, more): for the regions of `lists` that places of the tree's boxes cut, the places that they lack, all at once. A
    region meets every box that a circle around one of its corners reaches, and takes from each the places on the border of its region
    among them: a place on the border of the whole region is on that of every part of the places that has it."""
    table, points = tree
    sent, group = lists.sparkSession.sparkContext.broadcast(table), F.xxhash64(*by) if by else F.lit(0).cast("long")
    kind, place = dict(lists.dtypes)["a"], dict(points.dtypes)["neighbour_id"]
    rows = lists.select(group.alias("hf_g"), "a", "ax", "ay", (F.transform("near", lambda n: n["x"] - F.col("ax"))).alias("nx"), (F.transform("near", lambda n: n["y"] - F.col("ay"))).alias("ny"))

    def opening(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = sent.value
        for frame in frames:
            out = []
            for g, a, ax, ay, nx, ny in frame.itertuples(index=False):
                mine = every[np.searchsorted(every["g"], g) : np.searchsorted(every["g"], g, "right")]
                ring = np.array([c[:2] for c in region(sorted(zip(nx, ny, strict=True), key=lambda n: n[0] ** 2 + n[1] ** 2), half)])
                x, d = ring + (ax, ay), np.zeros((len(ring), len(mine)))
                for i in range(2):
                    d += np.maximum(np.maximum(mine["lo"][:, i] - x[:, i, None], x[:, i, None] - mine["hi"][:, i]), 0) ** 2
                reached = (np.sqrt(d) * (1 - 1e-12) < np.hypot(*ring.T)[:, None]).any(axis=0)
                out += [(g, a, ax, ay, nx, ny, ring[:, 0], ring[:, 1], leaf) for leaf in mine["leaf"][reached]]
            yield pd.DataFrame(out, columns=["hf_g", "a", "ax", "ay", "nx", "ny", "cx", "cy", "hf_leaf"])

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        ids, p, out = held["neighbour_id"].to_numpy(), held[["p_x", "p_y"]].to_numpy(float), []
        for g, a, ax, ay, nx, ny, cx, cy in asked[["hf_g", "a", "ax", "ay", "nx", "ny", "cx", "cy"]].itertuples(index=False):
            own = p - (ax, ay)
            far = np.hypot(own[:, 0] - cx[:, None], own[:, 1] - cy[:, None])
            cut = (far < np.hypot(cx, cy)[:, None] * (1 - ROUND)).any(axis=0).nonzero()[0]
            if len(cut):
                both = sorted([(x, y, -1) for x, y in zip(nx, ny, strict=True)] + [(*own[i], i) for i in cut], key=lambda n: n[0] ** 2 + n[1] ** 2)
                on = {both[i][2] for corner in region([n[:2] for n in both], half) for i in corner[2:] if i >= 0} - {-1}
                out += [(g, a, ids[i], p[i, 0], p[i, 1]) for i in sorted(on)]
        return pd.DataFrame(out, columns=["hf_g", "a", "n", "x", "y"])

    opened = rows.mapInPandas(opening, f"hf_g long, a {kind}, ax double, ay double, nx array<double>, ny array<double>, cx array<double>, cy array<double>, hf_leaf int")
    found = meeting(opened, "a", points, ["x", "y"], meet, f"hf_g long, a {kind}, n {place}, x double, y double")
    more = found.groupBy("hf_g", "a").agg(F.collect_set(F.struct("n", "x", "y")).alias("more"))
    return lists.select(*by, "a", group.alias("hf_g")).join(more, ["hf_g", "a"]).drop("hf_g")


def certified(lists: DataFrame, places: DataFrame, by: list[str], half: float, tree: tuple, rounds: int = 100) -> DataFrame:
    """(by, t: three keys in order) of all corners of the regions of `lists` (see corners). tree: of all places (a list may have more). A region that
    lacks places is cut again: by all of them at once where boxes are at hand, else by the nearest place of each corner."""
    first = lambda found: searched(_sides(found, places, ["x", "y"], "hf_c", "a", by)[0], tree, 1, ["x", "y"], by, False).withColumnRenamed("query_id", "hf_c")
    at = places.select(*by, F.col("a").alias("neighbour_id"), F.struct(F.col("a").alias("n"), "x", "y").alias("one"))
    done = []
    for _ in range(rounds):
        found = materialise(corners(lists, by, half).withColumn("hf_c", F.struct("a", "no")))
        if len(tree) == 2:
            more = cutters(lists, tree, by, half)
        else:
            nearer = found.join(first(found), [*by, "hf_c"]).where(F.col("distance") < F.col("r") * (1 - ROUND))
            more = (nearer.select(*by, "a", "neighbour_id").distinct().join(at, [*by, "neighbour_id"]).groupBy(*by, "a").agg(F.collect_set("one").alias("more")))
        more = materialise(more)
        done.append(found.where("b is not null and c is not null").join(more, [*by, "a"], "left_anti").select(*by, F.array_sort(F.array("a", "b", "c")).alias("t")))
        if more.isEmpty():
            return reduce(DataFrame.unionByName, done).distinct()
        lists = materialise(lists.join(more, [*by, "a"]).select(*by, "a", "ax", "ay", F.array_union("near", "more").alias("near")))
    raise RuntimeError("regions did not settle")


def circles(points: DataFrame, key: str, by: tuple[str, ...] = (), k: int = 12, half: float | None = None) -> DataFrame:
    """(by, a, b, c, x, y, radius): all empty circles through three points (of four or more on one circle every three). half: the box, if not that of the points."""
    by = list(by)
    places = places_of(points, key, by)
    at = places.select(*by, F.col("a").alias("neighbour_id"), F.struct(F.col("a").alias("n"), "x", "y").alias("one"))
    near = knn_join(places, places, k, ["x", "y"], "a", "a", tuple(by), exclude_self=True).join(at, [*by, "neighbour_id"])
    own = places.select(*by, "a", F.col("x").alias("ax"), F.col("y").alias("ay"))
    lists = materialise(own.join(near.groupBy(*by, F.col("query_id").alias("a")).agg(F.collect_set("one").alias("near")), [*by, "a"]))
    tree = tree_of(_sides(places, places, ["x", "y"], "a", "a", by)[1], 1, ["x", "y"], by)
    found = _circumcircles(certified(lists, places, by, half or box_of(places), tree), places, by)
    return _all_threes(found, places, by)


def _circumcircles(triples: DataFrame, places: DataFrame, by: list[str]) -> DataFrame:
    t = triples.select(*by, *[F.get("t", F.lit(i)).alias(n) for i, n in enumerate("abc")])
    for n in "abc":
        t = t.join(places.select(*by, F.col("a").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")), [*by, n])
    bx, by_, cx, cy = (F.col(f"{d}{p}") - F.col(f"{d}a") for p in "bc" for d in "xy")
    det = 2 * (bx * cy - by_ * cx)
    ok = F.when(F.abs(det) > 1e-12, det)
    b2, c2 = bx * bx + by_ * by_, cx * cx + cy * cy
    ux, uy = (cy * b2 - by_ * c2) / ok, (bx * c2 - cx * b2) / ok
    return materialise(t.select(*by, "a", "b", "c", (F.col("xa") + ux).alias("x"), (F.col("ya") + uy).alias("y"), F.sqrt(ux * ux + uy * uy).alias("radius")).where("radius is not null"))


def _all_threes(found: DataFrame, places: DataFrame, by: list[str]) -> DataFrame:
    """Circles with every three of the points on them: where more than three are, other threes have that circle too."""
    on, left, k = [], found.withColumn("hf_c", F.struct("a", "b", "c")), 6
    while True:
        near = knn_join(left, places, k, ["x", "y"], "hf_c", "a", tuple(by)).withColumnRenamed("query_id", "hf_c")
        near = near.join(left.select(*by, "hf_c", "radius"), [*by, "hf_c"]).where(F.col("distance") <= F.col("radius") * (1 + ROUND))
        sets = materialise(near.groupBy(*by, "hf_c").agg(F.array_sort(F.collect_list("neighbour_id")).alias("ids")))
        on.append(sets.where(F.size("ids") < k))
        if (rest := sets.where(F.size("ids") >= k)).isEmpty():
            break
        left, k = left.join(rest.select(*by, "hf_c"), [*by, "hf_c"]), 2 * k
    sets = on[0]
    for s in on[1:]:
        sets = sets.unionByName(s)
    four = materialise(sets.where(F.size("ids") > 3).select(*by, "ids").distinct())
    if four.isEmpty():
        return found
    kind = four.schema["ids"].dataType.elementType

    @F.udf(T.ArrayType(T.ArrayType(kind)))
    def threes(ids):
        return [list(t) for t in combinations(ids, 3)]

    more = _circumcircles(four.select(*by, F.explode(threes("ids")).alias("t")).distinct(), places, by)
    return found.unionByName(more.join(found.select(*by, "a", "b", "c"), [*by, "a", "b", "c"], "left_anti"))


def hole_candidates(points: DataFrame, key: str, by: tuple[str, ...] = (), k: int = 12, around: int = 6, gap: float = 150.0) -> DataFrame:
    """(by, x, y, radius, score): circle centres whose six nearest points leave no angular gap over `gap`; score is
    the radius over the local spacing (median nearest distance of those six)."""
    by = list(by)
    c = circles(points, key, tuple(by), k).groupBy(*by, F.round("x", 9).alias("x"), F.round("y", 9).alias("y")).agg(F.max("radius").alias("radius"))
    c = materialise(c.withColumn("hf_c", F.xxhash64(*by, "x", "y")))
    spacing = _near(points, key, by, 1).select(*by, F.col("query_id").alias("neighbour_id"), F.col("distance").alias("nn"))
    near = knn_join(c, points, around, ["x", "y"], "hf_c", key, tuple(by)).withColumnRenamed("query_id", "hf_c")
    at = points.select(*by, F.col(key).alias("neighbour_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    rows = near.join(spacing, [*by, "neighbour_id"]).join(at, [*by, "neighbour_id"]).join(c.select("hf_c", "x", "y"), "hf_c")
    rows = rows.withColumn("t", F.atan2(F.col("py") - F.col("y"), F.col("px") - F.col("x")))
    turn = angular_gap(rows, ["hf_c"], "t").where((F.degrees("max_gap") <= gap) & (F.col("neighbours") >= around))
    local = rows.groupBy("hf_c").agg(F.median("nn").alias("spacing"))
    return c.join(turn, "hf_c").join(local, "hf_c").select(*by, "x", "y", "radius", F.try_divide("radius", "spacing").alias("score"))


def hole_score(six: Column, x: Column, y: Column, radius: Column, around: int, gap: float) -> Column:
    """The score of hole_candidates from the nearest points themselves (six: array of struct with px, py and nn); null where they are
    fewer than `around`, leave a wider gap, or have no spacing."""
    turn = F.array_sort(F.transform(six, lambda n: F.atan2(n["py"] - y, n["px"] - x)))
    after = F.concat(F.slice(turn, 2, around), F.array(F.get(turn, F.lit(0)) + 2 * np.pi))
    widest = F.array_max(F.zip_with(after, turn, lambda b, a: b - a))
    nn = F.array_sort(F.transform(six, lambda n: n["nn"]))
    middle = (F.get(nn, F.lit((around - 1) // 2)) + F.get(nn, F.lit(around // 2))) / 2
    return F.when((F.size(six) >= around) & (F.degrees(widest) <= gap), F.try_divide(radius, middle))


def greedy_insertion(points: DataFrame, key: str, trial: str, steps: int, k: int = 12, around: int = 6, gap: float = 150.0) -> DataFrame:
    """(trial, step, x, y, score): the strongest hole of each trial (ties: smallest x, then y) is filled, `steps` times; trials without
    a hole end.

    Circles are searched once. After that a new point takes away the circles that hold it, and all new ones go through it:
    only its own region is cut out, from the corners of the circles taken away, and certified. Each centre keeps its nearest
    points with their spacings, so scores are updated row by row; a step reads the trial's rows once for the new points."""
    by, d = [trial], lambda x, y: F.hypot(F.col("x") - F.col(x), F.col("y") - F.col(y))
    now = points.select(trial, F.col(key).cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    lowest = min(now.agg(F.min("id")).first()[0] or 0, 0)
    spacing = _near(now, "id", by, 1).select(trial, F.col("query_id").alias("id"), F.col("distance").alias("nn"))
    now = materialise(now.join(spacing, [trial, "id"], "left"))
    places = places_of(now, "id", by)
    half, round_ = box_of(places), materialise(circles(now, "id", (trial,), k))
    tree = tree_of(_sides(places, places, ["x", "y"], "a", "a", by)[1], 1, ["x", "y"], by)  # without what is put in: that is in the lists
    before = places.where(F.lit(False))
    six = F.array_sort(F.collect_list(F.struct("distance", F.col("neighbour_id").alias("id"), "px", "py", "nn"))).alias("six")
    at = lambda rows: rows.select(trial, F.col("id").alias("neighbour_id"), F.col("x").alias("px"), F.col("y").alias("py"), "nn")
    centres = lambda c: c.groupBy(trial, F.round("x", 9).alias("x"), F.round("y", 9).alias("y")).agg(F.max("radius").alias("radius")).withColumn("hf_c", F.struct("x", "y"))
    c = materialise(centres(round_))
    near = knn_join(c, now, around, ["x", "y"], "hf_c", "id", (trial,)).withColumnRenamed("query_id", "hf_c").join(at(now), [trial, "neighbour_id"])
    c = materialise(c.join(near.groupBy(trial, "hf_c").agg(six), [trial, "hf_c"]))
    out = []
    for i in range(1, steps + 1):
        scored = c.withColumn("score", hole_score(F.col("six"), F.col("x"), F.col("y"), F.col("radius"), around, gap)).where("score is not null")
        best = scored.groupBy(trial).agg(F.max(F.struct("score", (-F.col("x")).alias("nx"), (-F.col("y")).alias("ny"))).alias("m"))
        new = materialise(best.select(trial, F.lit(lowest - i).cast("long").alias("new"), (-F.col("m.nx")).alias("sx"), (-F.col("m.ny")).alias("sy"), F.col("m.score").alias("score")))
        out.append(new.select(trial, F.lit(i).alias("step"), F.col("sx").alias("x"), F.col("sy").alias("y"), "score"))
        if i == steps or new.isEmpty():
            break
        spot = new.drop("score")
        beside = now.join(spot, trial).withColumn("d", d("sx", "sy"))
        own = materialise(beside.groupBy(trial, "new", "sx", "sy").agg(F.min("d").alias("own")))  # a new point's spacing
        now = now.join(spot, trial, "left").withColumn("nn", F.least("nn", d("sx", "sy"))).select(trial, "id", "x", "y", "nn")
        now = materialise(now.unionByName(own.select(trial, F.col("new").alias("id"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("own").alias("nn"))))
        places = materialise(places.unionByName(spot.select(trial, F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("new").alias("a"))))

        held = round_.join(spot, trial, "left").withColumn("hf_d", F.coalesce(d("sx", "sy"), F.lit(float("inf"))))
        ends = held.where(F.col("hf_d") <= F.col("radius") * (1 + ROUND)).select(trial, F.col("new").alias("own"), "sx", "sy", F.explode(F.array("a", "b", "c")).alias("a")).distinct()
        ends = ends.join(places, [trial, "a"]).groupBy(trial, "own", "sx", "sy").agg(F.collect_set(F.struct(F.col("a").alias("n"), "x", "y")).alias("near"))
        before = before.unionByName(spot.select(trial, F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("new").alias("a")))
        others = before.groupBy(trial).agg(F.collect_list(F.struct(F.col("a").alias("n"), "x", "y")).alias("put"))  # a few
        ends = ends.join(others, trial).withColumn("near", F.filter(F.array_union("near", "put"), lambda n: n["n"] != F.col("own")))
        lists = materialise(ends.select(trial, F.col("own").alias("a"), F.col("sx").alias("ax"), F.col("sy").alias("ay"), "near"))

        more = _circumcircles(certified(lists, places, by, half, tree), places, by)
        round_ = materialise(held.where(F.col("hf_d") >= F.col("radius") * (1 - ROUND)).select(*round_.columns).unionByName(more))

        kept = c.join(own, trial, "left").withColumn("hf_d", d("sx", "sy")).where(F.col("new").isNull() | (F.col("hf_d") >= F.col("radius") * (1 - ROUND)))
        nearer = F.transform("six", lambda n: n.withField("nn", F.least(n["nn"], F.hypot(n["px"] - F.col("sx"), n["py"] - F.col("sy")))))
        added = F.array(F.struct(F.col("hf_d").alias("distance"), F.col("new").alias("id"), F.col("sx").alias("px"), F.col("sy").alias("py"), F.col("own").alias("nn")))
        kept = kept.withColumn("six", F.when(F.col("new").isNull(), F.col("six")).otherwise(F.slice(F.array_sort(F.concat(nearer, added)), 1, around))).select(*c.columns)
        fresh = materialise(centres(more).join(kept.select(trial, "hf_c"), [trial, "hf_c"], "left_anti"))
        pairs = at(now).join(fresh, trial).withColumn("distance", d("px", "py"))
        rank = F.row_number().over(Window.partitionBy(trial, "hf_c").orderBy("distance", "neighbour_id"))
        top = pairs.withColumn("hf_r", rank).where(F.col("hf_r") <= around).groupBy(trial, "hf_c", "x", "y", "radius").agg(six)
        c = materialise(kept.unionByName(top.select(*c.columns)))
    return reduce(DataFrame.unionByName, out)


def triangulation_edges(points: DataFrame, key: str, by: tuple[str, ...] = (), ratio: float = 1.6) -> DataFrame:
    """(by, a, b, length): sides of empty-circle triples, at most ratio times the median nearest distance long."""
    by = list(by)
    near = _near(points, key, by, 1).groupBy(*by).agg(F.median("distance").alias("nn"))
    t = circles(points, key, tuple(by))
    e = t.select(*by, F.explode(F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))])).alias("e")).select(*by, "e.*").distinct()
    at = lambda n: points.select(*by, F.col(key).alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    e = e.join(at("a"), [*by, "a"]).join(at("b"), [*by, "b"]).withColumn("length", F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")))
    e = e.join(near, by) if by else e.crossJoin(F.broadcast(near))
    return e.where(F.col("length") <= ratio * F.col("nn")).select(*by, "a", "b", "length")


def hull_area(directions: DataFrame, by: list[str], u: str, v: str, buckets: int = 64) -> DataFrame:
    """(by, corners, area) of the convex hull on a chart. A corner is extreme in some direction, and lies between
    the extremes of neighbouring directions: of each of `buckets` directions only rows beyond the chord of its
    two extremes are kept, so few rows of a group reach its hull."""
    ways = [(np.cos(2 * np.pi * i / buckets), np.sin(2 * np.pi * i / buckets)) for i in range(buckets)]
    kinds = dict(directions.dtypes)
    tops = directions.groupBy(*by).agg(*[F.max_by(F.struct(F.col(u).alias("u"), F.col(v).alias("v")), F.col(u) * float(a) + F.col(v) * float(b)).alias(f"w{i}") for i, (a, b) in enumerate(ways)])
    d = directions.select(*by, F.col(u).alias("u"), F.col(v).alias("v")).join(tops, by)
    outside = F.lit(False)
    for i in range(buckets):
        p, q = F.col(f"w{i}"), F.col(f"w{(i + 1) % buckets}")
        outside = outside | ((q["u"] - p["u"]) * (F.col("v") - p["v"]) - (q["v"] - p["v"]) * (F.col("u") - p["u"]) <= 0)
    kept = d.where(outside).select(*by, "u", "v").distinct()

    def hull(frame: pd.DataFrame) -> pd.DataFrame:
        pts = sorted(set(zip(frame["u"], frame["v"], strict=True)))

        def half(seq):
            out: list = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        ring = half(pts) + half(pts[::-1]) if len(pts) > 2 else pts
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 if len(ring) > 2 else 0.0
        return pd.DataFrame([[*(frame[c].iloc[0] for c in by), len(ring), area]], columns=[*by, "corners", "area"])

    return kept.groupBy(*by).applyInPandas(hull, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "corners int, area double"]))


def torn_edges(points: DataFrame, key: str, ring: DataFrame, size: int, around: int = 6, gap: float = 180.0) -> DataFrame:
    """(trial, rank): consecutive ring nodes (ring: place, node) are taken away for every start; the rank, by
    score, of the candidate nearest the lost nodes' centre. Trials run together.

    Circles, nearest points and scores of all points are found once. A trial loses the circles through its lost nodes; new ones hold such a node and
    go through nodes that shared circles with them, so the circles of these few (and of theirs) have all that are new. Scores are found anew where one of the
    nearest points is lost or has lost its own nearest point."""
    from .windows import cyclic_windows

    p = materialise(points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    lost = materialise(cyclic_windows(ring.withColumn("one", F.lit(1)), ["one"], "place", "node", size).select(F.col("start").cast("long").alias("trial"), F.col("member").alias(key)).distinct())
    trials = lost.select("trial").distinct()
    centre = lost.join(p, key).groupBy("trial").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    places = places_of(p, key, [])
    there = places.join(p, ["x", "y"]).select("a", key)  # all points of a place
    full = there.groupBy("a").agg(F.count("*").alias("n"))
    gone = lost.join(there, key).groupBy("trial", "a").agg(F.count("*").alias("m")).join(full, "a").where("m = n").join(places, "a")
    gone = materialise(gone.select("trial", "a", F.col("x").alias("gx"), F.col("y").alias("gy")))

    base = materialise(circles(p, key))
    ends = lambda rows: rows.select("*", F.explode(F.array("a", "b", "c")).alias("end"))
    some = gone.select("trial", F.col("a").alias("end"))
    for _ in range(2):  # the lost nodes' neighbours, and theirs
        some = materialise(ends(ends(base).join(some, "end").drop("end")).select("trial", "end").distinct())
    few = some.withColumnRenamed("end", "a").join(gone.select("trial", "a"), ["trial", "a"], "left_anti").join(places, "a").select("trial", F.col("a").alias(key), "x", "y")
    holds = F.hypot(F.col("x") - F.col("gx"), F.col("y") - F.col("gy")) < F.col("radius") * (1 - ROUND)
    new = circles(few, key, ("trial",), half=box_of(places))
    new = materialise(new.join(gone.select("trial", "gx", "gy"), "trial").where(holds).select(*new.columns).distinct())

    rounded = lambda c: c.withColumns({"x": F.round("x", 9), "y": F.round("y", 9)}).withColumn("hf_c", F.xxhash64("x", "y"))
    centres = lambda c, *by: c.groupBy(*by, "hf_c", "x", "y").agg(F.max("radius").alias("radius"))
    base, new = materialise(rounded(base)), rounded(new)
    all_ = materialise(centres(base))
    cut = materialise(ends(base).join(gone.select("trial", F.col("a").alias("end")), "end").select("trial", "hf_c", "a", "b", "c").distinct())
    hit = materialise(cut.select("trial", "hf_c").unionByName(new.select("trial", "hf_c")).distinct())
    kept = base.join(hit, "hf_c").join(cut, ["trial", "hf_c", "a", "b", "c"], "left_anti")
    patch = materialise(centres(kept.select(new.columns).unionByName(new), "trial"))

    own = materialise(_near(p, key, [], 1 + size).select(F.col("query_id").alias("neighbour_id"), F.col("neighbour_id").alias("other"), F.col("distance").alias("nn"), F.col("rank").alias("no")))
    most = lambda c: materialise(knn_join(c, p, around + size, ["x", "y"], "hf_c", key).withColumnRenamed("query_id", "hf_c"))
    near = most(all_)
    away = lost.withColumnRenamed(key, "neighbour_id")
    bare = own.where("no = 1").join(lost.withColumnRenamed(key, "other"), "other").select("trial", "neighbour_id").unionByName(away.select("trial", "neighbour_id"))
    moved = near.where(F.col("rank") <= around).join(bare.distinct(), "neighbour_id").select("trial", "hf_c").distinct()
    moved = materialise(moved.join(hit, ["trial", "hf_c"], "left_anti"))
    at = p.select(F.col(key).alias("neighbour_id"), F.col("x").alias("px"), F.col("y").alias("py"))

    def scored(rows: DataFrame, c: DataFrame, by: list[str]) -> DataFrame:
        """(by, hf_c, x, y, score) of the centres c, from rows of their nearest points with nn."""
        six = F.array_sort(F.collect_list(F.struct("distance", F.col("neighbour_id").alias("id"), "px", "py", "nn"))).alias("six")
        rows = rows.join(at, "neighbour_id").groupBy(*by, "hf_c").agg(six).join(c, [*by, "hf_c"])
        score = lambda n: hole_score(n, F.col("x"), F.col("y"), F.col("radius"), around, gap)
        closed = score(F.transform("six", lambda n: n.withField("nn", F.lit(1.0)))).isNotNull()  # a spacing of 0 leaves no score, but a candidate
        return rows.where(closed).select(*by, "hf_c", "x", "y", score(F.col("six")).alias("score"))

    again = near.join(moved, "hf_c").unionByName(most(patch.select("hf_c", "x", "y").distinct()).join(patch.select("trial", "hf_c"), "hf_c")).drop("rank").join(away, ["trial", "neighbour_id"], "left_anti")
    again = again.withColumn("rank", F.row_number().over(Window.partitionBy("trial", "hf_c").orderBy("distance", "neighbour_id"))).where(F.col("rank") <= around)
    spaced = again.join(own.select("neighbour_id", "other", "nn"), "neighbour_id").join(lost.withColumnRenamed(key, "other"), ["trial", "other"], "left_anti")
    spaced = spaced.groupBy("trial", "hf_c", "neighbour_id", "distance").agg(F.min("nn").alias("nn"))
    new_scores = scored(spaced, moved.join(all_, "hf_c").unionByName(patch.select("trial", *all_.columns)), ["trial"])
    old_scores = materialise(scored(near.where(F.col("rank") <= around).join(own.where("no = 1").select("neighbour_id", "nn"), "neighbour_id"), all_, []))
    old_scores = old_scores.crossJoin(F.broadcast(trials)).join(hit.unionByName(moved), ["trial", "hf_c"], "left_anti")  # a row for each trial
    found = old_scores.unionByName(new_scores).join(F.broadcast(centre), "trial")
    w = Window.partitionBy("trial")
    ranked = found.withColumns({"rank": F.row_number().over(w.orderBy(F.col("score").desc(), "x", "y")), "d": F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))})
    return ranked.groupBy("trial").agg(F.min_by("rank", F.struct("d", "rank")).alias("rank"), F.min("d").alias("distance"))
