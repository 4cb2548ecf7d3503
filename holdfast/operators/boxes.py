"""Exact k-nearest searches by boxes, in a fixed number of jobs whatever the points' spread.

Space is cut at medians of a bounded sample into boxes of about LEAF points; the boxes that count are the tight ones around the
points that fell in, so a bad sample costs time and no result. Each query first meets the points of its nearest box. Its k-th distance there
(or what the boxes' farthest corners promise) is a bound, and only boxes that reach within the bound are opened next. Boxes with
many queries are dealt to several tasks. What all tasks get is one row for each box, never points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

LEAF = 512  # points of a box, about
SAMPLE = 20_000  # points from which the cuts are made
MOST_BOXES = 20_000  # of all groups; with more groups the caller's other way is taken
PER_TASK = 20_000  # queries that meet a box at once
PAIRS = 2_000_000  # distances held at once


def cuts_of(sample: np.ndarray, leaves: int) -> np.ndarray:
    """Rows (dimension or -1, value, node below or at it, node over it) of a tree with about `leaves` leaves; a leaf's number is its row."""
    out: list[list[float]] = []

    def cut(rows: np.ndarray, parts: int) -> int:
        out.append([-1, 0.0, 0, 0])
        me = len(out) - 1
        width = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(sample.shape[1])
        if parts > 1 and width.max() > 0:
            d = int(width.argmax())
            at = np.median(rows[:, d])
            at = rows[rows[:, d] < rows[:, d].max(), d].max() if at >= rows[:, d].max() else at
            low = rows[:, d] <= at
            out[me] = [d, at, cut(rows[low], parts // 2), cut(rows[~low], parts - parts // 2)]
        return me

    cut(sample, leaves)
    return np.array(out, float)


def boxes_of(p: DataFrame, dims: list[str], by: list[str]) -> tuple[np.ndarray, DataFrame] | None:
    """A table of boxes (group, leaf, n, lows, highs) and the points (by, neighbour_id, p_*) with hf_g and hf_leaf; None where groups are too many."""
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")
    p = materialise(p.dropna(subset=by).withColumn("hf_g", group))
    n, groups = p.agg(F.count("*"), F.approx_count_distinct("hf_g")).first()
    if groups > MOST_BOXES // 2:
        return None
    leaves = int(min(MOST_BOXES // 2, n // LEAF) // max(1, groups))
    at = [f"p_{c}" for c in dims]
    if leaves > 1:
        picked = p.where(F.pmod(F.xxhash64(*at), F.lit(max(1, n // SAMPLE))) == 0).select(*at)
        cuts = cuts_of(np.array(sorted(map(tuple, picked.collect())), float).reshape(-1, len(dims)), leaves)
    else:
        cuts = np.array([[-1, 0.0, 0, 0]])

    @F.pandas_udf("int")
    def leaf_of(*xs: pd.Series) -> pd.Series:
        x, node = np.stack([s.to_numpy(float) for s in xs], 1), np.zeros(len(xs[0]), int)
        while len(go := (cuts[node, 0] >= 0).nonzero()[0]):
            c = cuts[node[go]]
            node[go] = np.where(x[go, c[:, 0].astype(int)] <= c[:, 1], c[:, 2], c[:, 3]).astype(int)
        return pd.Series(node)

    points = materialise(p.withColumn("hf_leaf", leaf_of(*at)))
    ends = [f(c).alias(f"{e}{c}") for e, f in (("lo", F.min), ("hi", F.max)) for c in at]
    rows = points.groupBy("hf_g", "hf_leaf").agg(F.count("*").alias("n"), *ends).orderBy("hf_g", "hf_leaf").collect()  # MOST_BOXES at most
    kinds = [("g", "i8"), ("leaf", "i4"), ("n", "i8"), ("lo", "f8", (len(dims),)), ("hi", "f8", (len(dims),))]
    m = len(dims)
    table = np.array([(r[0], r[1], r[2], r[3 : 3 + m], r[3 + m :]) for r in map(tuple, rows)], kinds)
    return table, points


def plain(id: object) -> tuple:
    """An id as a tuple with Spark's order that can be hashed: structs come as dicts, arrays as lists; nulls are first, NaN is last."""
    if id is None:
        return (0,)
    if isinstance(id, dict):
        return (1, *map(plain, id.values()))
    if isinstance(id, (list, tuple, np.ndarray)):
        return (1, *map(plain, id))
    return (2,) if id != id else (1, id)


def comparable(ids: pd.Series) -> pd.Series:
    """ids, or where they are structs or arrays what stands for them in comparisons."""
    return ids.map(plain) if ids.dtype == object and isinstance(next(iter(ids.dropna()), None), (dict, list, tuple, np.ndarray)) else ids


def box_search(q: DataFrame, tree: tuple[np.ndarray, DataFrame], k: int, dims: list[str], by: list[str], exclude_self: bool, keep: list[str] | None = None) -> DataFrame:
    """(by, query_id, neighbour_id, distance) of pairs among which are the k nearest of every query. With `keep` (columns p_* of the points,
    doubles) a row holds all pairs of a query and a box: (by, query_id, s), s an array of struct (distance, neighbour_id, dims, keep)."""
    table, points = tree
    want, at = k + exclude_self, [f"q_{c}" for c in dims]
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")
    q = materialise(q.dropna(subset=by).withColumns({"hf_g": group, "hf_q": F.monotonically_increasing_id()}))
    sent = q.sparkSession.sparkContext.broadcast(table)  # a row for each box
    listed = keep is not None
    own = ["query_id"] if exclude_self or listed else []
    own += by if listed else []
    beside = [*dims, *(keep or [])]
    kinds = dict(q.dtypes)
    asked = ", ".join(["hf_g long", "hf_q long", *(f"{c} double" for c in at), *(f"{c} {kinds[c]}" for c in own)])

    def opening(first: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            every = sent.value
            for frame in frames:
                out = []
                for g, some in frame.groupby("hf_g", sort=False):
                    mine = every[np.searchsorted(every["g"], g) : np.searchsorted(every["g"], g, "right")]
                    for a in range(0, len(some) if len(mine) else 0, step := max(1, PAIRS // max(1, len(mine)))):
                        few = some.iloc[a : a + step]
                        x = few[at].to_numpy(float)
                        gap, reach = np.zeros((2, len(few), len(mine)))
                        for d in range(len(at)):
                            below, over = mine["lo"][:, d] - x[:, d, None], x[:, d, None] - mine["hi"][:, d]
                            gap += np.maximum(np.maximum(below, over), 0) ** 2
                            reach += np.maximum(np.abs(below), np.abs(over)) ** 2
                        gap = np.sqrt(gap) * (1 - 1e-12)
                        if first:
                            order = np.argsort(reach, axis=1)
                            held = np.cumsum(mine["n"][order], axis=1) >= want
                            place = order[np.arange(len(few)), held.argmax(axis=1)]
                            bound = np.where(held[:, -1], np.sqrt(reach[np.arange(len(few)), place]) * (1 + 1e-12), np.inf)
                            near = np.lexsort((reach, gap), axis=1)[:, 0]
                            out.append(few.assign(hf_leaf=mine["leaf"][near], hf_bound=bound))
                        else:
                            row, box = ((gap <= few["hf_bound"].to_numpy()[:, None]) & (mine["leaf"] != few["hf_leaf"].to_numpy()[:, None])).nonzero()
                            out.append(few.iloc[row].assign(hf_leaf=mine["leaf"][box]))
                if out:
                    yield pd.concat(out)

        return run

    def meet(queries: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        places = places.sort_values("neighbour_id", ignore_index=True, key=comparable)  # of equal distances the lower id comes first
        y, out = places[[f"p_{c}" for c in dims]].to_numpy(float), []
        codes = pd.factorize(pd.concat([comparable(queries["query_id"]), comparable(places["neighbour_id"])], ignore_index=True))[0] if exclude_self else None
        step = max(1, PAIRS // max(1, len(y)))
        for a in range(0, len(queries) if len(y) else 0, step):
            few = queries.iloc[a : a + step]
            x = few[at].to_numpy(float)
            d = reduce(lambda s, t: s + t, [(x[:, i, None] - y[:, i]) * (x[:, i, None] - y[:, i]) for i in range(len(dims))])
            d = np.sqrt(d)
            if exclude_self:
                d[codes[a : a + len(few), None] == codes[len(queries) :]] = np.nan  # sorted behind all others
            if len(y) > k:
                least = np.partition(d, k - 1, axis=1)[:, k - 1]
                reached = np.where(np.isnan(least), np.inf, least)
            else:
                reached = np.full(len(few), np.inf)
            bound = np.minimum(reached, few["hf_bound"].to_numpy())
            row, col = (d <= bound[:, None]).nonzero()
            full = np.bincount(row, minlength=len(few))
            if full.size and full.max() > k:  # ties at the k-th place
                order = np.lexsort((col, d[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - (np.cumsum(full) - full)[row]
                row, col = row[place < k], col[place < k]
            if listed:
                full = np.bincount(row, minlength=len(few))
                lists = {n: np.split(x[col], np.cumsum(full)[:-1]) for n, x in (("neighbour_id", places["neighbour_id"].to_numpy()), *((f"p_{c}", places[f"p_{c}"].to_numpy(float)) for c in beside))}
                out.append(few[["hf_q", *own]].assign(**lists, distance=np.split(d[row, col], np.cumsum(full)[:-1]), hf_bound=bound)[names])
                continue
            out.append(pd.DataFrame({"hf_q": few["hf_q"].to_numpy()[row], "neighbour_id": places["neighbour_id"].to_numpy()[col], "distance": d[row, col], "hf_bound": bound[row]}))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    held = dict(points.dtypes)["neighbour_id"]
    schema = f"hf_q long, neighbour_id {held}, distance double, hf_bound double"
    if listed:
        schema = ", ".join(["hf_q long", *(f"{c} {kinds[c]}" for c in own), f"neighbour_id array<{held}>, distance array<double>", *(f"p_{c} array<double>" for c in beside), "hf_bound double"])
    names = [c.split()[0] for c in schema.split(", ")]
    met = lambda opened: meeting(opened, "hf_q", points, beside, meet, schema)
    firsts = materialise(q.select("hf_g", "hf_q", *at, *own).mapInPandas(opening(True), f"{asked}, hf_leaf int, hf_bound double"))
    one = met(firsts)
    bounds = one.groupBy("hf_q").agg(F.min("hf_bound").alias("hf_least"))
    closer = firsts.join(bounds.hint("merge"), "hf_q", "left").withColumn("hf_bound", F.least("hf_bound", "hf_least")).select(*firsts.columns)
    two = met(closer.mapInPandas(opening(False), f"{asked}, hf_leaf int, hf_bound double"))
    if listed:
        s = F.arrays_zip("distance", "neighbour_id", *[F.col(f"p_{c}").alias(c) for c in beside])
        return one.unionByName(two).where(F.size("distance") > 0).select(*by, "query_id", s.alias("s"))
    return one.unionByName(two).drop("hf_bound").join(q.select(*by, "query_id", "hf_q").hint("merge"), "hf_q").drop("hf_q")


def meeting(opened: DataFrame, key: str, points: DataFrame, dims: list[str], meet, schema: str) -> DataFrame:
    """meet(rows of opened, points of their box) of every box (hf_g, hf_leaf) that is opened; rows of a box go to as many tasks as their number asks for."""
    opened = materialise(opened)
    parts = materialise(opened.groupBy("hf_g", "hf_leaf").agg(F.ceil(F.count("*") / PER_TASK).alias("hf_parts")))
    asks = opened.join(F.broadcast(parts), ["hf_g", "hf_leaf"]).withColumn("hf_part", F.pmod(F.xxhash64(key), "hf_parts")).drop("hf_parts")
    held = points.select("hf_g", "hf_leaf", "neighbour_id", *[f"p_{c}" for c in dims]).join(F.broadcast(parts.withColumnRenamed("hf_parts", "hf_most")), ["hf_g", "hf_leaf"])  # a row for each box
    held = held.withColumn("hf_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hf_most") - 1))).drop("hf_most")
    on = ["hf_g", "hf_leaf", "hf_part"]
    return materialise(asks.groupBy(*on).cogroup(held.groupBy(*on)).applyInPandas(meet, schema))
