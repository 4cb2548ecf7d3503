"""One-to-one matching, association and linking (inventory C07, C08, H18)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .graph import connected_components
from .ranks import beside
from .spatial import knn_join, range_join


MOST = 4_000_000  # places of the largest cost table that one task solves
SLACK = 1e-3  # of the range of costs: how far an auction's total may be from the least
MOST_ROUNDS = 2_000  # of one phase of an auction


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row in a matching of least total cost; rows <= columns (successive shortest paths)."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (now < least[1:])
            least[1:][better], back[1:][better] = now[better], j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[back[j0]]
            j0 = back[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def one_to_one(pairs: DataFrame, by: tuple[str, ...] = (), a: str = "query_id", b: str = "neighbour_id", cost: str = "distance", most: int = MOST, slack: float = SLACK) -> DataFrame:
    """(by, a, b, cost): among candidate pairs, a matching with as many pairs as possible and the least total
    cost. Groups (by) of few pairs are solved as they are. Of the others, connected components of the candidate graph are solved apart: exactly, where the cost table has
    at most `most` places; larger ones together by the distributed auction, whose total may exceed the least by `slack`
    times the range of costs. Of a pair given more than once the least cost counts; pairs with a null end, cost or NaN cost
    are no candidates. (Matching all points first and gating afterwards, as match_then_gate does, can choose other pairs.)"""
    by = list(by)
    good = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(cost).isNotNull() & ~F.isnan(F.col(cost).cast("double")))
    left = good.groupBy(*by, a, b).agg(F.min(cost).alias(cost)).withColumns({"hf_a": F.xxhash64(F.lit("a"), *by, a), "hf_b": F.xxhash64(F.lit("b"), *by, b)})
    left = materialise(left)
    alone = None
    if by:
        tall = materialise(left.groupBy(*by).agg(F.count("*").alias("hf_n")).where(F.col("hf_n") > isqrt(most)).select(*by))
        alone = solved(beside(left, tall, by, "left_anti"), by, by, a, b, cost)
        if tall.isEmpty():
            return alone
        left = materialise(beside(left, tall, by, "left_semi"))
    part = connected_components(left, "hf_a", "hf_b").select(F.col("node").alias("hf_a"), "root")
    rows = materialise(left.join(part.hint("merge"), "hf_a"))
    sides = [rows.select("root", n).distinct().groupBy("root").agg(F.count("*").alias(f"n_{n}")) for n in ("hf_a", "hf_b")]
    large = materialise(sides[0].join(sides[1], "root").where(F.col("n_hf_a") * F.col("n_hf_b") > most))
    out = solved(rows.join(large, "root", "left_anti"), ["root"], by, a, b, cost)
    out = out if alone is None else out.unionByName(alone)
    if large.isEmpty():
        return out
    rest = rows.join(large.select("root"), "root", "left_semi")
    pairs_most = large.agg(F.max(F.least("n_hf_a", "n_hf_b"))).first()[0]
    matched = auction(rest.select("hf_a", "hf_b", F.col(cost).cast("double").alias("cost")), pairs_most, slack)
    return out.unionByName(rest.join(matched, ["hf_a", "hf_b"]).select(*by, a, b, cost))


def solved(rows: DataFrame, groups: list[str], by: list[str], a: str, b: str, cost: str) -> DataFrame:
    """(by, a, b, cost): the exact matching of each of many small groups of candidate pairs. A group is one list; a task goes
    through batches of lists, as most groups are too small for a call of their own."""
    lists = rows.groupBy(*groups).agg(*[F.first(c).alias(c) for c in by if c not in groups], F.array_sort(F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(cost).alias("c")))).alias("s"))

    @F.pandas_udf("array<int>")
    def kept(a: pd.Series, b: pd.Series, cost: pd.Series) -> pd.Series:
        return pd.Series([least_pairs(list(x), list(y), np.asarray(c, float)) for x, y, c in zip(a, b, cost, strict=True)])

    own = F.transform(kept(F.col("s.a"), F.col("s.b"), F.col("s.c").cast("array<double>")), lambda i: F.get("s", i)).alias("s")
    return lists.select(*by, F.explode(F.when(F.size("s") == 1, F.col("s")).otherwise(own)).alias("s")).select(*by, F.col("s.a").alias(a), F.col("s.b").alias(b), F.col("s.c").alias(cost))


def least_pairs(a: list, b: list, cost: np.ndarray) -> list[int]:
    """Places of the pairs (a, b, cost; each once) that a matching with as many pairs as possible and the least cost has. Connected
    components are solved apart."""
    if len(a) == 1:
        return [0]
    up: dict = {}

    def top(n):
        while up.setdefault(n, n) != n:
            up[n] = n = up[up[n]]
        return n

    for x, y in zip(a, b, strict=True):
        up[top((0, x))] = top((1, y))
    parts: dict = {}
    for i, x in enumerate(a):
        parts.setdefault(top((0, x)), []).append(i)
    out = []
    for part in parts.values():
        ends = [sorted({side[i] for i in part}) for side in (a, b)]
        flip = len(ends[0]) > len(ends[1])
        rows, cols = (ends[1], ends[0]) if flip else ends
        if len(part) == 1:
            out += part
            continue
        at = [{n: i for i, n in enumerate(side)} for side in (rows, cols)]
        c = cost[part]
        table = np.full((len(rows), len(cols)), (c.max() - c.min() + 1.0) * (len(rows) + 1) + c.max())
        place = {(at[0][(b if flip else a)[i]], at[1][(a if flip else b)[i]]): i for i in part}
        for (r, k), i in place.items():
            table[r, k] = cost[i]
        out += [place[pair] for pair in enumerate(assignment(table)) if pair in place]
    return sorted(out)


def auction(edges: DataFrame, pairs_most: int, slack: float = SLACK, per_task: int = 500_000) -> DataFrame:
    """(hf_a, hf_b): a matching of the edges (hf_a, hf_b, cost; long ids that no two nodes share, edges distinct) with as
    many pairs as possible, whose total cost is at most slack times the range of costs over the least. No component may
    have more than pairs_most pairs.

    The graph is taken twice, once mirrored, and each node is joined with its mirror image at a price `lone` that no saving
    repays: so everyone can be matched, and prices may be kept while the step of the bids (epsilon) shrinks eightfold a
    phase. In a round every task auctions among the bidders of its part, all of them, until they are content with the prices
    it knows; then the highest price of each object counts, and outbid bidders bid again. Prices only rise, so what a
    task found under older prices stays within epsilon. A task holds the edges of its bidders, about per_task of them.
    With very many pairs double precision bounds the step from below, at 1e-12 of `lone`."""
    ends = edges.agg(F.min("cost"), F.max("cost"), F.count("*")).first()
    if not ends[2]:
        return edges.select("hf_a", "hf_b")
    low, width = ends[0], (ends[1] - ends[0]) or 1.0
    lone = (pairs_most + 2) * width
    cost = F.col("cost") - low
    straight = edges.select(F.col("hf_a").alias("bidder"), F.col("hf_b").alias("object"), cost.alias("cost"))
    mirrored = edges.select(F.col("hf_b").alias("bidder"), F.col("hf_a").alias("object"), cost.alias("cost"))
    nodes = materialise(straight.select(F.col("bidder").alias("object")).union(mirrored.select("bidder")).distinct())
    parts = max(1, -(-2 * ends[2] // per_task))
    selves = nodes.select(F.col("object").alias("bidder"), "object", F.lit(lone).alias("cost"))
    graph = materialise(straight.union(mirrored).union(selves).withColumn("part", F.pmod(F.xxhash64("bidder"), F.lit(parts))))
    last = max(slack * width / nodes.count(), 1e-12 * lone)
    state = nodes.select("object", F.lit(0.0).alias("price"), F.lit(None).cast("long").alias("owner"))
    step = lone / 4
    while True:
        step = max(step, last)
        state = state.withColumn("owner", F.lit(None).cast("long"))
        for _ in range(MOST_ROUNDS):
            bids = graph.join(state, "object").groupBy("part").applyInPandas(bidding(step), "object long, price double, owner long")
            best = state.union(bids).groupBy("object").agg(F.max(F.struct("price", "owner")).alias("s"))
            state = materialise(best.select("object", "s.price", "s.owner"))
            if state.where(F.col("owner").isNull()).isEmpty():
                break
        else:
            raise RuntimeError(f"the auction isn't over after {MOST_ROUNDS} rounds of one phase")
        if step <= last:
            break
        step /= 8
    return edges.select("hf_a", "hf_b").join(state.select(F.col("object").alias("hf_b"), F.col("owner").alias("hf_a")), ["hf_a", "hf_b"])


def bidding(step: float):
    """The auction of one part: from its bidders' edges with the objects' prices and owners, what it has sold at what price."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bidder", "object"], ignore_index=True)
        who, first = np.unique(frame["bidder"], return_index=True)
        things, seen, at = np.unique(frame["object"], return_index=True, return_inverse=True)
        cost, price = frame["cost"].to_numpy(float), frame["price"].to_numpy(float)[seen]
        edge = np.append(first, len(frame))
        told = frame["owner"].iloc[seen]
        here = pd.Index(who).get_indexer(told.dropna().astype("int64"))
        owner = np.full(len(things), -1)
        owner[told.notna().to_numpy()] = here  # -1: an owner of another part
        free = sorted(set(range(len(who))) - set(owner.tolist()), reverse=True)
        sold = np.zeros(len(things), bool)
        while free:
            i = free.pop()
            span = slice(edge[i], edge[i + 1])
            pay = cost[span] + price[at[span]]
            k = int(pay.argmin())
            least, pay[k] = pay[k], np.inf
            o = at[edge[i] + k]
            price[o] += pay.min() - least + step  # everyone has two edges at least
            if owner[o] >= 0:
                free.append(int(owner[o]))
            owner[o], sold[o] = i, True
        return pd.DataFrame({"object": things[sold], "price": price[sold], "owner": who[owner[sold]]})

    return run


def match_then_gate(a: DataFrame, b: DataFrame, by: list[str], key: str, dims: list[str], gate: float, most: int = MOST) -> DataFrame:
    """(by, a, b, distance): in each group all points of the smaller side are matched with the least total distance,
    and pairs over the gate are dropped afterwards. For groups that are small by nature (one unit's points): a group
    whose cost table has over `most` places is an error. A group that only one side has gives no row."""
    bounded = lambda df, name: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("id"), *[F.col(d).cast("double").alias(d) for d in dims]))).alias(name))
    kind = dict(a.dtypes)[key]

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for one in batch.to_dict("records"):
                left, right = one["hf_a"], one["hf_b"]
                if len(left) * len(right) > most:
                    raise ValueError(f"a group has {len(left)} by {len(right)} points")
                places = [np.array([[p[d] for d in dims] for p in side], float) for side in (left, right)]
                cost = np.sqrt(((places[0][:, None] - places[1][None]) ** 2).sum(-1))
                flip = len(left) > len(right)
                found = [(j, i) if flip else (i, j) for i, j in enumerate(assignment(cost.T if flip else cost))]
                out += [(*[one[c] for c in by], left[i]["id"], right[j]["id"], cost[i, j]) for i, j in found if cost[i, j] <= gate]
            yield pd.DataFrame(out, columns=[*by, "a", "b", "distance"])

    kinds = dict(a.dtypes)
    return bounded(a, "hf_a").join(bounded(b, "hf_b"), by).mapInPandas(pairs, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"a {kind}, b {dict(b.dtypes)[key]}, distance double"]))


def best_shift(a: DataFrame, b: DataFrame, key: str, dims: tuple[str, str], reach: int, step: float, nearest: int) -> DataFrame:
    """(da, db, score, pairs) of the (2 reach + 1)^2 shifts of b on a grid: the median of the `nearest` smallest distances
    from shifted points to their mutual nearest partners, and how many there are. All pairs within a radius tell which of them are
    mutual, so a shift with `nearest` mutual pairs inside it is final; the others go on with a threefold radius, and those that
    no radius serves (few points, sides far apart) are searched by nearest-neighbour joins of copies. The radius begins where few pairs
    are that close, so the rows looked at grow with the points, not with their pairs. Equal distances go to the smaller key, and of points at one
    place only that of the smallest key can be a mutual partner; points without key or coordinates have no pairs; a side without points gives no rows."""
    x, y = dims
    numbers = lambda df, n: df.select(F.col(key).alias(n), F.col(x).cast("double").alias(f"x{n}"), F.col(y).cast("double").alias(f"y{n}")).dropna()
    sides = [materialise(numbers(df, n).groupBy(f"x{n}", f"y{n}").agg(F.min(n).alias(n))) for df, n in ((a, "a"), (b, "b"))]
    ends = [s.agg(F.count("*"), F.min(f"x{n}"), F.max(f"x{n}"), F.min(f"y{n}"), F.max(f"y{n}")).first() for s, n in zip(sides, "ab", strict=True)]
    columns = "da double, db double, score double, pairs long"
    if not ends[0][0] or not ends[1][0]:
        return a.sparkSession.createDataFrame([], columns)
    spans = [max(e[k] for e in ends) - min(e[k - 1] for e in ends) for k in (2, 4)]
    far = float(np.hypot(*[s + 2 * reach * step for s in spans]))
    least = 1e-9 * max(far, *(abs(e[k]) for e in ends for k in range(1, 5)))
    area = max(ends[0][2] - ends[0][1], step) * max(ends[0][4] - ends[0][3], step)
    radius = max(float(np.sqrt(4 * nearest * area / (np.pi * ends[0][0] * ends[1][0]))), least)
    grid = [(i, j) for i, j in product(range(-reach, reach + 1), repeat=2)]
    left, ready = a.sparkSession.createDataFrame(grid, "i int, j int"), []
    copies = len(grid) * (ends[0][0] + ends[1][0])  # rows, if each shift gets rows of its own
    parts = lambda r: int(step / (r * (1 + 1e-6)))
    meet = meetings(sides, step, parts(radius)) if parts(radius) >= 3 else 0.0
    while meet > PAIRS_A_ROW * copies and radius / 4 > least:  # crowded places in a wide frame
        if (closer := meetings(sides, step, parts(radius / 4))) > meet / 2:
            break
        radius, meet = radius / 4, closer
    while radius <= far / 32:
        q = parts(radius)
        shared = q >= 3 and meetings(sides, step, q) <= PAIRS_A_ROW * copies
        near = materialise(folded_pairs(sides, left, reach, step, q, radius) if shared else shifted_pairs(sides, left, step, radius))
        final = materialise(middle(mutual_pairs(near), nearest).where(F.col("pairs") >= nearest))
        ready.append(final)
        left = materialise(left.join(F.broadcast(final), ["i", "j"], "left_anti"))  # no more rows than shifts
        if not (n := left.count()):
            break
        copies, radius = n * (ends[0][0] + ends[1][0]), 3 * radius
    else:
        ready.append(far_scores(sides, left, step, nearest))
    return reduce(DataFrame.unionByName, ready).select((F.col("i") * step).alias("da"), (F.col("j") * step).alias("db"), "score", "pairs")


def far_scores(sides: list[DataFrame], shifts: DataFrame, step: float, nearest: int) -> DataFrame:
    """(i, j, score, pairs) of shifts without a radius, by nearest-neighbour joins: a group of both sides' rows for each shift."""
    each = F.broadcast(shifts)
    moved = sides[1].crossJoin(each).select("b", "i", "j", (F.col("xb") + F.col("i") * step).alias("x"), (F.col("yb") + F.col("j") * step).alias("y"))
    still = sides[0].crossJoin(each).select("a", "i", "j", F.col("xa").alias("x"), F.col("ya").alias("y"))
    there = knn_join(moved, still, 1, ["x", "y"], "b", "a", ("i", "j")).select("i", "j", F.col("query_id").alias("b"), F.col("neighbour_id").alias("a"), F.col("distance").alias("d"))
    back = knn_join(still, moved, 1, ["x", "y"], "a", "b", ("i", "j")).select("i", "j", F.col("query_id").alias("a"), F.col("neighbour_id").alias("b"))
    return middle(there.join(back, ["i", "j", "a", "b"]), nearest)


PAIRS_A_ROW = 50  # pairs that cost as much as a row that is copied and moved


def folded(sides: list[DataFrame], step: float, q: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with cells of a step's q-th, counted anew in each step: points that any shift of the grid brings together lie in
    one cell or in neighbouring ones. b is there for all nine."""
    cell = lambda c: F.floor(F.col(c) / (step / q))
    around = F.array(*[F.struct(F.pmod(cell("xb") + m, F.lit(q)).alias("cx"), F.pmod(cell("yb") + n, F.lit(q)).alias("cy")) for m, n in product((-1, 0, 1), repeat=2)])
    return sides[0].withColumns({c: F.pmod(cell(f"{d}a"), F.lit(q)) for c, d in (("cx", "x"), ("cy", "y"))}), sides[1].select("*", F.inline(around))


def meetings(sides: list[DataFrame], step: float, q: int) -> float:
    """How many pairs share such a cell."""
    counts = [s.groupBy("cx", "cy").agg(F.count("*").cast("double").alias(n)) for s, n in zip(folded(sides, step, q), "nm", strict=True)]
    return counts[0].join(counts[1].hint("merge"), ["cx", "cy"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0.0


def folded_pairs(sides: list[DataFrame], shifts: DataFrame, reach: int, step: float, q: int, radius: float) -> DataFrame:
    """(i, j, a, b, d) of all pairs within a radius under a third of a step, for all shifts at once: a pair is as close for one shift at most."""
    still, moved = folded(sides, step, q)
    pairs = still.join(moved.hint("merge"), ["cx", "cy"]).select("a", "b", (F.col("xa") - F.col("xb")).alias("dx"), (F.col("ya") - F.col("yb")).alias("dy"))
    own = lambda c: F.when(F.abs(F.col(c)) <= reach * step + radius, F.rint(F.col(c) / step).cast("int"))
    return within(pairs.withColumns({"i": own("dx"), "j": own("dy")}), step, radius).join(F.broadcast(shifts), ["i", "j"], "left_semi")


def shifted_pairs(sides: list[DataFrame], shifts: DataFrame, step: float, radius: float) -> DataFrame:
    """The same for any radius, with rows of both sides for each shift."""
    each, width = F.broadcast(shifts), radius * (1 + 1e-6)
    cell = lambda c: F.floor(c / width)
    still = sides[0].crossJoin(each).withColumns({"cx": cell(F.col("xa")), "cy": cell(F.col("ya"))})
    at = [cell(F.col("xb") + F.col("i") * step), cell(F.col("yb") + F.col("j") * step)]
    moved = sides[1].crossJoin(each).select("*", F.inline(F.array(*[F.struct((at[0] + m).alias("cx"), (at[1] + n).alias("cy")) for m, n in product((-1, 0, 1), repeat=2)])))
    pairs = still.join(moved.hint("merge"), ["i", "j", "cx", "cy"])
    return within(pairs.withColumns({"dx": F.col("xa") - F.col("xb"), "dy": F.col("ya") - F.col("yb")}), step, radius)


def within(pairs: DataFrame, step: float, radius: float) -> DataFrame:
    d = F.sqrt((F.col("dx") - F.col("i") * step) ** 2 + (F.col("dy") - F.col("j") * step) ** 2)
    return pairs.select("i", "j", "a", "b", d.alias("d")).where(F.col("d") <= radius)


def mutual_pairs(near: DataFrame) -> DataFrame:
    best = lambda n, other: near.groupBy("i", "j", n).agg(F.min(F.struct("d", other)).alias("s")).select("i", "j", n, f"s.{other}", "s.d")
    return best("a", "b").drop("d").join(best("b", "a"), ["i", "j", "a", "b"])


def middle(mutual: DataFrame, nearest: int) -> DataFrame:
    top = mutual.withColumn("k", F.row_number().over(Window.partitionBy("i", "j").orderBy("d", "a"))).where(F.col("k") <= nearest)
    return top.groupBy("i", "j").agg(F.median("d").alias("score"), F.count("*").alias("pairs"))


def link_tracks(points: DataFrame, region: str, frame: str, key: str, dims: list[str], reference: int, most: float) -> DataFrame:
    """(region, track, frame, key): from the reference frame on, forwards and backwards, each track takes its
    one-to-one partner within `most` in the next frame; a track without partner ends. All regions go together."""
    points = materialise(points.select(region, frame, key, *dims))  # each frame reads them again
    lo, hi = points.agg(F.min(frame), F.max(frame)).first()
    start = materialise(points.where(F.col(frame) == reference).select(region, F.col(key).alias("track"), frame, key, *dims))
    parts = [start]
    for way, end in ((1, hi), (-1, lo)):
        now = start
        for f in range(reference + way, (end if end is not None else reference) + way, way):
            there = points.where(F.col(frame) == f)
            pairs = range_join(now, there, most, dims, "track", key, (region,), strict=False)
            match = one_to_one(pairs, (region,)).select(region, F.col("query_id").alias("track"), F.col("neighbour_id").alias(key))
            now = materialise(match.join(there.hint("merge"), [region, key]).select(region, "track", frame, key, *dims))
            if now.isEmpty():
                break
            parts.append(now)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(region, "track", frame, key)


def batched_solve(rows: DataFrame, schema: str, solve) -> DataFrame:
    """solve takes a batch of rows at once, each of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from (solve(batch) for batch in batches if len(batch))

    return rows.mapInPandas(run, schema)
