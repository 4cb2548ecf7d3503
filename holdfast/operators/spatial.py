"""Neighbour joins over 2-D and 3-D points (inventory C, D29, D30, H01, H04).

Points are hashed into grid cells; a search joins a query to the 3^d cells around its own, so no join is a
Cartesian product. The k-nearest join starts with cells sized by the mean density, or smaller ones where points
crowd (a far outlier widens the mean, a cluster is denser than it), certifies each query whose k-th distance lies within
the searched block, and searches again with threefold cells. Queries that this leaves (far from all points, or beside crowded
cells) go down a tree of boxes: each level is a table of boxes with their numbers of points, and a query opens
only boxes that can still beat its k-th distance.

Both sides of these joins grow with the data, and a Parquet file's size says little about its rows: left to it, Spark
gathers a side of a million points in the driver to send it around. They carry the hint for a sort-merge join.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .boxes import box_search, boxes_of


def _cells(df: DataFrame, dims: list[str], width: float, spread: bool) -> DataFrame:
    own = [F.floor(F.col(c) / width) for c in dims]
    if not spread:
        return df.withColumn("hf_cell", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(own)]))
    around = [F.struct(*[(c + d).alias(f"c{i}") for i, (c, d) in enumerate(zip(own, shift, strict=True))]) for shift in product((-1, 0, 1), repeat=len(dims))]
    return df.withColumn("hf_cell", F.explode(F.array(*around)))


def distance(dims: list[str], a: str = "q_", b: str = "p_") -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, [(F.col(a + c) - F.col(b + c)) * (F.col(a + c) - F.col(b + c)) for c in dims]))


def _sides(queries: DataFrame, points: DataFrame, dims: list[str], qid: str, pid: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    q = queries.select(*by, F.col(qid).alias("query_id"), *[F.col(c).cast("double").alias(f"q_{c}") for c in dims])
    p = points.select(*by, F.col(pid).alias("neighbour_id"), *[F.col(c).cast("double").alias(f"p_{c}") for c in dims])
    whole = lambda df, s: df.where(reduce(lambda a, b: a & b, [F.col(s + c).isNotNull() & ~F.isnan(s + c) for c in dims]))
    return whole(q, "q_"), whole(p, "p_")


def range_join(queries: DataFrame, points: DataFrame, radius: float, dims: list[str], qid: str, pid: str, by: tuple[str, ...] = (), strict: bool = True, exclude_self: bool = False) -> DataFrame:
    """(by, query_id, neighbour_id, distance) of pairs closer than radius (or at most radius)."""
    by = list(by)
    q, p = _sides(queries, points, dims, qid, pid, by)
    q = _cells(q, [f"q_{c}" for c in dims], radius, True)
    p = _cells(p, [f"p_{c}" for c in dims], radius, False)
    d = q.join(p.hint("merge"), [*by, "hf_cell"]).withColumn("distance", distance(dims))
    d = d.where((F.col("distance") < radius) if strict else (F.col("distance") <= radius))
    return (d.where(F.col("query_id") != F.col("neighbour_id")) if exclude_self else d).select(*by, "query_id", "neighbour_id", "distance")


CROWD = 8  # times k: places that the cell of an average point may hold


def crowding(places: DataFrame, by: list[str], dims: list[str], width: float) -> float:
    """How many places the cell of an average place holds."""
    cells = _cells(places, dims, width, False).groupBy(*by, "hf_cell").agg(F.count("*").cast("double").alias("n"))
    return cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0


def cell_width(p: DataFrame, by: list[str], dims: list[str], k: int, width: float, rounds: int = 12) -> float:
    """The width, made smaller until the cell of an average place holds at most CROWD * k of them. Points with one
    place count once: no width parts them."""
    most = float(CROWD * max(k, 4))
    if crowding(p, by, dims, width) <= most:
        return width
    places = materialise(p.select(*by, *dims).distinct())
    for _ in range(rounds):
        if (now := crowding(places, by, dims, width)) <= most:
            break
        width *= max(1 / 64, (most / now) ** (1 / len(dims)) / 1.5)
    return width


GRIDS = 2  # rounds over cells, before the tree
FULL = 32  # times k: a cell with more points is left to the tree
DEEPEST = 64  # levels of a tree; boxes at the last one are leaves whatever they hold


def knn_join(queries: DataFrame, points: DataFrame, k: int, dims: list[str], qid: str, pid: str, by: tuple[str, ...] = (), exclude_self: bool = False) -> DataFrame:
    """(by, query_id, neighbour_id, distance, rank): the exact k nearest points, ties by id; fewer if a group has
    fewer. A query's own id is left out on demand."""
    by = list(by)
    q, p = _sides(queries, points, dims, qid, pid, by)
    lo, hi = [f"lo_{c}" for c in dims], [f"hi_{c}" for c in dims]
    frame = p.groupBy(*by).agg(F.count("*").alias("n"), *[F.min(f"p_{c}").alias(a) for c, a in zip(dims, lo, strict=True)], *[F.max(f"p_{c}").alias(b) for c, b in zip(dims, hi, strict=True)])
    ends = frame.agg(F.max("n"), *[F.min(c) for c in lo], *[F.max(c) for c in hi]).first()
    m, want = len(dims), k + exclude_self
    schema = ", ".join([*[f"{b} {t}" for b, t in q.dtypes if b in by], f"query_id {dict(q.dtypes)['query_id']}, neighbour_id {dict(p.dtypes)['neighbour_id']}, distance double, rank int"])
    if not ends[0]:
        return queries.sparkSession.createDataFrame([], schema)
    extents = [b - a for a, b in zip(ends[1 : m + 1], ends[m + 1 :], strict=True)]
    widest = max(extents) or 1.0
    volume = reduce(lambda a, b: a * b, [max(e, widest * 1e-3) for e in extents])
    width = cell_width(p, by, [f"p_{c}" for c in dims], want, (volume * 4 * want / (3**m * ends[0])) ** (1 / m))
    parts, left = [], q
    for _ in range(GRIDS):
        cells = _cells(p, [f"p_{c}" for c in dims], width, False)
        spread = _cells(left, [f"q_{c}" for c in dims], width, True)
        full = cells.groupBy(*by, "hf_cell").count().where(F.col("count") > FULL * max(want, 4)).select(*by, "hf_cell")
        if not (full := materialise(full)).isEmpty():
            beside = materialise(spread.join(full, [*by, "hf_cell"], "left_semi").select(*by, "query_id").distinct())
            spread = spread.join(beside.hint("merge"), [*by, "query_id"], "left_anti")
        near = spread.join(cells.hint("merge"), [*by, "hf_cell"])
        near = near.where(F.col("query_id") != F.col("neighbour_id")) if exclude_self else near
        near = _first(near.withColumn("distance", distance(dims)), by, k)
        inside = reduce(F.least, [F.least(x, 1 - x) for x in [F.col(f"q_{c}") / width - F.floor(F.col(f"q_{c}") / width) for c in dims]])
        known = near.withColumn("hf_far", F.max(F.when(F.col("rank") == k, F.col("distance"))).over(Window.partitionBy(*by, "query_id")))
        done = materialise(known.where(F.col("hf_far") <= (1 + inside) * width).select(*by, "query_id", "neighbour_id", "distance", "rank"))
        parts.append(done)
        left = materialise(left.join(done.select(*by, "query_id").distinct().hint("merge"), [*by, "query_id"], "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        width *= 3
    return reduce(DataFrame.unionByName, [*parts, tree_search(left, p, k, dims, by, exclude_self)])


def _first(pairs: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k pairs of each query with the smallest distance, ties by id, with their rank."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "query_id").orderBy("distance", "neighbour_id"))).where(F.col("rank") <= k)


def box_tree(p: DataFrame, dims: list[str], by: list[str], leaf: int) -> tuple[DataFrame, DataFrame, int]:
    """Boxes (by, node, up, n, lo_*, hi_*, leaf) of all levels, points with the leaf they are in, and the number of levels. A box is
    the tight one around its points; it is halved along each dimension until it holds `leaf` points at most or one place, so
    empty space costs no level."""
    levels, done = [], []
    now = p.withColumns({"node": F.lit(""), "up": F.lit(None).cast("string")})
    for depth in range(DEEPEST):
        one = reduce(lambda a, b: a & b, [F.col(f"lo_{c}") == F.col(f"hi_{c}") for c in dims])
        box = now.groupBy(*by, "node").agg(F.first("up").alias("up"), F.count("*").alias("n"), *[f(f"p_{c}").alias(f"{e}_{c}") for c in dims for e, f in (("lo", F.min), ("hi", F.max))])
        box = materialise(box.withColumn("leaf", (F.col("n") <= leaf) | one | F.lit(depth == DEEPEST - 1)))
        levels.append(box)
        done.append(now.join(box.where("leaf").select(*by, "node"), [*by, "node"], "left_semi").select(*p.columns, "node"))
        large = box.where("not leaf")
        if large.isEmpty():
            break
        halves = []
        for c in dims:
            middle = F.col(f"lo_{c}") + (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / 2
            halves.append(F.when(F.col(f"p_{c}") > F.when(middle >= F.col(f"hi_{c}"), F.col(f"lo_{c}")).otherwise(middle), "1").otherwise("0"))
        now = now.drop("up").join(large.select(*by, "node", *[f"{e}_{c}" for c in dims for e in ("lo", "hi")]), [*by, "node"])
        now = materialise(now.select(*p.columns, F.concat("node", *halves).alias("node"), F.col("node").alias("up")))
    return reduce(DataFrame.unionByName, levels), reduce(DataFrame.unionByName, done), len(levels)


def tree_search(q: DataFrame, p: DataFrame, k: int, dims: list[str], by: list[str], exclude_self: bool) -> DataFrame:
    """(by, query_id, neighbour_id, distance, rank) of the k nearest points by a tree of boxes."""
    return searched(q, tree_of(p, k + exclude_self, dims, by), k, dims, by, exclude_self)


def tree_of(p: DataFrame, want: int, dims: list[str], by: list[str]) -> tuple:
    """The tree for searches of `want` points. Of points that share a place, the lowest ids can be answers; the others
    aren't looked at."""
    place = Window.partitionBy(*by, *[f"p_{c}" for c in dims]).orderBy("neighbour_id")
    p = materialise(p.withColumn("hf_r", F.row_number().over(place)).where(F.col("hf_r") <= want).drop("hf_r"))
    if (flat := boxes_of(p, dims, by)) is not None:
        return flat
    boxes, points, levels = box_tree(p, dims, by, max(8, 2 * want))
    return materialise(boxes), materialise(points), levels


def searched(q: DataFrame, tree: tuple, k: int, dims: list[str], by: list[str], exclude_self: bool) -> DataFrame:
    """(by, query_id, neighbour_id, distance, rank) of the k nearest points. All queries go down the tree together:
    of each one's boxes, those whose farthest corners bound k points bound its k-th distance, and boxes farther than that
    are closed. With few groups all boxes are at hand at once (see boxes.py)."""
    if len(tree) == 2:
        return _first(box_search(q, tree, k, dims, by, exclude_self), by, k).select(*by, "query_id", "neighbour_id", "distance", "rank")
    (boxes, points, levels), want = tree, k + exclude_self
    edges = [f"{e}_{c}" for c in dims for e in ("lo", "hi")]
    gap = reduce(lambda a, b: a + b, [F.pow(F.greatest(F.col(f"lo_{c}") - F.col(f"q_{c}"), F.col(f"q_{c}") - F.col(f"hi_{c}"), F.lit(0.0)), F.lit(2)) for c in dims])
    reach = reduce(lambda a, b: a + b, [F.pow(F.greatest(F.abs(F.col(f"q_{c}") - F.col(f"lo_{c}")), F.abs(F.col(f"q_{c}") - F.col(f"hi_{c}"))), F.lit(2)) for c in dims])
    held = [*q.columns, "node", "n", "leaf"]

    def closed(pairs: DataFrame) -> DataFrame:
        own = Window.partitionBy(*by, "query_id")
        bound = pairs.withColumns({"hf_gap": F.sqrt(gap) * (1 - 1e-12), "hf_reach": F.sqrt(reach)})
        bound = bound.withColumn("hf_held", F.sum("n").over(own.orderBy("hf_reach").rangeBetween(Window.unboundedPreceding, 0)))
        bound = bound.withColumn("hf_most", F.min(F.when(F.col("hf_held") >= want, F.col("hf_reach"))).over(own))
        return materialise(bound.where(F.col("hf_most").isNull() | (F.col("hf_gap") <= F.col("hf_most"))).select(*held, *edges))

    root = boxes.where("up is null").select(*by, "node", "n", "leaf", *edges)
    front = closed(q.join(root, by) if by else q.crossJoin(F.broadcast(root)))  # one row without groups
    kids = boxes.where("up is not null").select(*by, F.col("up").alias("hf_up"), F.col("node").alias("hf_node"), F.col("n").alias("hf_n"), F.col("leaf").alias("hf_leaf"), *[F.col(e).alias(f"hf_{e}") for e in edges])
    for _ in range(levels - 1):
        inner = front.where("not leaf").drop("n", "leaf", *edges).withColumnRenamed("node", "hf_up")
        opened = inner.join(kids, [*by, "hf_up"]).select(*q.columns, F.col("hf_node").alias("node"), F.col("hf_n").alias("n"), F.col("hf_leaf").alias("leaf"), *[F.col(f"hf_{e}").alias(e) for e in edges])
        front = closed(front.where("leaf").unionByName(opened))
    pairs = front.select(*q.columns, "node").join(points.hint("merge"), [*by, "node"])
    pairs = pairs.where(F.col("query_id") != F.col("neighbour_id")) if exclude_self else pairs
    return _first(pairs.withColumn("distance", distance(dims)), by, k).select(*by, "query_id", "neighbour_id", "distance", "rank")


def nearest(queries: DataFrame, points: DataFrame, dims: list[str], qid: str, pid: str, by: tuple[str, ...] = ()) -> DataFrame:
    return knn_join(queries, points, 1, dims, qid, pid, by).drop("rank")


def nearest_in_group(clicks: DataFrame, samples: DataFrame, group: list[str], gap: Column, order: list[str], keep: list[str], click: str) -> DataFrame:
    """For each click the sample of its own group with the smallest gap, first in order on ties; clicks whose
    group has none keep nulls. Samples of a group are few by nature (one unit's grid)."""
    pairs = clicks.join(samples, group, "left")
    best = F.min_by(F.struct(*keep), F.struct(gap.alias("gap"), *order))
    return pairs.groupBy(*group, click).agg(best.alias("hf"), F.min(gap).alias("gap")).select(*group, click, "hf.*", "gap")


def two_way_distance(a: DataFrame, b: DataFrame, dims: list[str], aid: str, bid: str) -> DataFrame:
    """Largest and median nearest distance in both directions."""
    one = nearest(a, b, dims, aid, bid).select(F.lit("a_to_b").alias("direction"), "distance")
    two = nearest(b, a, dims, bid, aid).select(F.lit("b_to_a").alias("direction"), "distance")
    return one.unionByName(two).groupBy("direction").agg(F.max("distance").alias("largest"), F.median("distance").alias("median"))


def pairs_within(df: DataFrame, by: list[str], key: str, measure: Column) -> DataFrame:
    """A measure over all unordered pairs inside small groups, on sides l and r."""
    left, right = df.select(*by, F.struct(*df.columns).alias("l")), df.select(*by, F.struct(*df.columns).alias("r"))
    return left.join(right, by).where(F.col(f"l.{key}") < F.col(f"r.{key}")).withColumn("measure", measure)


def lattice(points: DataFrame, dims: list[str], key: str, by: tuple[str, ...] = (), k: int = 6) -> DataFrame:
    """Median distance to the k neighbours, and the sixfold angle of their directions, for each group."""
    near = knn_join(points, points, k, dims, key, key, by, exclude_self=True)
    at = points.select(*by, F.col(key).alias("hf_key"), *[F.col(c).alias(f"hf_{c}") for c in dims])
    own = near.join(at.withColumnRenamed("hf_key", "query_id"), [*by, "query_id"]).withColumnsRenamed({f"hf_{c}": f"a_{c}" for c in dims})
    both = own.join(at.withColumnRenamed("hf_key", "neighbour_id"), [*by, "neighbour_id"])
    turn = F.atan2(F.col(f"hf_{dims[1]}") - F.col(f"a_{dims[1]}"), F.col(f"hf_{dims[0]}") - F.col(f"a_{dims[0]}"))
    out = both.groupBy(*by).agg(F.median("distance").alias("spacing"), F.avg(F.sin(k * turn)).alias("s"), F.avg(F.cos(k * turn)).alias("c"))
    return out.select(*by, "spacing", (F.atan2("s", "c") / k).alias("angle"))


def neighbourhood_features(points: DataFrame, dims: list[str], key: str, k: int = 6) -> DataFrame:
    """Mean, CV and range of the k neighbour distances, and the anisotropy of their offsets (root of the ratio of
    the 2 x 2 scatter's eigenvalues)."""
    near = knn_join(points, points, k, dims, key, key, exclude_self=True)
    x, y = dims
    at = points.select(F.col(key).alias("hf_key"), F.col(x).alias("hf_x"), F.col(y).alias("hf_y"))
    both = near.join(at.toDF("query_id", "ax", "ay"), "query_id").join(at.toDF("neighbour_id", "bx", "by"), "neighbour_id")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    out = both.groupBy("query_id").agg(F.avg("distance").alias("mean"), (F.stddev_pop("distance") / F.avg("distance")).alias("cv"), (F.max("distance") - F.min("distance")).alias("range"), F.covar_pop(dx, dx).alias("xx"), F.covar_pop(dx, dy).alias("xy"), F.covar_pop(dy, dy).alias("yy"))
    mid, gap = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, 2) + F.pow("xy", 2))
    return out.select("query_id", "mean", "cv", "range", F.sqrt(F.greatest(mid - gap, F.lit(0.0)) / (mid + gap)).alias("anisotropy"))


def knn_graph(points: DataFrame, dims: list[str], key: str, k: int = 6, ratio: float = 1.6) -> DataFrame:
    """Undirected edges (a < b, length) of the k nearest neighbours, kept if at most ratio times the mean of both
    ends' pitch (median distance to the k neighbours)."""
    near = knn_join(points, points, k, dims, key, key, exclude_self=True)
    pitch = near.groupBy("query_id").agg(F.median("distance").alias("pitch"))
    edges = near.select(F.least("query_id", "neighbour_id").alias("a"), F.greatest("query_id", "neighbour_id").alias("b"), "distance").dropDuplicates(["a", "b"])
    p = lambda n: pitch.toDF(n, f"pitch_{n}").hint("merge")
    return edges.join(p("a"), "a").join(p("b"), "b").where(F.col("distance") <= ratio * (F.col("pitch_a") + F.col("pitch_b")) / 2).select("a", "b", F.col("distance").alias("length"))


def idw(neighbours: DataFrame, values: DataFrame, key: str, value: str, power: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Inverse-distance mean of neighbours' values; neighbours at distance 0 alone count where there are any."""
    n = neighbours.join(values.select(*by, F.col(key).alias("neighbour_id"), F.col(value).alias("hf_v")), [*by, "neighbour_id"])
    hit = F.col("distance") == 0
    w = F.when(~hit, 1 / F.pow("distance", F.lit(power)))
    out = n.groupBy(*by, "query_id").agg(F.avg(F.when(hit, F.col("hf_v"))).alias("exact"), (F.sum(w * F.col("hf_v")) / F.sum(w)).alias("mixed"), F.min("distance").alias("nearest"))
    return out.select(*by, "query_id", F.coalesce("exact", "mixed").alias("prediction"), "nearest")


def nearest_other(points: DataFrame, dims: list[str], key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Unordered pairs (a < b) of each point and its nearest other one, once."""
    near = knn_join(points, points, 1, dims, key, key, by, exclude_self=True)
    return near.select(F.least("query_id", "neighbour_id").alias("a"), F.greatest("query_id", "neighbour_id").alias("b")).distinct()
