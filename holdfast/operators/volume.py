"""Voxel tables (inventory K, E06, E07, C13)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .spatial import nearest, range_join
from .windows import gaussian_smooth


def gather(queries: DataFrame, cells: DataFrame, key: str, at: list[str], coords: list[str], value: str) -> DataFrame:
    """Linear interpolation at fractional coordinates: up to 2^d corners joined with weights; null if a corner
    with weight is missing."""
    corners = []
    for bits in product((0, 1), repeat=len(at)):
        w = F.lit(1.0)
        place = []
        for b, a in zip(bits, at, strict=True):
            low = F.floor(a)
            share = F.col(a) - low
            w = w * (share if b else 1 - share)
            place.append((low + b).alias(f"hf_{a}"))
        corners.append(F.struct(*place, w.alias("hf_w")))
    spread = queries.select(key, F.explode(F.array(*corners)).alias("c")).select(key, "c.*").where("hf_w > 0")
    values = cells.select(*[F.col(c).cast("long").alias(f"hf_{a}") for c, a in zip(coords, at, strict=True)], F.col(value).alias("hf_v"))
    joined = spread.join(values, [f"hf_{a}" for a in at], "left")
    return joined.groupBy(key).agg(F.when(F.bool_and(F.col("hf_v").isNotNull()), F.sum(F.col("hf_w") * F.col("hf_v"))).alias("value"))


def height_map(cells: DataFrame, by: list[str], axis: str, value: str, thresholds: list[float]) -> DataFrame:
    from .windows import threshold_crossing

    return threshold_crossing(cells, by, axis, value, thresholds)


def relief(surface: DataFrame, by: list[str], x: str, value: str, sigma: float) -> DataFrame:
    """Surface minus its smooth along one axis."""
    smooth = gaussian_smooth(surface, by, x, value, sigma)
    return surface.join(smooth, [*by, x]).withColumn("relief", F.col(value) - F.col("smooth"))


def fill_missing(cells: DataFrame, key: str, dims: list[str], value: str) -> DataFrame:
    """Missing cells take the value of the nearest cell that has one, lowest key on ties."""
    has, lacks = cells.where(F.col(value).isNotNull()), cells.where(F.col(value).isNull())
    near = nearest(lacks, has, dims, key, key).select(F.col("query_id").alias(key), "neighbour_id")
    filled = near.join(has.select(F.col(key).alias("neighbour_id"), F.col(value).alias("hf_v")), "neighbour_id").select(key, "hf_v")
    return cells.join(filled, key, "left").withColumn(value, F.coalesce(value, "hf_v")).drop("hf_v")


def interior_gate(cells: DataFrame, empty: DataFrame, key: str, dims: list[str], radius: float) -> DataFrame:
    """Cells with no empty cell within a radius."""
    close = range_join(cells, empty, radius, dims, key, key, strict=False).select(F.col("query_id").alias(key)).distinct()
    return cells.join(close, key, "left_anti")


def eroded(cells: DataFrame, coords: list[str], steps: int) -> DataFrame:
    """Cells whose cross of neighbours are all there, a number of times."""
    now = cells.select(*coords)
    for _ in range(steps):
        around = [F.struct(*[(F.col(c) + (s if i == d else 0)).alias(c) for i, c in enumerate(coords)]) for d in range(len(coords)) for s in (-1, 1)]
        near = now.select(F.struct(*coords).alias("own"), F.explode(F.array(*around)).alias("n")).select("own", "n.*")
        now = materialise(near.join(now, coords).groupBy("own").count().where(F.col("count") == len(around)).select("own.*"))
    return now


def mask_surfaces(cells: DataFrame, by: list[str], axis: str) -> DataFrame:
    """First and last occupied place of each column, and whether all between is occupied."""
    out = cells.groupBy(*by).agg(F.min(axis).alias("inner"), F.max(axis).alias("outer"), F.count("*").alias("n"))
    return out.withColumn("continuous", F.col("outer") - F.col("inner") + 1 == F.col("n"))


def patches(units: DataFrame, cells: DataFrame, key: str, at: tuple[str, str], coords: tuple[str, str], radius: int) -> DataFrame:
    """Cells in a box around integer unit centres, with their offsets; disk marks those within the radius. Each
    unit's box is spread over its cells, so the join is on equal cells."""
    steps = [F.struct(F.lit(a).alias("da"), F.lit(b).alias("db")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
    spread = units.select(key, *at, F.explode(F.array(*steps)).alias("s")).select(key, "s.*", *[(F.col(a) + F.col(f"s.{d}")).alias(c) for a, c, d in zip(at, coords, ("da", "db"), strict=True)])
    return spread.join(cells, list(coords)).withColumn("disk", F.col("da") * F.col("da") + F.col("db") * F.col("db") <= radius * radius)


def window_maximum(cells: DataFrame, dims: list[str], value: str, reach: float, name: str) -> DataFrame:
    """cells (at whole coordinates) with the largest value within `reach` along every dimension, a square window: one
    dimension after another."""
    last = value
    for i, d in enumerate(dims):
        line = Window.partitionBy(*[x for x in dims if x != d]).orderBy(d).rangeBetween(-int(reach), int(reach))
        cells, last = cells.withColumn(f"hf_max{i}", F.max(last).over(line)), f"hf_max{i}"
    return cells.withColumn(name, F.col(last)).drop(*[f"hf_max{i}" for i in range(len(dims))])


def local_maxima(cells: DataFrame, key: str, dims: list[str], value: str, window: float, threshold: float, apart: float, rounds: int = 50) -> DataFrame:
    """Cells of a grid over a threshold whose value is the largest of the square window of `window` cells to each side (equal
    ones are all candidates), then greedy suppression going down by value (ties: lower key first): a cell goes if a kept one
    is closer than `apart` in the largest coordinate difference; at that very distance it stays. In each
    round the local winners stay and what is close to them goes, which is what going down does."""
    high = window_maximum(cells.select(key, *dims, F.col(value).alias(value)), dims, value, window, "hf_most")
    left = materialise(high.where((F.col(value) > threshold) & (F.col(value) == F.col("hf_most"))).drop("hf_most"))
    kept = None

    def close(a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs closer than `apart` in every dimension, of different cells."""
        pairs = range_join(a, b, apart * len(dims) ** 0.5, dims, key, key, exclude_self=True).drop("distance")
        at = lambda df, n, p: df.select(F.col(key).alias(n), *[F.col(d).alias(f"{p}{d}") for d in dims], F.col(value).alias(f"{p}value"))
        both = pairs.join(at(a, "query_id", "hf_a"), "query_id").join(at(b, "neighbour_id", "hf_b"), "neighbour_id")
        gap = [F.abs(F.col(f"hf_a{d}") - F.col(f"hf_b{d}")) for d in dims]
        return both.where((F.greatest(*gap) if len(gap) > 1 else gap[0]) < apart)

    for _ in range(rounds):
        beaten = (F.col("hf_bvalue") > F.col("hf_avalue")) | ((F.col("hf_bvalue") == F.col("hf_avalue")) & (F.col("neighbour_id") < F.col("query_id")))
        lost = close(left, left).where(beaten).select(F.col("query_id").alias(key)).distinct()
        won = materialise(left.join(lost, key, "left_anti"))
        kept = won if kept is None else kept.unionByName(won)
        gone = close(left, won).select(F.col("query_id").alias(key)).unionByName(won.select(key)).distinct()
        left = materialise(left.join(gone, key, "left_anti"))
        if left.isEmpty():
            return kept
    raise RuntimeError("suppression did not settle")


def resample_path(nodes: DataFrame, track: str, depth: str, values: list[str]) -> DataFrame:
    """Every path at all integer depths between its ends: monotone cubic for three nodes or more (harmonic-mean
    slopes inside, a three-point rule at the ends), linear for two, as it is for one."""
    w = Window.partitionBy(track).orderBy(depth)
    n = F.count("*").over(Window.partitionBy(track))
    t = nodes.select(track, F.col(depth).cast("double").alias("d"), *values).toDF(track, "d", *values)
    w = Window.partitionBy(track).orderBy("d")
    h = F.lead("d").over(w) - F.col("d")
    t = t.withColumns({"hf_n": n, "hf_h": h, "hf_hp": F.lag("d").over(w)}).withColumn("hf_hp", F.col("d") - F.col("hf_hp"))
    for v in values:
        t = t.withColumn(f"s_{v}", (F.lead(v).over(w) - F.col(v)) / F.col("hf_h"))
        t = t.withColumn(f"sp_{v}", F.lag(f"s_{v}").over(w))
    t = t.withColumns({"hf_hn": F.lead("hf_h").over(w), "hf_hpp": F.lag("hf_hp").over(w)})

    def end(h0: Column, h1: Column, s0: Column, s1: Column) -> Column:
        m = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        return F.when(F.signum(m) != F.signum(s0), 0.0).when((F.signum(s0) != F.signum(s1)) & (F.abs(m) > 3 * F.abs(s0)), 3 * s0).otherwise(m)

    for v in values:
        s, sp = F.col(f"s_{v}"), F.col(f"sp_{v}")
        hc, hp = F.col("hf_h"), F.col("hf_hp")
        inner = F.when(s * sp <= 0, 0.0).otherwise((3 * hc + 3 * hp) / ((2 * hc + hp) / sp + (hc + 2 * hp) / s))
        first = end(hc, F.col("hf_hn"), s, F.lead(f"s_{v}").over(w))
        last = end(hp, F.col("hf_hpp"), sp, F.lag(f"sp_{v}").over(w))
        slope = F.when(F.col("hf_n") == 2, F.coalesce(s, sp)).when(sp.isNull(), first).when(s.isNull(), last).otherwise(inner)
        t = t.withColumn(f"m_{v}", slope)
    for v in values:
        t = t.withColumns({f"n_{v}": F.lead(v).over(w), f"mn_{v}": F.lead(f"m_{v}").over(w)})
    at = F.when(F.col("hf_h").isNotNull(), F.sequence(F.ceil("d"), F.ceil(F.col("d") + F.col("hf_h")) - 1)).otherwise(F.array(F.ceil("d")))
    at = F.when(F.col("hf_h").isNull() & (F.ceil("d") != F.col("d")) & (F.col("hf_n") > 1), F.array().cast("array<bigint>")).otherwise(at)
    rows = t.select("*", F.explode(at).alias("depth"))
    u = (F.col("depth") - F.col("d")) / F.col("hf_h")
    out = []
    for v in values:
        a, b, m, k, hh = F.col(v), F.col(f"n_{v}"), F.col(f"m_{v}"), F.col(f"mn_{v}"), F.col("hf_h")
        cubic = (2 * u * u * u - 3 * u * u + 1) * a + (u * u * u - 2 * u * u + u) * hh * m + (-2 * u * u * u + 3 * u * u) * b + (u * u * u - u * u) * hh * k
        out.append(F.when(F.col("hf_h").isNull(), a).otherwise(cubic).alias(v))
    return rows.select(track, F.col("depth").cast("int").alias("depth"), *out)


def painted(paths: DataFrame, track: str, depth: str, at: tuple[str, str], order: Column, radius: int) -> DataFrame:
    """(depth, i, j, label) of disks around path points; where disks meet, the one later in order wins."""
    steps = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    p = paths.select(track, depth, order.alias("hf_o"), F.rint(at[0]).cast("long").alias("ci"), F.rint(at[1]).cast("long").alias("cj"), F.explode(F.array(*steps)).alias("s"))
    cells = p.select(depth, (F.col("ci") + F.col("s.a")).alias("i"), (F.col("cj") + F.col("s.b")).alias("j"), "hf_o", track)
    return cells.groupBy(depth, "i", "j").agg(F.max_by(track, F.struct("hf_o", track)).alias("label"))
