"""Aggregations over unit errors, moments and shapes (inventory D)."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import beside, order_values, quantiles, tied


def method_summary(errors: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """n, mean, median and 90th percentile (linear interpolation) of an error for each group."""
    middle = quantiles(errors, keys, error, {"median_error": 0.5, "p90_error": 0.9}).drop("n")
    return beside(errors.groupBy(*keys).agg(F.count(error).alias("n"), F.avg(error).alias("mean_error")), middle, keys, "left")


def pooled_rollup(errors: DataFrame, group: str, method: str, error: str = "error") -> DataFrame:
    """Count, mean and median by group and method, and pooled over groups under the label "pooled"."""
    rows = errors.groupingSets([[F.col(group), F.col(method)], [F.col(method)]], group, method)
    out = rows.agg(F.grouping(group).alias("g"), F.count(error).alias("n"), F.avg(error).alias("mean_error"), F.median(error).alias("median_error"))
    return out.select(F.when(F.col("g") == 1, "pooled").otherwise(F.col(group).cast("string")).alias(group), method, "n", "mean_error", "median_error")


def hierarchical(errors: DataFrame, unit: str, block: str, method: str, error: str = "error") -> DataFrame:
    """Point errors to unit means, to block medians, to one median for each method."""
    units = errors.groupBy(method, block, unit).agg(F.avg(error).alias("e"))
    blocks = units.groupBy(method, block).agg(F.median("e").alias("e"), F.count("*").alias("units"))
    return blocks.groupBy(method).agg(F.median("e").alias("median_error"), F.count("*").alias("blocks"), F.sum("units").alias("units"))


def unit_means(errors: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    return errors.groupBy(*keys).agg(F.avg(error).alias(error))


def distinct_keys(df: DataFrame, by: list[str], **keys: list[str]) -> DataFrame:
    """For each name the number of distinct composite keys."""
    return df.groupBy(*by).agg(*[F.count_distinct(F.struct(*cols)).alias(name) for name, cols in keys.items()])


def win_rate(pairs: DataFrame, by: list[str], first: str, second: str, tolerances: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    """Wins of the second over the first, and how often the second lies within a share of the first."""
    a, b = F.col(first), F.col(second)
    within = [F.count_if(F.abs(a - b) <= t * F.abs(a)).alias(f"within_{round(100 * t)}") for t in tolerances]
    return pairs.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(b < a).alias("wins"), F.avg((b < a).cast("double")).alias("win_rate"), *within)


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Map of each value to its count, keys sorted, for each group."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def pivoted(df: DataFrame, rows: list[str], column: str, values: list[str], how: Column, fill=None) -> DataFrame:
    """A wide table with a declared list of columns."""
    out = df.groupBy(*rows).pivot(column, values).agg(how)
    return out if fill is None else out.fillna(fill, values)


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))).alias("weighted_mean"))


def dispersion(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median absolute deviation, its 1.4826 multiple, and the coefficient of variation (population)."""
    centre = df.groupBy(*by).agg(F.median(value).alias("median"), (F.stddev_pop(value) / F.avg(value)).alias("cv"))
    away = df.join(centre, by).groupBy(*by, "median", "cv").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return away.select(*by, "median", "mad", (F.col("mad") * 1.4826).alias("scale"), "cv")


def pearson(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Correlation for each group, 0 where it is undefined."""
    return df.groupBy(*by).agg(F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0)).alias("pearson"))


def average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """df with the mean rank of ties, nulls first."""
    ranks = tied(df, by, value).select(*by, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))
    return beside(df, ranks, [*by, value])


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    ranked = average_rank(average_rank(df, by, a, "hf_a"), by, b, "hf_b")
    return pearson(ranked, by, "hf_a", "hf_b").withColumnRenamed("pearson", "spearman")


def moments(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """n, means and covariances (n - 1) of all pairs of columns for each group."""
    pairs = [F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in combinations_with_replacement(cols, 2)]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in cols], *pairs)


def higher_quantile(df: DataFrame, by: list[str], value: str, q: float | Column, name: str) -> DataFrame:
    """The value at index ceil((n - 1) * q) in ascending order; q may depend on the count `n`."""
    at = F.ceil((F.col("n") - 1) * (q if isinstance(q, Column) else F.lit(q)) - 1e-12)
    return order_values(df, by, value, {name: at}).select(*by, name, "n")


def conformal_quantile(df: DataFrame, by: list[str], error: str, scale: Column, confidence: float) -> DataFrame:
    """Quantile of error over scale at level min(ceil((n + 1) * confidence) / n, 1), method higher."""
    level = F.least(F.ceil((F.col("n") + 1) * confidence) / F.col("n"), F.lit(1.0))
    return higher_quantile(df.withColumn("hf_score", F.abs(error) / scale), by, "hf_score", level, "q")


def coverage(df: DataFrame, by: list[str], unit: str, error: str, width: Column, share: float = 0.9) -> DataFrame:
    """Points within a width, and units with at least a share of their points within it."""
    units = df.groupBy(*by, unit).agg(F.count("*").alias("n"), F.count_if(F.abs(error) <= width).alias("inside"))
    return units.groupBy(*by).agg((F.sum("inside") / F.sum("n")).alias("point_coverage"), F.count("*").alias("units"), F.count_if(F.col("inside") >= share * F.col("n")).alias("units_covered"))


def best_row(df: DataFrame, by: list[str], order: list[Column], keep: list[str], largest: bool = False) -> DataFrame:
    """The row of each group whose order, compared part by part, is smallest (or largest). Combined in each task
    before the shuffle, so one very large group is no bottleneck."""
    pick = F.max_by if largest else F.min_by
    return df.groupBy(*by).agg(pick(F.struct(*keep), F.struct(*order)).alias("hf_row")).select(*by, "hf_row.*")


def template_stack(cells: DataFrame, fold: str, cell: list[str], value: str) -> DataFrame:
    """For each fold the median of every cell over the other folds: rows are dealt to the folds that use them."""
    from .holdout import dealt

    return dealt(cells, fold, "held_out", False).groupBy("held_out", *cell).agg(F.median(value).alias("template"))


def radial_profile(cells: DataFrame, by: list[str], i: Column, j: Column, value: str) -> DataFrame:
    """Every cell's value replaced by the median of its rounded-radius ring."""
    rings = cells.withColumn("ring", F.rint(F.hypot(i, j)).cast("int"))
    medians = rings.groupBy(*by, "ring").agg(F.median(value).alias("profile"))
    return rings.join(medians, [*by, "ring"])


def contrast_error(df: DataFrame, by: list[str], value: str, error: str) -> DataFrame:
    """Contrast max(p95 - p5, 1) and mean error over it."""
    wide = F.greatest(F.percentile(value, F.lit(0.95)) - F.percentile(value, F.lit(0.05)), F.lit(1.0))
    return df.groupBy(*by).agg(wide.alias("contrast"), F.avg(error).alias("mae")).withColumn("normalised", F.col("mae") / F.col("contrast"))


def shape_features(df: DataFrame, by: list[str], value: str, radius: Column, core: float, rim: float) -> DataFrame:
    """p95 - p5, population standard deviation, and mean of the core minus mean of the rim."""
    mean = lambda keep: F.avg(F.when(keep, F.col(value)))
    return df.groupBy(*by).agg((F.percentile(value, F.lit(0.95)) - F.percentile(value, F.lit(0.05))).alias("span"), F.stddev_pop(value).alias("std"), (mean(radius <= core) - mean(radius >= rim)).alias("core_minus_rim"))


def first_row(df: DataFrame, by: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Each column's value in the group's first row of a full order."""
    return df.groupBy(*by).agg(*[F.min_by(c, F.struct(*order)).alias(c) for c in cols])


def sweep_envelope(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.percentile(value, F.lit(0.95)).alias("p95"))


def block_sum(cells: DataFrame, size: int, value: str) -> DataFrame:
    """Cells summed in planes of size x size, truncated, then over size planes."""
    planes = cells.groupBy((F.col("i") / size).cast("int").alias("bi"), (F.col("j") / size).cast("int").alias("bj"), "k").agg(F.floor(F.sum(value)).alias("s"))
    return planes.groupBy("bi", "bj", (F.col("k") / size).cast("int").alias("bk")).agg(F.sum("s").alias("total"))


def object_measures(voxels: DataFrame, by: list[str], coords: dict[str, Column], edges: dict[str, tuple[int, int]]) -> DataFrame:
    """Voxels, bounding box, centroid and whether an object touches the border, for each label."""
    v = voxels.withColumns(coords)
    touch = reduce(lambda a, b: a | b, [F.bool_or((F.col(c) == lo) | (F.col(c) == hi)) for c, (lo, hi) in edges.items()])
    return v.groupBy(*by).agg(F.count("*").alias("voxels"), *[f(c).alias(f"{n}_{c}") for c in coords for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))], touch.alias("border"))


def extreme_pairs(points: DataFrame, unit: str, bins: int, least: int, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Highest and lowest z in each bin (of those with two points) of a bins x bins grid over the middle of x and y."""
    q = lambda c: F.percentile(c, F.array(F.lit(lo), F.lit(hi)))
    frame = points.groupBy(unit).agg(q("x").alias("qx"), q("y").alias("qy"))
    p = points.join(frame, unit)
    place = lambda c, r: F.floor((F.col(c) - F.get(r, F.lit(0))) / (F.get(r, F.lit(1)) - F.get(r, F.lit(0))) * bins)
    p = p.withColumns({"ix": place("x", F.col("qx")), "iy": place("y", F.col("qy"))}).where(F.col("ix").between(0, bins - 1) & F.col("iy").between(0, bins - 1))
    out = p.groupBy(unit, "ix", "iy").agg(F.count("*").alias("n"), F.max("z").alias("top"), F.min("z").alias("bottom")).where("n >= 2")
    return out.withColumn("bins", F.count("*").over(Window.partitionBy(unit))).where(F.col("bins") >= least)
