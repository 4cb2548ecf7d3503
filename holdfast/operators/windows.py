"""Windows, sorts and set operations (inventory E, F, G)."""

from __future__ import annotations

from functools import reduce
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import beside, medians, numbered


def top_k(df: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a full order, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def path_audit(nodes: DataFrame, track: str, depth: str, r: str, c: str, least: int = 6, step: float = 5.0, per_gap: float = 2.5) -> DataFrame:
    """For each path: nodes, largest step, and a note of what is wrong with it (depths that don't rise, too few
    nodes, steps longer than max(step, per_gap * gap))."""
    w = Window.partitionBy(track).orderBy(depth, r, c)
    d = nodes.withColumns({"gap": F.col(depth) - F.lag(depth).over(w), "step": F.hypot(F.col(r) - F.lag(r).over(w), F.col(c) - F.lag(c).over(w))})
    flags = d.groupBy(track).agg(F.count("*").alias("nodes"), F.max("step").alias("max_step"), F.coalesce(F.bool_or(F.col("gap") <= 0), F.lit(False)).alias("flat"), F.coalesce(F.bool_or(F.col("step") > F.greatest(F.lit(step), per_gap * F.col("gap"))), F.lit(False)).alias("jump"))
    note = F.array_compact(F.array(F.when(F.col("flat"), F.lit("depth does not rise")), F.when(F.col("jump"), F.lit("step too long")), F.when(F.col("nodes") < least, F.lit("too few nodes"))))
    return flags.select(track, "nodes", "max_step", (F.size(note) == 0).alias("passes"), F.array_join(note, "; ").alias("note"))


def angular_gap(angles: DataFrame, by: list[str], angle: str) -> DataFrame:
    """Largest gap between neighbours' angles (radians) around the circle, and their number."""
    w = Window.partitionBy(*by).orderBy(angle)
    turn = F.first(angle).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 2 * F.pi()
    gaps = angles.withColumn("gap", F.coalesce(F.lead(angle).over(w), turn) - F.col(angle))
    return gaps.groupBy(*by).agg(F.count("*").alias("neighbours"), F.max("gap").alias("max_gap"))


def gradient(df: DataFrame, by: list[str], x: str, value: str) -> DataFrame:
    """Central differences inside, one-sided at the ends."""
    w = Window.partitionBy(*by).orderBy(x)
    ahead, behind = F.coalesce(F.lead(value).over(w), F.col(value)), F.coalesce(F.lag(value).over(w), F.col(value))
    run = F.coalesce(F.lead(x).over(w), F.col(x)) - F.coalesce(F.lag(x).over(w), F.col(x))
    return df.withColumn("gradient", (ahead - behind) / F.when(run != 0, run))


def gaussian_weights(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    w = [exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def gaussian_smooth(df: DataFrame, by: list[str], x: str, value: str, sigma: float, name: str = "smooth") -> DataFrame:
    """Smoothing along integer x = lo..hi of each line, reflecting at both ends (the end row is repeated).
    Each row takes the places of its window, mirrored ones included; places without a row or value are left out and the
    other weights scaled up. Rows move once, with a line; the window is an array beside each row."""
    w = gaussian_weights(sigma)
    radius = len(w) // 2
    ends = beside(df, df.groupBy(*by).agg(F.min(x).alias("hf_lo"), (F.max(x) - F.min(x) + 1).alias("hf_n")), by)
    turns = F.sequence(-F.ceil(radius / (2 * F.col("hf_n")) + 1), F.ceil(radius / (2 * F.col("hf_n")) + 1))
    both = F.flatten(F.transform(turns, lambda t: F.array(F.col(x) + 2 * F.col("hf_n") * t, 2 * F.col("hf_lo") - 1 - F.col(x) + 2 * F.col("hf_n") * t)))
    near = F.filter(both, lambda p: p.between(F.col("hf_lo") - radius, F.col("hf_lo") + F.col("hf_n") - 1 + radius))
    rows = ends.select(*by, F.col(x), F.col(value).alias("hf_v"), F.explode(near).alias("hf_at"))  # a row, and its mirrored places near the ends
    frame = Window.partitionBy(*by).orderBy("hf_at").rangeBetween(-radius, radius)
    taps = F.collect_list(F.when(F.col("hf_v").isNotNull(), F.struct("hf_at", "hf_v"))).over(frame)
    own = rows.withColumn("hf_taps", taps).where(F.col("hf_at") == F.col(x))
    weights = F.array(*map(F.lit, w))
    weight = lambda t: F.get(weights, (t["hf_at"] - F.col("hf_at") + radius).cast("int"))
    total = lambda f: F.aggregate("hf_taps", F.lit(0.0), lambda a, t: a + f(t))
    return own.where(F.size("hf_taps") > 0).select(*by, x, (total(lambda t: weight(t) * t["hf_v"]) / total(weight)).alias(name)).distinct()


def threshold_crossing(df: DataFrame, by: list[str], x: str, value: str, thresholds: list[float]) -> DataFrame:
    """Last place of each line whose value reaches a threshold, with the sub-cell fraction towards the next row."""
    w = Window.partitionBy(*by).orderBy(x)
    rows = df.withColumn("hf_next", F.lead(value).over(w))
    t = F.explode(F.array(*map(F.lit, thresholds)))
    hit = rows.select("*", t.alias("threshold")).where(F.col(value) >= F.col("threshold"))
    last = hit.groupBy(*by, "threshold").agg(F.max(F.struct(x, F.col(value).alias("v"), F.col("hf_next").alias("n"))).alias("m"))
    share = F.coalesce((F.col("m.v") - F.col("threshold")) / F.when(F.col("m.v") > F.col("m.n"), F.col("m.v") - F.col("m.n")), F.lit(0.0))
    return last.select(*by, "threshold", (F.col(f"m.{x}") + share).alias("surface"))


def steepest_edge(df: DataFrame, by: list[str], x: str, value: str, lo: int, hi: int) -> DataFrame:
    """Place of the smallest gradient within [lo, hi] of each profile; strength is minus that gradient."""
    g = gradient(df, by, x, value).where(F.col(x).between(lo, hi))
    return g.groupBy(*by).agg(F.min_by(x, F.struct("gradient", x)).alias("edge"), (-F.min("gradient")).alias("strength"))


def contiguous_folds(df: DataFrame, by: list[str], order: str, folds: int = 5) -> DataFrame:
    """floor(folds * i / n) along an ordered path."""
    w = Window.partitionBy(*by)
    return df.withColumn("fold", F.floor(folds * (F.row_number().over(w.orderBy(order)) - 1) / F.count("*").over(w)))


def hashed_sample(df: DataFrame, block: str, key: str, seed: str, n: int) -> DataFrame:
    """The first n rows of each block by sha256(seed:key); blinded ids come from another hash."""
    h = lambda salt: F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256)
    out = df.withColumn("hf_h", h(seed)).withColumn("rank", F.row_number().over(Window.partitionBy(block).orderBy("hf_h"))).where(F.col("rank") <= n)
    return out.withColumn("case_hash", h(f"{seed}-case")).drop("hf_h")


def systematic_sample(df: DataFrame, by: list[str], order: list[str], every: int) -> DataFrame:
    """Every n-th row of each group from the first on; parity says fit or holdout."""
    rows = numbered(df, by, order, "place").withColumn("place", F.col("place") - 1).where(F.col("place") % every == 0)
    return rows.withColumn("role", F.when((F.col("place") / every).cast("int") % 2 == 0, "fit").otherwise("holdout"))


def group_centred(df: DataFrame, group: str, value: str) -> DataFrame:
    """Value minus its group's median; weights 1 / group size, scaled to mean 1."""
    sizes = df.groupBy(group).agg(F.count("*").alias("hf_n"))
    groups, rows = sizes.agg(F.count(group), F.coalesce(F.sum("hf_n"), F.lit(0))).first()
    facts = beside(sizes, medians(df, [group], value, "hf_m"), [group], "left")
    return beside(df, facts, [group]).select(*df.columns, (F.col(value) - F.col("hf_m")).alias("centred"), (F.lit(float(rows) / max(1, groups)) / F.col("hf_n")).alias("weight"))


def cyclic_windows(nodes: DataFrame, by: list[str], order: str, node: str, k: int) -> DataFrame:
    """k consecutive nodes of a ring for every start, wrapping around."""
    w = Window.partitionBy(*by)
    ring = nodes.withColumns({"place": F.row_number().over(w.orderBy(order)) - 1, "n": F.count("*").over(w)})
    spread = ring.select(*by, F.col(node).alias("member"), "n", "place", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("step"))
    return spread.withColumn("start", F.pmod(F.col("place") - F.col("step"), F.col("n"))).where(F.col("step") < F.col("n")).select(*by, "start", "step", "member")


def nearest_fraction(df: DataFrame, key: str, distance: Column, share: float) -> DataFrame:
    """The round(n * share) rows nearest an anchor, ties by key. Beyond one task's reach: the distance quantile is
    taken first, rows clearly inside stay without a sort, and only rows near it are ranked."""
    rows = df.withColumn("distance", distance)
    n = rows.count()
    count = int(n * share + 0.5)
    if not count:
        return rows.limit(0)
    lo, hi = rows.approxQuantile("distance", [max(0.0, count / n - 0.01), min(1.0, count / n + 0.01)], 0.002)
    inside, band = rows.where(F.col("distance") < lo), rows.where(F.col("distance").between(lo, hi))
    left = count - inside.count()
    return inside.unionByName(band.orderBy("distance", key).limit(left))


def representative(df: DataFrame, by: list[str], unit: str, value: str, q: float) -> DataFrame:
    """The unit whose value is closest to a quantile of its group, lowest id on ties."""
    quantiles = df.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias("hf_q"))
    return df.join(quantiles, by).groupBy(*by).agg(F.min_by(unit, F.struct(F.abs(F.col(value) - F.col("hf_q")), F.col(unit))).alias("unit"))


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def multiply_assigned(assignments: DataFrame, strategy: list[str], key: str) -> DataFrame:
    """Rows that a strategy assigns more or less than once."""
    return assignments.groupBy(*strategy, key).agg(F.count("*").alias("times")).where("times <> 1")


def equality_audit(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-7) -> DataFrame:
    """For each value column: rows on either side alone, rows that differ by more than the tolerance, largest difference."""
    a = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(1).alias("hf_old"))
    b = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(1).alias("hf_new"))
    both = a.join(b, keys, "full")
    alone = [F.count_if(F.col("hf_new").isNull()).alias("only_old"), F.count_if(F.col("hf_old").isNull()).alias("only_new")]
    gap = lambda v: F.abs(F.col(f"old_{v}") - F.col(f"new_{v}"))
    return both.agg(*alone, *[f.alias(n) for v in values for f, n in ((F.count_if(gap(v) > tolerance), f"differ_{v}"), (F.max(gap(v)), f"max_{v}"))])
