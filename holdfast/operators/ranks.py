"""Sums and ranks along the order of a group, for groups of any size.

Rows are dealt to ranges of (group, order), so a group that holds most rows lies in many ranges. Sums run inside each
range; what the ranges before it hold of the same group is added. Only the first group of a range can have begun in
another one, so what is added has a row for each range at most: that is broadcast, whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """rows with the columns in `sums`: each the sum of its expression over the rows that stand before in the group
    (0 for the first). Nulls in `by` are a group. Rows that tie in `order` stand next to each other in any order, and in
    one range. Names hf_* are this function's own."""
    named = rows.withColumns({f"hf_{n}": c for n, c in sums.items()})
    spread = named.repartitionByRange(*([ranges] if ranges else []), *by, *order).withColumn("hf_range", F.spark_partition_id())
    spread = materialise(spread)
    totals = spread.groupBy("hf_range", *by).agg(*[F.sum(f"hf_{n}").alias(f"hf_{n}") for n in sums])
    ahead = Window.partitionBy(*by).orderBy("hf_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("hf_range").alias("hf_to"), *[F.col(b).alias(f"hf_by{i}") for i, b in enumerate(by)], *[F.sum(f"hf_{n}").over(ahead).alias(f"hf_more_{n}") for n in sums], F.count("*").over(ahead).alias("hf_earlier"))
    carried = carried.where("hf_earlier > 0").drop("hf_earlier")
    own = Window.partitionBy("hf_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = spread.withColumns({n: F.sum(f"hf_{n}").over(own) for n in sums})
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"hf_by{i}")) for i, b in enumerate(by)], F.col("hf_range") == F.col("hf_to"))
    both = inside.join(F.broadcast(carried), same, "left")  # a row for each range at most
    zero = F.lit(0)
    return both.select(*rows.columns, *[(F.coalesce(n, zero) + F.coalesce(f"hf_more_{n}", zero)).alias(n) for n in sums])


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str, ranges: int | None = None) -> DataFrame:
    """rows with `name`: the row's number in its group, from 1."""
    return running(rows, by, order, {name: F.lit(1).cast("long")}, ranges).withColumn(name, F.col(name) + 1)


def beside(rows: DataFrame, facts: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """rows joined with facts on columns of one name, where null equals null."""
    named = facts.withColumnsRenamed({c: f"hf_on_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"hf_on_{c}")) for c in on], F.lit(True))
    return rows.join(named, same, how).drop(*[f"hf_on_{c}" for c in on])


def tied(rows: DataFrame, by: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """(by, value, n, before, sums): each different value with its number of rows, that of the rows with a smaller
    value, and sums of its own rows. Equal values are counted in each task first."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in sums.items()])
    return running(counts, by, [value], {"before": F.col("n")})


def order_values(rows: DataFrame, by: Sequence[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(by, n, places): the values at given places (from 0, expressions of the group's size n) of each group's ascending values."""
    ties = materialise(tied(rows.where(F.col(value).isNotNull()), by, value).withColumnRenamed("n", "hf_own"))
    sizes = ties.groupBy(*by).agg(F.sum("hf_own").alias("n"))
    at = beside(ties, sizes, by) if by else ties.crossJoin(F.broadcast(sizes))  # one row
    inside = lambda c: (F.col("before") <= c) & (c < F.col("before") + F.col("hf_own"))
    return at.groupBy(*by, "n").agg(*[F.max(F.when(inside(c), F.col(value))).alias(k) for k, c in places.items()])


def medians(rows: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(by, name): each group's median, the mean of the two middle values of an even number."""
    both = order_values(rows, by, value, {"hf_low": F.floor((F.col("n") - 1) / 2), "hf_high": F.floor(F.col("n") / 2)})
    return both.select(*by, ((F.col("hf_low") + F.col("hf_high")) / 2).alias(name))


SKETCH = 10_000  # a sketch places a value to within this share of the rows
MARGIN = 4  # such shares on both sides of a quantile are looked at exactly


def quantiles(rows: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(by, n, names): exact quantiles (as `percentile`: linear between the two nearest places) of few groups of any size; groups
    without values are left out.

    A sketch of each group names two values around each quantile. Of the rows, only those between them keep their
    value; the others are counted. Equal values are counted in each task first, so what is shuffled is a small share of the
    rows. Where a sketch missed (none should), the places are found by sorting ranges of all rows."""
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("hf_v"))
    names, share = list(wanted), MARGIN / SKETCH
    at = [[q - share, q + share] for q in wanted.values()]
    probes = F.percentile_approx("hf_v", F.array(*[F.lit(min(1.0, max(0.0, x))) for pair in at for x in pair]), F.lit(SKETCH))
    facts = materialise(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("hf_v").alias("hf_least"), F.max("hf_v").alias("hf_most"), probes.alias("hf_q")))
    ends = [(F.col("hf_least") if lo <= 0 else F.get("hf_q", F.lit(2 * i)), F.col("hf_most") if hi >= 1 else F.get("hf_q", F.lit(2 * i + 1))) for i, (lo, hi) in enumerate(at)]
    around = facts.select(*by, *[c.alias(f"hf_{e}{i}") for i, pair in enumerate(ends) for e, c in zip(("lo", "hi"), pair, strict=True)])
    named = F.broadcast(around)  # a row for each group
    both = beside(rows, named, by) if by else rows.crossJoin(named)
    v = F.col("hf_v")
    each = [F.when(v <= F.col(f"hf_hi{i}"), F.struct(F.lit(i).alias("i"), F.when(v >= F.col(f"hf_lo{i}"), v).alias("v"))) for i in range(len(names))]
    counts = both.select(*by, F.explode(F.array(*each)).alias("hf_s")).where(F.col("hf_s").isNotNull()).groupBy(*by, F.col("hf_s.i").alias("hf_i"), F.col("hf_s.v").alias("hf_v")).agg(F.count("*").alias("hf_own"))
    upto = Window.partitionBy(*by, "hf_i").orderBy(F.col("hf_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("hf_upto", F.sum("hf_own").over(upto)).where(F.col("hf_v").isNotNull())
    ranked = beside(ranked, F.broadcast(facts.select(*by, "n")), by) if by else ranked.crossJoin(F.broadcast(facts.select("n")))
    place = (F.col("n") - 1) * F.get(F.array(*[F.lit(float(q)) for q in wanted.values()]), F.col("hf_i"))
    low, high = F.floor(place), F.ceil(place)
    holds = lambda c: F.max(F.when((F.col("hf_upto") - F.col("hf_own") <= c) & (c < F.col("hf_upto")), F.col("hf_v")))
    found = ranked.groupBy(*by, "n", "hf_i").agg(F.first(place).alias("hf_p"), holds(low).alias("hf_a"), holds(high).alias("hf_b"))
    p, a, b = F.col("hf_p"), F.col("hf_a"), F.col("hf_b")
    between = F.when(F.floor(p) == F.ceil(p), a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)
    wide = found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("hf_i") == i, between.cast("double"))).alias(name) for i, name in enumerate(names)])
    got = materialise(beside(facts.select(*by, "n"), wide.drop("n"), by, "left") if by else facts.select("n").crossJoin(wide.drop("n")).where("n > 0"))
    missed = got.where(reduce(lambda x, y: x | y, [F.col(name).isNull() for name in names]))
    if missed.isEmpty():
        return got
    again = beside(rows, missed.select(*by), by) if by else rows
    places = {f"hf_{e}{i}": f((F.col("n") - 1) * q) for i, q in enumerate(wanted.values()) for e, f in (("a", F.floor), ("b", F.ceil))}
    slow = order_values(again, by, "hf_v", places)
    mixed = lambda i, q: F.when(F.floor((F.col("n") - 1) * q) == F.ceil((F.col("n") - 1) * q), F.col(f"hf_a{i}")).otherwise((F.ceil((F.col("n") - 1) * q) - (F.col("n") - 1) * q) * F.col(f"hf_a{i}") + ((F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)) * F.col(f"hf_b{i}"))
    slow = slow.select(*by, "n", *[mixed(i, q).cast("double").alias(name) for i, (name, q) in enumerate(wanted.items())])
    return got.dropna(subset=names).unionByName(slow)
