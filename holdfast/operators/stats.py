"""Exact tests, intervals and audits (inventory J)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import e

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .holdout import md5_number
from .ranks import beside, numbered, running, tied


DRAWS = 10_000  # sampled patterns of groups that are too large for all of them


def by_size(df: DataFrame, by: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups with `most` rows at most, and those of the others."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("hf_size"))
    return beside(df, sizes.where(F.col("hf_size") <= most), by), beside(df, sizes.where(F.col("hf_size") > most), by)


def uniform(seed: str, *keys: str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)


def poisson_one(u: Column, most: int = 20) -> Column:
    """The Poisson number of mean 1 at a uniform number: how many steps of its distribution lie at or below it."""
    total, steps, mass = F.lit(0), [], 1 / e
    upto = mass
    for i in range(most):
        steps.append(upto)
        mass /= i + 1
        upto += mass
    for step in steps:
        total = total + (u >= step).cast("int")
    return total


def bootstrap_median(df: DataFrame, by: list[str], order: str, value: str, draws: int, seed: str, most: int = 10_000) -> DataFrame:
    """(by, low, high): 2.5% and 97.5% of medians of resamples. Groups of `most` rows at most are drawn from with
    replacement, by md5(seed:draw:i) mod n; in larger ones each row has a Poisson weight of mean 1 in each draw, and medians are
    of weighted ranks, so no draw of a group is gathered. Rows are multiplied by the number of draws."""
    few, many = by_size(df.where(F.col(value).isNotNull()), by, most)
    rows = numbered(few, by, [order], "hf_i").withColumn("hf_i", F.col("hf_i") - 1)
    picks = rows.select(*by, F.col("hf_size").alias("hf_n"), "hf_i", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("hf_at", md5_number(F.lit(seed), F.col("draw"), F.col("hf_i")) % F.col("hf_n"))
    drawn = beside(picks, rows.select(*by, F.col("hf_i").alias("hf_at"), F.col(value).alias("hf_v")), [*by, "hf_at"])
    middle = drawn.groupBy(*by, "draw").agg(F.median("hf_v").alias("m"))
    if not many.isEmpty():
        each = numbered(many, by, [order], "hf_i").select(*by, F.col(value).alias("hf_v"), "hf_i", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
        weighed = each.withColumn("w", poisson_one(uniform(seed, "draw", "hf_i")).cast("long")).where("w > 0").groupBy(*by, "draw", "hf_v").agg(F.sum("w").alias("w"))
        ranked = running(weighed, [*by, "draw"], ["hf_v"], {"before": F.col("w")})
        whole = ranked.groupBy(*by, "draw").agg(F.sum("w").alias("hf_all"))
        ranked = beside(ranked, whole, [*by, "draw"])
        holds = lambda c: F.when((F.col("before") <= c) & (c < F.col("before") + F.col("w")), F.col("hf_v"))
        found = ranked.groupBy(*by, "draw").agg(F.max(holds(F.floor((F.col("hf_all") - 1) / 2))).alias("a"), F.max(holds(F.floor(F.col("hf_all") / 2))).alias("b"))
        middle = middle.unionByName(found.select(*by, "draw", ((F.col("a") + F.col("b")) / 2).alias("m")))
    return middle.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


HELD = 256  # groups whose totals a task holds at once


def sign_bits(starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The lowest bit of xxhash64(seed, draw, number) as 0 or 1, a row for each number and a column for each draw. starts: xxhash64(seed, draw),
    which is where Spark's hash goes on with the next column, here a long."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    x = (starts.astype(np.uint64) + five + np.uint64(8)) ^ (turned(numbers.astype(np.uint64) * two, 31) * one)[:, None]
    x = turned(x, 27)
    x *= one
    x += four
    x ^= x >> np.uint64(33)
    x *= two
    x ^= x >> np.uint64(29)
    x *= three
    return (x ^ (x >> np.uint64(32))) & np.uint64(1)


def sampled_flips(rows: DataFrame, by: list[str], order: str, size: str, draws: int, seed: str) -> DataFrame:
    """(by, draw, total): sums of `size` with random signs, for each draw. Each task sums its own rows first, all draws at once; no row
    is copied for a draw."""
    each = numbered(rows, by, [order], "hf_i").select(*by, F.col(size).cast("double").alias("hf_s"), "hf_i")
    seeds = rows.sparkSession.range(1, draws + 1).select("id", F.xxhash64(F.lit(seed), F.col("id").cast("int")).alias("h")).collect()  # one for each draw
    starts = np.array([r["h"] for r in sorted(seeds)], np.int64)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = each.repartition(tasks, "hf_i")  # few bytes, but much work: Spark would join them to few tasks
    schema = T.StructType([*[each.schema[b] for b in by], T.StructField("totals", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        totals: dict = {}

        def flushed() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([totals[k] for k in keys], pa.list_(pa.float64()))], names=schema.names)

        for frame in frames:
            kinds = [frame.schema.field(b).type for b in by]
            groups: dict = {}
            for i, k in enumerate(zip(*[frame.column(b).to_pylist() for b in by], strict=True) if by else [()] * frame.num_rows):
                groups.setdefault(k, []).append(i)
            s, number = (frame.column(c).to_numpy(zero_copy_only=False) for c in ("hf_s", "hf_i"))
            for k, at in groups.items():
                if k not in totals:
                    if len(keys) == HELD:
                        yield flushed()
                        keys.clear()
                        totals.clear()
                    keys.append(k)
                    totals[k] = np.zeros(draws)
                for a in range(0, len(at), 16):  # a block that stays in the processor's cache
                    some = at[a : a + 16]
                    totals[k] += s[some] @ (sign_bits(starts, number[some]) * 2.0 - 1.0)
        if keys:
            yield flushed()

    parts = each.mapInArrow(run, schema).select(*by, F.posexplode("totals").alias("draw", "total"))
    return parts.groupBy(*by, (F.col("draw") + 1).alias("draw")).agg(F.sum("total").alias("total"))


def sign_flip(df: DataFrame, by: list[str], difference: str, most: int = 20, draws: int = DRAWS, seed: str = "flip") -> DataFrame:
    """(by, n, observed, p, patterns): share of the sign patterns whose mean is at least as far from 0. All 2^n patterns
    of groups of `most` differences at most; `draws` seeded ones of larger groups, with the observed one among them."""
    few, many = by_size(df.where(F.col(difference).isNotNull()), by, most)
    groups = few.groupBy(*by).agg(F.collect_list(difference).alias("d"))
    n = F.size("d")
    mean = F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / n
    each = groups.select(*by, "d", mean.alias("observed"), F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), n).cast("long") - 1)).alias("pattern"))
    signed = F.transform("d", lambda x, i: F.when(F.floor(F.col("pattern") / F.pow(F.lit(2.0), i)) % 2 == 1, -x).otherwise(x))
    flipped = F.abs(F.aggregate(signed, F.lit(0.0), lambda a, x: a + x) / F.size("d")) >= F.abs("observed") - 1e-12
    out = each.groupBy(*by).agg(F.first(F.size("d")).cast("long").alias("n"), F.first("observed").alias("observed"), F.avg(flipped.cast("double")).alias("p"), F.count("*").alias("patterns"))
    if many.isEmpty():
        return out
    seen = many.groupBy(*by).agg(F.count("*").alias("n"), F.avg(difference).alias("observed"))
    drawn = beside(sampled_flips(many, by, difference, difference, draws, seed), seen, by)
    far = F.count_if(F.abs(F.col("total")) >= (F.abs("observed") - 1e-12) * F.col("n"))
    return out.unionByName(drawn.groupBy(*by, "n", "observed").agg(((far + 1) / (draws + 1)).alias("p")).withColumn("patterns", F.lit(draws).cast("long")))


def log_factorial(n: Column) -> Column:
    return F.aggregate(F.when(n > 1, F.sequence(F.lit(2).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, x: a + F.log(x))


def sign_test(df: DataFrame, by: list[str], difference: str) -> DataFrame:
    """(by, n, wins, p): two-sided binomial p of positive differences, zeros left out."""
    d = F.col(difference)
    counts = df.where(d != 0).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(d > 0).alias("wins"))
    n, few = F.col("n"), F.least("wins", F.col("n") - F.col("wins"))
    first = -n * F.log(F.lit(2.0))
    tail = running_sum(first, F.lit(1).cast("long"), few, lambda i: F.log((n - i + 1) / i))
    return counts.withColumn("p", F.least(F.lit(1.0), 2 * tail)).select(*by, "n", "wins", "p")


def running_sum(first: Column, lo: Column, hi: Column, step, keep=None) -> Column:
    """exp(first) + exp(first + step(lo)) + ... + exp(first + step(lo) + ... + step(hi)), of the terms whose logarithm
    is at most keep: one step for each term. keep is worked out once and handed on from step to step."""
    keep = F.lit(float("inf")) if keep is None else keep
    state = lambda x, s, k: F.struct(x.cast("double").alias("x"), s.alias("s"), k.alias("k"))
    add = lambda x, k: F.when(x <= k, F.exp(x)).otherwise(0.0)
    places = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    def turn(acc: Column, i: Column) -> Column:
        x = acc["x"] + step(i)
        return state(x, acc["s"] + add(x, acc["k"]), acc["k"])

    return F.aggregate(places, state(first, add(first, keep), keep), turn, lambda acc: acc["s"])


def fisher(tables: DataFrame, by: list[str], a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> DataFrame:
    """(by, odds, p) of 2 x 2 tables: two-sided, over all tables with the same margins that are no likelier."""
    a, b, c, d = (F.col(x).cast("long") for x in (a, b, c, d))
    r1, r2, c1 = a + b, c + d, a + c
    mass = lambda x: log_factorial(r1) + log_factorial(r2) + log_factorial(c1) + log_factorial(b + d) - log_factorial(r1 + r2) - log_factorial(x) - log_factorial(r1 - x) - log_factorial(c1 - x) - log_factorial(r2 - c1 + x)
    lo = F.greatest(F.lit(0).cast("long"), c1 - r2)
    p = running_sum(mass(lo), lo + 1, F.least(r1, c1), lambda x: F.log((r1 - x + 1) * (c1 - x + 1) / (x * (r2 - c1 + x))), mass(a) + 1e-7)
    return tables.select(*by, F.when((b * c) != 0, a * d / (b * c)).alias("odds"), F.least(F.lit(1.0), p).alias("p"))


def rank_sum(df: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """(by, auc, z): U of the first group over n1 * n2 from average ranks, and its tie-corrected z."""
    ties = tied(df.withColumn("hf_first", first), by, value, firsts=F.count_if("hf_first"))
    t = F.col("n").cast("double")
    out = ties.groupBy(*by).agg(F.sum(t).alias("n"), F.sum("firsts").cast("double").alias("n1"), F.sum(F.col("firsts") * (F.col("before") + (t + 1) / 2)).alias("r1"), F.sum(t * (t * t - 1)).alias("ties"))
    n, n1 = F.col("n"), F.col("n1")
    n2, u = n - n1, F.col("r1") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    return out.select(*by, (u / (n1 * n2)).alias("auc"), ((u - n1 * n2 / 2) / F.sqrt(var)).alias("z"))


def signed_rank(df: DataFrame, by: list[str], difference: str, most: int = 200, draws: int = DRAWS, seed: str = "rank") -> DataFrame:
    """(by, n, w, p, patterns): two-sided signed-rank test, zeros left out. Of groups of `most` differences at most it is exact (patterns null):
    the distribution of the rank sum is built by adding one rank after another (doubled, so that average ranks are whole),
    over about n squared places. Of larger groups p is over `draws` seeded sign patterns and the observed one."""
    d = df.where(F.col(difference) != 0).withColumn("hf_abs", F.abs(difference))
    ties = tied(d, by, "hf_abs").select(*by, "hf_abs", (2 * F.col("before") + F.col("n") + 1).cast("long").alias("hf_r"))
    few, many = by_size(beside(d, ties, [*by, "hf_abs"]), by, most)
    won = F.sum(F.when(F.col(difference) > 0, F.col("hf_r")).otherwise(0))
    g = few.groupBy(*by).agg(F.count("*").alias("n"), won.alias("w2"), F.sum("hf_r").alias("all2"), F.collect_list(F.col("hf_r").cast("int")).alias("ranks"))
    start = F.array_prepend(F.array_repeat(F.lit(0.0), F.col("all2").cast("int")), F.lit(1.0))
    counts = F.aggregate("ranks", start, lambda acc, r: F.transform(acc, lambda x, i: (x + F.when(i >= r, F.get(acc, i - r)).otherwise(0.0)) / 2))
    low = F.least("w2", F.col("all2") - F.col("w2")).cast("int")
    p = 2 * F.aggregate(F.slice(counts, 1, low + 1), F.lit(0.0), lambda a, x: a + x)
    out = g.select(*by, "n", (F.col("w2") / 2.0).alias("w"), F.least(F.lit(1.0), p).alias("p"), F.lit(None).cast("long").alias("patterns"))
    if many.isEmpty():
        return out
    seen = many.groupBy(*by).agg(F.count("*").alias("n"), won.alias("w2"), F.sum("hf_r").alias("all2"))
    drawn = beside(sampled_flips(many, by, difference, "hf_r", draws, seed), seen, by)
    far = F.count_if(F.abs(F.col("total")) >= F.abs(2 * F.col("w2") - F.col("all2")))
    return out.unionByName(drawn.groupBy(*by, "n", "w2").agg(((far + 1) / (draws + 1)).alias("p")).select(*by, "n", (F.col("w2") / 2.0).alias("w"), "p", F.lit(draws).cast("long").alias("patterns")))


def method_comparison(errors: DataFrame, unit: list[str], method: str, error: str, reference: str, others: list[str], blocks: str) -> DataFrame:
    """Reference minus each other method: units, median difference, median of block medians, blocks that favour
    the other one, and the sign-flip p over block medians."""
    units = errors.groupBy(*unit, method).agg(F.avg(error).alias("e"))
    wide = units.groupBy(*unit).pivot(method, [reference, *others]).agg(F.first("e"))
    diffs = reduce(DataFrame.unionByName, [wide.select(F.lit(o).alias("method"), *unit, (F.col(reference) - F.col(o)).alias("d")) for o in others]).where("d is not null")
    per_block = diffs.groupBy("method", blocks).agg(F.median("d").alias("d"))
    flips = sign_flip(per_block, ["method"], "d").select("method", "p")
    over = per_block.groupBy("method").agg(F.count("*").alias("blocks"), F.count_if(F.col("d") > 0).alias("favour"), F.median("d").alias("block_median"))
    return diffs.groupBy("method").agg(F.count("*").alias("units"), F.median("d").alias("median")).join(over, "method").join(flips, "method")


def translation_change(df: DataFrame, target: str, predictions: list[str], shift: float) -> DataFrame:
    """For each prediction the largest change of the absolute error when it and the target move together."""
    rows = df.select(target, F.explode(F.array(*[F.struct(F.lit(p).alias("prediction"), F.col(p).alias("v")) for p in predictions])).alias("s")).select(target, "s.*")
    change = F.abs(F.abs(F.col("v") + shift - (F.col(target) + shift)) - F.abs(F.col("v") - F.col(target)))
    return rows.groupBy("prediction").agg(F.max(change).alias("largest_change"))


def confidence_strata(df: DataFrame, by: list[str], width: str, error: str) -> DataFrame:
    """Count and median error of rows below and above their group's median width."""
    middle = df.groupBy(*by).agg(F.median(width).alias("hf_m"))
    strata = df.join(middle, by).withColumn("stratum", F.when(F.col(width) <= F.col("hf_m"), "confident").otherwise("unsure"))
    return strata.groupBy(*by, "stratum").agg(F.count("*").alias("n"), F.median(error).alias("median_error"))


def quantile_table(df: DataFrame, by: list[str], cols: list[str], qs: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(by, measure, q05, q50, q95) of several columns."""
    q = [F.percentile(c, F.array(*map(F.lit, qs))).alias(c) for c in cols]
    wide = df.groupBy(*by).agg(*q)
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("q")) for c in cols]))
    return wide.select(*by, long.alias("s")).select(*by, "s.measure", *[F.get("s.q", F.lit(i)).alias(f"q{round(100 * x):02d}") for i, x in enumerate(qs)])


def observer_agreement(clicks: DataFrame, case: str, view: str, a: Column, b: Column) -> DataFrame:
    """Per case: the median of both observers in both views, signed and absolute differences, cross-view gap."""
    per_view = clicks.groupBy(case, view).agg(F.median(a).alias("ma"), F.median(b).alias("mb"))
    out = per_view.groupBy(case).agg(F.median("ma").alias("a"), F.median("mb").alias("b"), (F.max("ma") - F.min("ma")).alias("view_gap"))
    return out.withColumns({"signed": F.col("a") - F.col("b"), "absolute": F.abs(F.col("a") - F.col("b"))})


def persistence(base: DataFrame, others: DataFrame, dims: list[str], key: str, setting: str, radius: float, least: int) -> DataFrame:
    """(key, hits): settings in which a base point has a partner within a radius; kept from `least` on."""
    from .spatial import range_join

    settings = others.select(setting).distinct()
    spread = base.crossJoin(F.broadcast(settings))
    pairs = range_join(spread, others, radius, dims, key, key, (setting,), strict=False)
    return pairs.groupBy(F.col("query_id").alias(key)).agg(F.count_distinct(setting).alias("hits")).where(F.col("hits") >= least)


def consistency(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, holds): aggregates that must be true."""
    out = df.agg(*[c.alias(n) for n, c in checks.items()])
    return out.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("holds")) for n in checks])).alias("s")).select("s.*")
