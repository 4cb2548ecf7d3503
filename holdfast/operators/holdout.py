"""Holdout designs (inventory I01-I06, I34, I35). Roles come from ids and coordinates only, never from targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered
from .spatial import nearest, range_join


def md5_number(*parts: Column) -> Column:
    """The first 12 hexadecimal digits of the md5 of joined parts, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")


def smallest(df: DataFrame, order: list, count: int) -> DataFrame:
    """The first `count` rows in a full order (a distributed top-n, not a global window)."""
    return df.orderBy(*order).limit(count)


def make_splits(points: DataFrame, key: str, x: str, y: str, share: float = 0.25, buffer: float = 0.12, seed: str = "42") -> DataFrame:
    """(strategy, key, assignment) of random, spatial and buffered holdouts with equally many test rows. Random
    takes the smallest hashes; spatial the rows nearest a hashed anchor; buffered the same, and leaves out
    training rows closer than buffer * span to a test row."""
    p = points.select(key, x, y)
    n, x0, x1, y0, y1 = p.agg(F.count("*"), F.min(x), F.max(x), F.min(y), F.max(y)).first()
    count = int(n * share + 0.5)
    hashed = p.withColumn("hf_h", md5_number(F.lit(seed), F.col(key)))
    random = smallest(hashed, ["hf_h", key], count).select(key)
    ax, ay = hashed.orderBy("hf_h", key).select(x, y).first()
    near = p.withColumn("hf_d", F.sqrt((F.col(x) - ax) * (F.col(x) - ax) + (F.col(y) - ay) * (F.col(y) - ay)))
    region = smallest(near, ["hf_d", key], count).select(key, x, y)
    radius = buffer * max(x1 - x0, y1 - y0)
    close = range_join(p.join(region, key, "left_anti"), region, radius, [x, y], key, key).select(F.col("query_id").alias(key)).distinct()

    def roles(strategy: str, test: DataFrame, left_out: DataFrame | None = None) -> DataFrame:
        out = p.select(key).join(test.select(key).withColumn("hf_test", F.lit(True)), key, "left")
        role = F.when(F.col("hf_test"), "test")
        if left_out is not None:
            out = out.join(left_out.withColumn("hf_out", F.lit(True)), key, "left")
            role = role.when(F.col("hf_out"), "excluded")
        return out.select(F.lit(strategy).alias("strategy"), key, role.otherwise("train").alias("assignment"))

    return roles("random", random).unionByName(roles("spatial", region)).unionByName(roles("buffered", region, close))


MOST_FOLDS = 1_000


def dealt(df: DataFrame, block: str, name: str, own: bool, most: int = MOST_FOLDS) -> DataFrame:
    """df with each row once for each fold (its own too, or only others), in the column `name`. Folds are few by their
    meaning; over `most` are an error. Rows without a block are only dealt with `own`."""
    kind = dict(df.dtypes)[block]
    folds = [r[0] for r in df.select(block).distinct().limit(most + 1).collect()]
    if len(folds) > most:
        raise ValueError(f"over {most} folds: every row would be copied to each")
    names = F.array(*[F.lit(f).cast(kind) for f in folds]).cast(f"array<{kind}>")
    return df.withColumn(name, F.explode(names if own else F.filter(names, lambda f: f != F.col(block))))


def leave_block_out(df: DataFrame, block: str) -> DataFrame:
    """Every row once for each fold: train where its block isn't the fold."""
    return dealt(df, block, "fold", True).withColumn("role", F.when(F.col(block) == F.col("fold"), "test").otherwise("train"))


def dealt_up_to(loads: np.ndarray, size: int, last: np.ndarray) -> np.ndarray:
    """How many groups of a size have been dealt once every fold with a load of at most `last` has taken one: fold j's t-th
    group comes at load loads[j] + (t - 1) * size. A row for each value of last, a column for each fold."""
    return np.maximum(0, (last[:, None] - loads[None, :]) // size + 1)


def fold_of(loads: np.ndarray, size: int, place: np.ndarray) -> np.ndarray:
    """The fold of the place-th (from 1) of many groups of one size, dealt one after another to the lightest fold."""
    if size <= 0:  # nothing grows: all go to the lightest
        return np.full(len(place), int(loads.argmin()))
    low, high = np.full(len(place), int(loads.min())), loads.min() + (place + 1) * size
    while (low < high).any():
        middle = (low + high) // 2
        enough = dealt_up_to(loads, size, middle).sum(axis=1) >= place
        low, high = np.where(enough, low, middle + 1), np.where(enough, middle, high)
    rest = place - dealt_up_to(loads, size, low - 1).sum(axis=1)  # its place among the folds that take one at this very load
    takes = (loads[None, :] <= low[:, None]) & ((low[:, None] - loads[None, :]) % size == 0)
    return (np.cumsum(takes, axis=1) >= rest[:, None]).argmax(axis=1)


def balanced_folds(groups: DataFrame, group: str, size: str, folds: int) -> DataFrame:
    """(group, fold): the largest group first (of equal ones the first by name), each to the lightest fold so far (lowest number
    on ties). Groups of one size are dealt together: the folds' loads before each different size are enough to tell where
    each of its groups goes, by its number among them. Different sizes are few (at most the root of twice the number of rows
    that the groups have together), and all that the driver goes through."""
    loads, before = np.zeros(folds, np.int64), []
    sizes = groups.groupBy(F.col(size).cast("long").alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect()
    for s, n in sizes:
        before.append((s, loads.tolist()))
        loads = loads + s * taken(loads, s, n) if s > 0 else loads
    starts = groups.sparkSession.createDataFrame(before, "hf_s long, hf_loads array<long>")
    placed = numbered(groups.withColumn("hf_s", F.col(size).cast("long")), ["hf_s"], [group], "hf_i").join(starts, "hf_s")

    @F.pandas_udf("int")
    def chosen(s: pd.Series, i: pd.Series, load: pd.Series) -> pd.Series:
        out = np.zeros(len(s), np.int32)
        for value, rows in s.groupby(s).indices.items():
            out[rows] = fold_of(np.array(load.iloc[rows[0]], np.int64), int(value), i.to_numpy()[rows])
        return pd.Series(out)

    return placed.select(group, chosen("hf_s", "hf_i", "hf_loads").alias("fold"))


def taken(loads: np.ndarray, size: int, n: int) -> np.ndarray:
    """How many of n groups of a size each fold takes."""
    low, high = int(loads.min()), int(loads.min()) + (n + 1) * size
    while low < high:
        middle = (low + high) // 2
        if dealt_up_to(loads, size, np.array([middle])).sum() >= n:
            high = middle
        else:
            low = middle + 1
    sure = dealt_up_to(loads, size, np.array([low - 1]))[0]
    takes = (loads <= low) & ((low - loads) % size == 0)
    return sure + (takes & (np.cumsum(takes) <= n - sure.sum()))


def guarded_bands(df: DataFrame, value: Column, edges: list[tuple[float, float]], guard: float) -> DataFrame:
    """For each band the role of every row: test inside, guard within `guard` of it, train beyond."""
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(edges)]))
    rows = df.withColumn("hf_v", value).select("*", bands.alias("b")).select("*", "b.*").drop("b")
    v = F.col("hf_v")
    role = F.when((v >= F.col("lo")) & (v < F.col("hi")), "test").when((v >= F.col("lo") - guard) & (v < F.col("hi") + guard), "guard").otherwise("train")
    return rows.withColumn("role", role).drop("hf_v", "lo", "hi")


def nearest_block(units: DataFrame, known: DataFrame, key: str, dims: list[str], block: str) -> DataFrame:
    """(key, block): units take the block of the nearest block centroid."""
    centres = known.groupBy(block).agg(*[F.avg(d).alias(d) for d in dims])
    return nearest(units, centres, dims, key, block).select(F.col("query_id").alias(key), F.col("neighbour_id").alias(block))


def row_numbers(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return numbered(df, by, order, "n")
