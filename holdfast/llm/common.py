"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, shared_dir

__all__ = ["bounded_sample", "by_slices", "held_out", "materialise", "one_order", "row_key", "set_aside", "shared_dir", "small_batches", "table"]
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is 0 mod 5. A null id is held out: nothing is learnt from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def bounded_sample(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """About `most` rows at most, chosen by a 64-bit hash of the key; all rows where there are no more than that."""
    n = rows.count()
    if n <= most:
        return rows
    place = F.xxhash64(F.lit("sample"), *key).bitwiseAND(F.lit((1 << 63) - 1))
    return rows.where(place < F.lit((most << 63) // n))


def one_order(sample: DataFrame) -> DataFrame:
    """A bounded sample in one partition, sorted by all its columns: what is fitted on it doesn't depend on how the
    rows were dealt or in which order tasks ended. Only for tables whose size is bounded by a parameter."""
    return materialise(sample.coalesce(1).sortWithinPartitions(*sample.columns))


def set_aside(docs: DataFrame, *names: str) -> DataFrame:
    """docs, where columns of the names that a result is to have are kept as <name>_input (further _input until that
    is free; names ignore case, as Spark's do)."""
    taken, wanted = {c.lower() for c in docs.columns}, {n.lower() for n in names}
    for c in docs.columns:
        if c.lower() in wanted:
            new = f"{c}_input"
            while new.lower() in taken | wanted:
                new += "_input"
            taken.add(new.lower())
            docs = docs.withColumnRenamed(c, new)
    return docs


def row_key(doc_id: Column, text: Column) -> Column:
    """A second key beside doc_id, so that rows which share an id but not a text stay apart."""
    return F.xxhash64(doc_id, text)


def by_slices(make: Callable[..., pa.Array], *columns: pa.Array, size: int = 500) -> pa.Array:
    """make over slices of a batch, put together again: few of a batch's values are Python objects at a time."""
    return pa.concat_arrays([make(*[c.slice(i, size) for c in columns]) for i in range(0, max(1, len(columns[0])), size)])


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Arrow batches of `rows` rows for what is computed inside, where whole texts stand in them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
