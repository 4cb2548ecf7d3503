"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2 bits apart have a variant at most 1 bit from both. So every distinct
fingerprint emits itself and its 64 one-bit variants; fingerprints that emit one variant are at most 2 bits
apart. A variant is emitted by at most 65 fingerprints, so no group can grow; each is linked to the smallest
one of its variant, which gives the same components as all pairs, and every link is verified.

Copies share a fingerprint and are one node, however many there are. Null and empty texts have fingerprint
zero and are linked like any other. A null doc_id keeps its row; it is never a component's id unless the
component has no other. Repeated rows are copies; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .graph import connected_components

SEED, WORDS, STEP = 42, 3, 65_536
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash64(raw: bytes, words: int = WORDS) -> int:
    """The unsigned fingerprint of UTF-8 bytes: a bit is 1 if it is set in over half of the shingles' hashes."""
    w = raw.translate(LOWER).split()  # bytes split at the six ASCII white-space bytes
    n = max(1, len(w) - words + 1)
    if not w:
        return 0
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = w[at : at + STEP + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(w) >= words else (b" ".join(w),)
        hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """simhash64 as a signed long column."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            prints = np.fromiter((simhash64(t or b"", words) for t in texts.cast(pa.binary()).to_pylist()), np.uint64, len(texts))
            yield pa.array(prints.view(np.int64))

    return run(text.cast("string"))


def hex64(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def ball_links(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b) links between distinct fingerprints at most 2 bits apart: enough to connect all that are."""
    x = F.col(fp)
    flips = [x.bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)]
    variants = prints.select(x, F.explode(F.array(x, *flips)).alias("variant"))
    first = F.min(fp).over(Window.partitionBy("variant"))
    pairs = variants.select(x.alias("b"), first.alias("a")).where(F.col("a") != F.col("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs: fp is the signed fingerprint, component_id the
    smallest doc_id that links reach."""
    return components(docs, doc_id, text, words).drop("root")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id, root), one row for each row of docs: fp is the signed fingerprint, component_id the
    smallest doc_id that links reach, root the component's smallest fingerprint (where ids repeat, components can share an id)."""
    rows = materialise(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), words).alias("fp")))
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(ball_links(prints)).select(F.col("node").alias("fp"), "root")
    linked = prints.join(linked, "fp")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(of_root, "root").select("fp", "component_id", "root")
    groups = prints.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    groups = materialise(groups)  # both sides of the join are then plain exchanges, of which Spark splits the one with many copies
    return rows.join(groups, "fp", "left").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that with the smallest doc_id (null ids last); of rows that share that id, the one
    with the smallest fingerprint, then text. Rows repeated in full are one. Columns hf_* are this function's own."""
    found = materialise(components(docs, doc_id, text))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "fp"))
    keep = found.groupBy("root").agg(F.min(named).alias("named"), F.min("fp").alias("fp"))
    keep = materialise(keep.select(F.col("named.doc_id").alias("hf_keep"), F.coalesce("named.fp", "fp").alias("hf_fp")))
    again = materialise(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("hf_again")).count().where(F.col("count") > 1).select("hf_again"))
    rows = docs.join(keep.where(F.col("hf_keep").isNotNull()).select("hf_keep").distinct(), F.col(doc_id) == F.col("hf_keep"), "left_semi")
    unsure = []  # rows whose id doesn't tell whether they are kept
    if not again.isEmpty():
        unsure.append(rows.join(again, F.col(doc_id) == F.col("hf_again"), "left_semi"))
        rows = rows.join(again, F.col(doc_id) == F.col("hf_again"), "left_anti")
    if not keep.where(F.col("hf_keep").isNull()).isEmpty():
        unsure.append(docs.where(F.col(doc_id).isNull()))
    for part in unsure:
        part = part.withColumn("hf_own", fingerprint(F.col(text))).join(keep, (F.col("hf_own") == F.col("hf_fp")) & F.col(doc_id).eqNullSafe(F.col("hf_keep")), "left_semi")
        order = F.struct(text, F.to_json(F.struct(*docs.columns)))
        part = part.groupBy("hf_own", doc_id).agg(F.min_by(F.struct(*docs.columns), order).alias("hf_row"))  # combined in each task before it is shuffled
        rows = rows.unionByName(part.select("hf_row.*"))
    return rows
