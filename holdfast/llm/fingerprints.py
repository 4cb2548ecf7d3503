"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Every shingle of five words (fewer words: all of them; none: the empty shingle) is hashed once. The top bits
choose one of 256 bins, which keeps its smallest hash. An empty bin takes the value of the bin that its own
sequence of universal hashes reaches first among those that are not empty. Each bin's
value is mixed with the bin's number, so that bins filled from one source agree by chance independently, and
the lowest 4 bits are stored, 128 bytes in all. Two bins agree by chance once in 16 times, for which likeness is corrected.

Equal texts have equal fingerprints. Null texts count as empty; two empty texts have likeness 1. Repeated rows are
documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, BITS, WORDS = 256, 4, 5
CACHED, STEP = 300_000, 1 << 20


class Hashes(dict):
    """Word to its 64-bit hash, kept for a while."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 17)
        if len(word) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tries() -> np.ndarray:
    """64 choices of a bin for each bin."""
    return (mixed(np.arange(1, 64 * BINS + 1, dtype=np.uint64)).reshape(64, BINS) % np.uint64(BINS)).astype(np.int64)


def densified(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Empty bins filled from full ones. Bins that 64 choices leave empty go on with further choices."""
    if full.all():
        return values
    seen, block = full.nonzero()[0], 0
    if len(seen) == 1:
        return np.full(BINS, values[seen[0]])
    out, empty = values.copy(), (~full).nonzero()[0]
    while len(empty):
        choice = _tries()[:, empty] if not block else (mixed(np.arange(1, 64 * BINS + 1, dtype=np.uint64) + np.uint64(block * 64 * BINS)).reshape(64, BINS) % np.uint64(BINS)).astype(np.int64)[:, empty]
        hit = full[choice]
        found = hit.any(axis=0)
        out[empty[found]] = values[choice[hit.argmax(axis=0)[found], found.nonzero()[0]]]
        empty, block = empty[~found], block + 1
    return out


def minhash(raw: bytes, hashes: Hashes, words: int = WORDS) -> np.ndarray:
    """The 256 four-bit values of a text's UTF-8 bytes."""
    w = raw.split()
    values, full = np.full(BINS, np.iinfo(np.uint64).max, np.uint64), np.zeros(BINS, bool)
    for at in range(0, max(1, len(w) - words + 1), STEP):
        part = w[at : at + STEP + words - 1]
        h = np.fromiter(map(hashes.__getitem__, part or [b""]), np.uint64, max(1, len(part)))
        n = max(1, len(h) - words + 1)
        total = np.zeros(n, np.uint64)
        for j in range(min(words, len(h))):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        sorted_h = np.sort(mixed(total))
        edges = np.searchsorted(sorted_h >> np.uint64(56), np.arange(BINS, dtype=np.uint64))
        here = np.diff(np.append(edges, n)) > 0
        values[here] = np.minimum(values[here], sorted_h[edges[here]])
        full |= here
    whole = mixed(densified(values, full) ^ np.arange(BINS, dtype=np.uint64))
    return (whole & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(values: np.ndarray) -> str:
    return (values[::2] << 4 | values[1::2]).astype(np.uint8).tobytes().hex()


def unpacked(text: str) -> np.ndarray:
    both = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.stack([both >> 4, both & 15], axis=1).ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles, corrected for chance agreement, from 0 to 1."""
    chance = 1 / (1 << BITS)
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def fingerprint(text: Column) -> Column:
    """Hexadecimal string column of the packed values."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = Hashes()
        for texts in batches:
            yield pa.array([packed(minhash(t or b"", hashes)) for t in texts.cast(pa.binary()).to_pylist()], pa.string())

    return run(text.cast("string"))


def likeness_column(a: Column, b: Column) -> Column:
    """likeness of two fingerprint columns."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([likeness(unpacked(p), unpacked(q)) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return run(a, b)


ROWS, MOST_RANGES = 5_000, 100_000  # rows of a bucket, as long as there are fewer buckets than that
SPLIT = 64  # buckets of an id, or of null ids, that very many rows share


def in_descending_order(docs: DataFrame, doc_id: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """docs(doc_id, text) in buckets of an id range each, for a scan in descending order of doc_id, null ids last, ties by
    the text's hash and the text. Besides its own rows a bucket has, marked by hf_ahead, the first row of the bucket that
    follows (of the last: the first of all). Bucket bounds are quantiles of all ids; an id of more rows than two buckets
    should have is a bucket range of its own, split by the text's hash (only rows repeated in full stay together). Texts
    are shuffled once."""
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    rows = ids.count()
    n = buckets or max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(rows // ROWS, MOST_RANGES))
    counts = ids.groupBy("doc_id").agg(F.count("*").alias("n"))
    heavy = [r[0] for r in counts.where(F.col("n") > max(2 * rows // n, SPLIT)).select("doc_id").collect()]  # n / 2 ids at most
    bounds = set(ids.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))) if n > 1 else set()
    bounds |= {float(i + d) for i in heavy if i is not None for d in (0, 1)}
    cut = Bucketizer(splits=[-float("inf"), *sorted(bounds or {0.0}), float("inf")], inputCol="hf_id", outputCol="hf_range")

    def bucketed(df: DataFrame) -> DataFrame:
        df = cut.transform(df.withColumn("hf_id", F.coalesce(F.col(doc_id).cast("double"), F.lit(0.0)))).withColumn("hf_hash", F.xxhash64("text"))
        many = F.col(doc_id).isin([i for i in heavy if i is not None]) | F.lit(None in heavy) & F.col(doc_id).isNull()
        part = F.when(F.coalesce(many, F.lit(False)), F.floor((F.shiftright("hf_hash", 44) + (1 << 19)) * SPLIT / (1 << 20))).otherwise(0)
        place = F.when(F.col(doc_id).isNull(), F.lit(-1)).otherwise(F.col("hf_range").cast("int"))
        return df.withColumn("hf_bucket", ((place + 1) * SPLIT - part).cast("int")).drop("hf_id", "hf_range")

    first = F.max(F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("order"), (-F.col("hf_hash")).alias("minus"), F.col(doc_id).alias("id"), F.col("hf_hash").alias("hash")))
    tops = {r[0]: (r[1]["id"], r[1]["hash"]) for r in bucketed(docs.select(doc_id, "text")).groupBy("hf_bucket").agg(first).collect()}  # a row for each bucket
    order = sorted(tops, reverse=True)
    heads = [(*tops[b], order[i - 1]) for i, b in enumerate(order)]  # the first row of a bucket also goes to the one before
    heads = docs.sparkSession.createDataFrame(heads or [], f"hf_top {dict(docs.dtypes)[doc_id]}, hf_mark long, hf_to int")
    rows = bucketed(docs).join(F.broadcast(heads), F.col(doc_id).eqNullSafe(F.col("hf_top")) & (F.col("hf_hash") == F.col("hf_mark")), "left")
    places = F.array_compact(F.array(F.struct(F.col("hf_bucket").alias("hf_bucket"), F.lit(False).alias("hf_ahead")), F.when(F.col("hf_to").isNotNull(), F.struct(F.col("hf_to").alias("hf_bucket"), F.lit(True).alias("hf_ahead")))))
    rows = rows.select(*docs.columns, "hf_hash", F.explode(places).alias("hf")).select(*docs.columns, "hf_hash", "hf.*")
    return rows.repartition(max(1, n // 4), "hf_bucket").sortWithinPartitions("hf_bucket", "hf_ahead", F.col(doc_id).desc_nulls_last(), "hf_hash", F.col("text").asc_nulls_first())


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """For each document: its fingerprint, that of its text with the last third replaced by the start of the
    next document's (in descending order of doc_id, null ids last, ties by the text's hash, after the last the first), and both likenesses."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in EDITED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = Hashes(), []
        held = None  # (bucket, id, text, values), its next row not yet seen

        def emit(row, text: str, values: np.ndarray):
            _, i, own, print_ = row
            cut = len(own) // 3
            edited = (own[: len(own) - cut] + text[:cut]).encode() if cut else own.encode()
            other = minhash(edited, hashes)
            done.append((i, len(own), hashlib.sha256(edited).hexdigest(), packed(print_), packed(other), likeness(print_, other), likeness(print_, values)))

        for batch in batches:
            for bucket, ahead, i, text in zip(*(batch.column(c).to_pylist() for c in ("hf_bucket", "hf_ahead", "doc_id", "text")), strict=True):
                text = text or ""
                if ahead and (held is None or held[0] != bucket):
                    continue  # only the first of rows that share the top id is the next one
                values = minhash(text.encode(), hashes)
                if held is not None and held[0] == bucket:
                    emit(held, text, values)
                held = None if ahead else (bucket, i, text, values)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done = []

    return in_descending_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, EDITED)
