"""Vector code compression: product codes whose nearest entries are found with LAESA pivots.

Components become integers, floor(scale * x). Vectors are cut into equal consecutive parts; each part position has a
codebook, whose entries begin as that part of the vectors with the smallest ids. A round assigns every part to its
nearest entry (squared Euclidean distance, ties to the lower index) and replaces entries by the floors of their parts' means.

1. Of the first entries of each position, a few that lie far apart are its pivots. They stay the same in all rounds, so
   the squared distances of all parts to their pivots are computed once and stored beside the vectors.
2. In a round only distances of pivots to entries are new. For a part a and an entry e, the triangle inequality gives
   |d(a, pivot) - d(pivot, e)| <= d(a, e); the largest of these differences is the pair's lower bound (lowered a little more
   than rounding can raise it).
3. A part's entries are tried in the order of their bounds, in exact integers, until the next bound is over the best
   distance so far. Results equal those of all distances.

Each task sums its own parts by entry; what is shuffled is a row for each task, entry and component, and codebooks (parts x
entries x components, fixed by parameters) are all that the driver holds.

Rows whose vector is null or has a null or non-finite component are dropped. Vectors must have one length, a multiple of
the number of parts, and no component of 2^28 / scale or more, where squares could leave 64 bits: anything else is an error. Fewer rows
than entries give fewer entries. Of rows with one id, the first by vector comes first; null ids come last. Repeated rows
count as often as they occur and get equal codes. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

PARTS, ENTRIES, ROUNDS, PIVOTS, SCALE = 16, 64, 2, 4, 256
LARGEST = 1 << 28
RELATIVE, ABSOLUTE = 1e-9, 1e-6  # by which bounds are lowered; distances are under 2^32, their rounding errors under 1e-6


@dataclass(frozen=True)
class Codebooks:
    entries: np.ndarray  # (parts, entries, components), int64
    pivots: np.ndarray  # (parts, pivots, components), int64

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    gap = a[:, None, :] - b[None, :, :]
    return (gap * gap).sum(axis=2)


def far_apart(entries: np.ndarray, n: int) -> np.ndarray:
    """n rows at most: the first one, then always the one that is farthest from those before it."""
    chosen = [0]
    gap = squared(entries, entries[:1])[:, 0]
    while len(chosen) < n and gap.max(initial=0) > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen + chosen[:1] * (n - len(chosen))]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each part's nearest entry, and how many distances were evaluated. to_pivots:
    squared distances of the parts to the pivots."""
    n, k = len(parts), len(entries)
    own, between = np.sqrt(to_pivots.astype(np.float64)), np.sqrt(squared(pivots, entries).astype(np.float64))
    bound = np.zeros((n, k))
    for m in range(len(pivots)):
        np.maximum(bound, np.abs(own[:, m, None] - between[m]), out=bound)
    bound = np.maximum(bound * (1 - RELATIVE) - ABSOLUTE, 0) ** 2
    order = np.argsort(bound, axis=1, kind="stable")
    best, who, live, evaluated = np.full(n, np.iinfo(np.int64).max), np.full(n, k), np.arange(n), 0
    for t in range(k):
        tried = order[live, t]
        gap = parts[live] - entries[tried]
        distance = (gap * gap).sum(axis=1)
        evaluated += len(live)
        better = (distance < best[live]) | ((distance == best[live]) & (tried < who[live]))
        best[live[better]], who[live[better]] = distance[better], tried[better]
        if t + 1 < k:
            live = live[bound[live, order[live, t + 1]] <= best[live]]
        if not len(live):
            break
    return who, best, evaluated


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of a vector's components, as array<long>."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def cube(column: pa.Array, parts: int) -> np.ndarray:
    """A list column as (rows, parts, components)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, len(flat) // max(1, len(column) * parts))


def prepare(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, pivots: int = PIVOTS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, v, to_pivots) of the rows that are kept, and the first codebooks (None without any row)."""
    kept = vectors.where(finite(F.col(vec))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole(F.col(vec), scale).alias("v"))
    n, short, long, largest = kept.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return kept.withColumn("to_pivots", F.array().cast("array<long>")), None
    if short != long or long % parts or (largest or 0) >= LARGEST:
        raise ValueError(f"vectors of {short} to {long} components up to {largest} in size (times {scale}): one length that is a multiple of {parts}, and sizes under {LARGEST} are needed")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # as many rows as entries
    start = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, long // parts).transpose(1, 0, 2)
    books = Codebooks(start, np.stack([far_apart(e, pivots) for e in start]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = cube(batch.column("v"), parts)
            far = np.concatenate([squared(x[:, p], books.pivots[p]) for p in range(parts)], axis=1)
            ends = np.arange(len(batch) + 1, dtype=np.int32) * (parts * pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(far.ravel()))], names=[*batch.schema.names, "to_pivots"])

    schema = T.StructType([*kept.schema.fields, T.StructField("to_pivots", T.ArrayType(T.LongType()))])
    return materialise(kept.mapInArrow(measure, schema)), books


def assigned(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: its parts, the index of each part's nearest entry, the squared distance."""
    n = len(books.entries)
    x, far = cube(batch.column("v"), n), cube(batch.column("to_pivots"), n)
    found = [nearest(x[:, p], far[:, p], books.entries[p], books.pivots[p]) for p in range(n)]
    return x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def improved(prepared: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one more round."""
    shape = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            x, who, _ = assigned(batch, books)
            for p in range(shape[0]):
                count[p] += np.bincount(who[:, p], minlength=shape[1])
                np.add.at(total[p], who[:, p], x[:, p])
        p, e = np.nonzero(count)
        for c in range(shape[2]):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(np.full(len(p), c)), pa.array(count[p, e]), pa.array(total[p, e, c])], names=["p", "e", "c", "n", "s"])

    found = prepared.select("v", "to_pivots").mapInArrow(sums, "p long, e long, c long, n long, s long").groupBy("p", "e", "c").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    entries = books.entries.copy()
    for r in found.collect():  # as many rows as the codebooks have components
        entries[r["p"], r["e"], r["c"]] = int(r["s"]) // r["n"]
    return Codebooks(entries, books.pivots)


def coded(prepared: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part's entry, and the sum of the squared distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, who, distance = assigned(batch, books)
            code = [row.tobytes().hex() for row in who.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(distance.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    schema = T.StructType([prepared.schema["vec_id"], prepared.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return prepared.mapInArrow(run, schema)


def compress(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of every row that is kept, and the codebooks (at most 256 entries each)."""
    prepared, books = prepare(vectors, vec_id, vec, label, parts, entries, pivots, scale)
    if books is None:
        return prepared.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    for _ in range(rounds):
        books = improved(prepared, books)
    return coded(prepared, books), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error: the errors' sum over equal labels, nulls together. Labels may be as many as rows, and one
    of them may hold most rows: sums are made in each task first, and both sides of the join can be split."""
    codes = materialise(codes)
    sums = materialise(codes.groupBy(F.col("label").alias("hf_label")).agg(F.sum("error").alias("label_error")))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("hf_label"))).drop("hf_label")


def restored(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """codes with `restored`: the vector of the entries' components, over the scale (the middle of their unit)."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if c is None else ((books.entries[np.arange(len(books.entries)), list(bytes.fromhex(c))].ravel() + 0.5) / scale).tolist() for c in batch.to_pylist()], pa.list_(pa.float64()))

    return codes.withColumn("restored", run(F.col("code")))
