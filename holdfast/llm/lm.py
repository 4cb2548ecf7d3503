"""Cross-entropy difference: documents scored by a target and a background language model.

Both models are interpolated bigram models over one vocabulary: the byte-level BPE ids of a rank file, and an edge
before and after each text. They are matched: same order, same vocabulary, same smoothing (Witten-Bell, down to the
uniform distribution over the vocabulary). Target counts are gathered over the target rows, background counts over all
rows; nothing is pruned. A document's score is the target's cross-entropy minus the background's, in nats a token: the lower,
the more the text resembles the target. A row is never scored by its own counts: they are taken out of both models first (of the
target's only if it is a target row), so rows that the target was made from and others like them score alike.

1. Texts become packed ids and are marked as target or not by one shuffled join. Each task counts the bigrams of its
   rows in parts of PART tokens; a part keeps its rows' ids, and one row for each different bigram with both counts.
2. The parts' counts are summed by bigram: the model is a distributed table that grows with the corpus, and never
   reaches the driver. Only the sums by single token, which have a row for each id of the vocabulary at most (a size
   that the rank file fixes), are sent to all tasks.
3. A part's bigrams are joined with the model, and their counts come back to the part as one small table, with which its rows
   are scored. So a bigram moves once for each part, not once for each document or token.

Null and empty texts have one token, the closing edge. Without target rows the target model is uniform. Rows that share
an id are all target rows if it is one; rows with a null id never are. Repeated rows count as often as they occur and get
equal scores; an empty table gives an empty result. Only doc_id, text and the columns in `keep` are read; names hf_* are this
module's own, and a column `lm` in `keep` is kept as `lm_input`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import by_slices, materialise, set_aside, small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
PART = 6 << 20  # tokens of a part at most, but for a single longer text
STEP = 1 << 19  # tokens that are counted or scored at once
FIELDS = "n_tokens long, target double, background double, difference double"


def packed_ids(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> Column:
    """The ids of each text as compressed unsigned 32-bit integers."""
    source = bpe.shipped(docs, ranks_path, pattern)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield by_slices(lambda texts: pa.array([squeeze(planes(bpe.token_ids(source, t or "", bpe.longest_run(t or "")))) for t in texts.to_pylist()], pa.binary()), batch)

    return run(F.col(text).cast("string"))


def planes(ids: list[int]) -> bytes:
    """All lowest bytes, then all second bytes and so on: like bytes stand together and are compressed well."""
    return np.array(ids, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def bigrams(ids: np.ndarray, edge: int) -> np.ndarray:
    """The bigram of each token (the closing edge included): the id before it in the upper 32 bits, its own in the lower."""
    whole = np.concatenate([[edge], ids, [edge]])
    return whole[:-1] << 32 | whole[1:]


class Counts:
    """Bigram counts of target and all rows, summed a few million tokens at a time."""

    def __init__(self):
        self.sums = [np.zeros(0, np.int64) for _ in range(3)]
        self.waiting: list[tuple[np.ndarray, bool]] = []
        self.size = self.total = 0

    def add(self, grams: np.ndarray, is_target: bool) -> None:
        self.waiting.append((grams, is_target))
        self.size += len(grams)
        self.total += len(grams)
        if self.size >= STEP:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        """Sorted bigrams, target counts, background counts."""
        if self.waiting:
            grams = np.concatenate([self.sums[0], *(g for g, _ in self.waiting)])
            one = np.ones(self.size, np.int64)
            target = np.concatenate([self.sums[1], np.repeat([t for _, t in self.waiting], [len(g) for g, _ in self.waiting]).astype(np.int64)])
            every = np.concatenate([self.sums[2], one])
            kinds, place = np.unique(grams, return_inverse=True)
            self.sums = [kinds, *(np.bincount(place, weights=w, minlength=len(kinds)).astype(np.int64) for w in (target, every))]
            self.waiting, self.size = [], 0
        return self.sums


def count_parts(rows: DataFrame, keep: list[str], edge: int, part: int = PART) -> DataFrame:
    """rows: keep, hf_ids and hf_target. For each row (keep, hf_part, hf_ids, hf_target), and for each bigram of a part (hf_part,
    hf_gram, hf_t, hf_b); what a row hasn't is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsqueeze = zstandard.ZstdDecompressor().decompress
        number, counts = TaskContext.get().partitionId() << 32, Counts()
        types: list[pa.DataType] = []

        def table(n: int, own: list[pa.Array], number: int, ids: tuple[pa.Array, pa.Array] | None, sums: list[np.ndarray] | None) -> pa.RecordBatch:
            more = [pa.array(np.full(n, number)), *((pa.nulls(n, pa.binary()), pa.nulls(n, pa.bool_())) if ids is None else ids), *([pa.nulls(n, pa.int64())] * 3 if sums is None else map(pa.array, sums))]
            return pa.RecordBatch.from_arrays([*own, *more], names=[*keep, "hf_part", "hf_ids", "hf_target", "hf_gram", "hf_t", "hf_b"])

        def grams() -> Iterator[pa.RecordBatch]:
            sums = counts.settle()
            for at in range(0, len(sums[0]), 1 << 16):
                some = [x[at : at + (1 << 16)] for x in sums]
                yield table(len(some[0]), [pa.nulls(len(some[0]), t) for t in types], number, None, some)

        for batch in batches:
            types, start = [batch.column(c).type for c in keep], 0
            packed, targets = batch.column("hf_ids"), batch.column("hf_target").to_pylist()
            for i in range(len(batch)):
                counts.add(bigrams(unplaned(unsqueeze(packed[i].as_py())), edge), targets[i])
                full = counts.total >= part
                if full or i == len(batch) - 1:
                    size = i + 1 - start
                    yield table(size, [batch.column(c).slice(start, size) for c in keep], number, (packed.slice(start, size), batch.column("hf_target").slice(start, size)), None)
                    start = i + 1
                if full:
                    yield from grams()
                    number, counts = number + 1, Counts()
        if counts.total:
            yield from grams()

    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("hf_part", T.LongType()), T.StructField("hf_ids", T.BinaryType()), T.StructField("hf_target", T.BooleanType())] + [T.StructField(c, T.LongType()) for c in ("hf_gram", "hf_t", "hf_b")])
    for field in schema:
        field.nullable = True
    return rows.select(*keep, "hf_ids", "hf_target").mapInArrow(run, schema)


class Singles:
    """Of each id of the vocabulary (the edge last), for the target and for all rows: how often it occurs, how often
    something follows it, and how many different ids do."""

    def __init__(self, sums: DataFrame, vocabulary: int):
        self.size = vocabulary
        pair = {"first": F.shiftright("hf_gram", 32), "second": F.col("hf_gram").bitwiseAND(F.lit((1 << 32) - 1))}
        sums = sums.withColumns(pair)
        kinds = lambda c: F.count_if(F.col(c) > 0)
        shape = (2, vocabulary)
        self.times, self.followed, self.followers = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for r in sums.groupBy("second").agg(F.sum("hf_t"), F.sum("hf_b")).collect():  # as many rows as the vocabulary at most
            self.times[:, r[0]] = r[1:]
        for r in sums.groupBy("first").agg(F.sum("hf_t"), F.sum("hf_b"), kinds("hf_t"), kinds("hf_b")).collect():
            self.followed[:, r[0]], self.followers[:, r[0]] = r[1:3], r[3:]


def own_sums(keys: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
    """For each element, the sum of the weights over the elements with its key."""
    _, place = np.unique(keys, return_inverse=True)
    return [np.bincount(place, weights=w)[place] for w in weights]


def losses(row: np.ndarray, gram: np.ndarray, times: np.ndarray, all_times: np.ndarray, inside: np.ndarray, singles: Singles, model: int, n_rows: int) -> np.ndarray:
    """The sum of -log p over each row's tokens, in a model without the row's own counts. row, gram, times: each row's different
    bigrams; all_times: the model's counts of them; inside: whether the row was counted in the model."""
    first, second = gram >> 32, gram & ((1 << 32) - 1)
    own = times * inside
    left = all_times - own
    gone = (own > 0) & (left == 0)
    follow, fewer = own_sums(row * singles.size + first, own, gone)
    single, = own_sums(row * singles.size + second, own)
    alone = singles.times[model, second] - single
    # ids that no other row has: each counts once for its row
    _, at = np.unique(row * singles.size + second, return_index=True)
    lost = np.bincount(row[at], weights=(single[at] > 0) & (alone[at] == 0), minlength=n_rows)
    total = singles.times[model].sum() - np.bincount(row, weights=own, minlength=n_rows)
    kinds = np.maximum(1, (singles.times[model] > 0).sum() - lost)
    p1 = (alone + kinds[row] / singles.size) / (total + kinds)[row]
    k = np.maximum(1, singles.followers[model, first] - fewer)
    p = (left + k * p1) / (singles.followed[model, first] - follow + k)
    return np.bincount(row, weights=-np.log(p) * times, minlength=n_rows)


def score_parts(rows: DataFrame, answers: DataFrame, keep: list[str], edge: int, singles: Singles) -> DataFrame:
    """keep and `lm` of every row. rows: keep, hf_part, hf_ids, hf_target; answers: hf_of (the part), hf_gram, hf_t, hf_b."""
    sent = rows.sparkSession.sparkContext.broadcast(singles)

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        unsqueeze = zstandard.ZstdDecompressor().decompress
        order = np.argsort(gram := known.column("hf_gram").to_numpy())
        gram, counts = gram[order], [known.column(c).to_numpy()[order] for c in ("hf_t", "hf_b")]
        out: list[list[np.ndarray]] = [[], [], []]
        waiting: list[np.ndarray] = []
        marks: list[bool] = []

        def settle() -> None:
            sizes = np.array([len(w) for w in waiting])
            place = np.searchsorted(gram, np.concatenate(waiting))
            keys, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(gram) + place, return_counts=True)
            row, at = keys // len(gram), keys % len(gram)
            out[0].append(sizes)
            for i, inside in enumerate((np.array(marks)[row], np.ones(len(row), bool))):
                out[i + 1].append(losses(row, gram[at], times, counts[i][at], inside, sent.value, i, len(sizes)) / sizes)
            waiting.clear()
            marks.clear()

        size = 0
        for packed, mark in zip(own.column("hf_ids"), own.column("hf_target"), strict=True):
            waiting.append(bigrams(unplaned(unsqueeze(packed.as_py())), edge))
            marks.append(mark.as_py())
            size += len(waiting[-1])
            if size >= STEP:
                settle()
                size = 0
        if waiting:
            settle()
        n, t, b = (np.concatenate(x) for x in out)
        lm = pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(t), pa.array(b), pa.array(t - b)], names=[f.split()[0] for f in FIELDS.split(", ")])
        return pa.table([*(own.column(c) for c in keep), lm], names=[*keep, "lm"])

    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("lm", T._parse_datatype_string(FIELDS))])
    tasks = max(1, rows.select("hf_part").distinct().count() // 4)  # follows the data: a few parts each
    return rows.repartition(tasks, "hf_part").groupBy("hf_part").cogroup(answers.repartition(tasks, "hf_of").groupBy("hf_of")).applyInArrow(run, schema)


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", text: str = "text",
    ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, part: int = PART,
) -> DataFrame:
    """keep and `lm` (n_tokens, target and background cross-entropy in nats a token, their difference) of every row.
    target_ids: doc_id of the rows that the target model is made from."""
    ranks_path = ranks_path or public_tokenizers.path(RANKS)
    with open(ranks_path, "rb") as f:
        edge = max(bpe.read_ranks(f.read()).values()) + 1
    rows = docs.select(*keep, F.col(doc_id).alias("hf_id"), packed_ids(docs, ranks_path, pattern, text).alias("hf_ids"))
    rows = set_aside(rows, "lm")
    keep = rows.columns[:-2]
    ids = target_ids.select(F.col(doc_id).alias("hf_good")).where("hf_good is not null").distinct()
    named = rows.where("hf_id is not null").join(ids.hint("shuffle_hash"), F.col("hf_id") == F.col("hf_good"), "left")  # the ids grow with the corpus: one plan at every size
    marked = named.withColumn("hf_target", F.col("hf_good").isNotNull()).drop("hf_good").unionByName(rows.where("hf_id is null").withColumn("hf_target", F.lit(False)))
    with small_batches(docs.sparkSession):
        parts = materialise(count_parts(marked, keep, edge, part))
    grams = parts.where("hf_gram is not null").select("hf_part", "hf_gram", "hf_t", "hf_b")
    model = materialise(grams.groupBy("hf_gram").agg(F.sum("hf_t").alias("hf_t"), F.sum("hf_b").alias("hf_b")))
    answers = grams.select(F.col("hf_part").alias("hf_of"), "hf_gram").join(model, "hf_gram")
    return score_parts(parts.where("hf_ids is not null").select(*keep, "hf_part", "hf_ids", "hf_target"), answers, keep, edge, Singles(model, edge + 1))
