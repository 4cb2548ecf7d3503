"""Byte-level BPE: overlapping chunks, stitched where pre-token boundaries meet again, then merged.

A match of the pattern at a position depends on what follows that position only. So once two scans of a
text, begun at different places, share one boundary, they share all later ones. Long texts are cut into
chunks that overlap; every chunk is pre-tokenised on its own; the first boundary that the end of one chunk
and the start of the next one share is where they are stitched. Boundaries close to a chunk's end are not
used, as the scan didn't see enough there. A text whose chunks share no boundary somewhere (a run of one
kind of character longer than the overlap) is encoded as one chunk instead: the result is always that of
one scan over the whole text.

Ids are packed as little-endian unsigned 32-bit integers in a binary column (`ids`); `ids_array` unpacks
them. Null texts count as empty: no ids, and empty bytes when decoded. Rows repeated in full, or with one doc_id, each get
their own ids; an empty table gives an empty result. A column `ids` (or `decoded`) that docs already have is
kept as `ids_input` (`decoded_input`); columns named hf_* are this module's own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_slices, set_aside

CHUNK, OVERLAP, MARGIN = 65_536, 2_048, 16
CACHED = 300_000  # pre-tokens whose ids a worker keeps
LONG_RUN = 1_000  # characters


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


class Merger(dict):
    """Pre-token (str) to its packed ids; computed once, kept for a while."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.merged(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = packed
        return packed

    def merged(self, raw: bytes) -> list[int]:
        """The pair of neighbours with the lowest rank is joined, leftmost first, until no pair has one."""
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        if len(raw) > 256:
            return self.merged_long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (low := min(pairs)) < 1 << 40:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 40)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 40)
        return [ranks[p] for p in parts]

    def merged_long(self, raw: bytes) -> list[int]:
        """The same over a heap and a linked list, for pre-tokens of any length."""
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(raw)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the part at i is raw[i:ends[i]]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            if ends[i] < 0 or (j := ends[i]) >= n or ends[j] != end:
                continue
            ends[i], ends[j] = end, -1
            if end < n:
                before[end] = i
                if (r := ranks.get(raw[i : ends[end]])) is not None:
                    heappush(heap, (r, i, ends[end]))
            if (k := before[i]) >= 0 and (r := ranks.get(raw[k:end])) is not None:
                heappush(heap, (r, k, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : ends[i]]])
            i = ends[i]
        return out


_mergers: dict[tuple, tuple] = {}


def _merger(source: tuple[str, str]) -> tuple:
    """The worker's own (merger, matcher, token bytes) of a rank file and pattern."""
    if source not in _mergers:
        ranks = _ranks(source)
        table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _mergers[source] = (Merger(ranks), regex.compile(source[1]), table)
    return _mergers[source]


def _ranks(source: tuple[str, str]) -> dict[bytes, int]:
    with open(SparkFiles.get(source[0]), "rb") as f:
        return read_ranks(f.read())


_libraries: dict[tuple, tiktoken.Encoding] = {}


def longest_run(text: str) -> int:
    """A bound of the longest run of white space, or of none, in a text."""
    words = text.split()
    return max(max(map(len, words), default=0), len(text) - sum(map(len, words)) - len(words))


def token_ids(source: tuple[str, str], text: str, longest: int) -> list[int]:
    """The ids that bpe_encode gives a text, for operators that need tokens as a unit: by the library, which is faster;
    texts with very long runs, for which it takes quadratic time, by the merger here."""
    if longest >= LONG_RUN:
        merger, matcher, _ = _merger(source)
        return np.frombuffer(b"".join(map(merger.__getitem__, matcher.findall(text))), "<u4").tolist()
    if source not in _libraries:
        _libraries[source] = tiktoken.Encoding("ranks", pat_str=source[1], mergeable_ranks=_ranks(source), special_tokens={})
    return _libraries[source].encode_ordinary(text)


def shipped(docs: DataFrame, ranks_path: str, pattern: str) -> tuple[str, str]:
    """Send the rank file to all executors once."""
    docs.sparkSession.sparkContext.addFile(ranks_path)
    return ranks_path.rpartition("/")[2], pattern


def _encode(source: tuple[str, str]):
    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        merger, matcher, _ = _merger(source)

        def make(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
            rows = zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True)
            return pa.array([b"".join(map(merger.__getitem__, matcher.findall((t or "")[a:b]))) for t, a, b in rows], pa.binary())

        for batch in batches:
            yield by_slices(make, *batch)

    return run


def _edges(source: tuple[str, str], overlap: int):
    """Of a chunk at `start`: boundaries near its first and its last characters, from the text's start."""

    @F.arrow_udf("struct<head:array<long>,tail:array<long>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        _, matcher, _ = _merger(source)
        for texts, starts in batches:
            heads, tails = [], []
            for text, start in zip(texts.to_pylist(), starts.to_pylist(), strict=True):
                ends = np.fromiter((m.end() for m in matcher.finditer(text)), np.int64)
                heads.append(ends[ends <= overlap] + start)
                tails.append(ends[(ends >= len(text) - overlap) & (ends <= len(text) - MARGIN)] + start)
            yield pa.StructArray.from_arrays([pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)], names=["head", "tail"])

    return run


def _chunks(chunk: int, overlap: int):
    @F.arrow_udf("array<struct<no:int,start:long,body:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("no", pa.int32()), ("start", pa.int64()), ("body", pa.string())]))
        for texts in batches:
            yield pa.array(([{"no": i, "start": a, "body": t[a : a + chunk + overlap]} for i, a in enumerate(range(0, max(1, len(t) - overlap), chunk))] for t in texts.to_pylist()), kind)

    return run


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, ids: str = "ids") -> DataFrame:
    """docs with the column `ids` (packed). Texts up to chunk + overlap characters are one chunk and never move;
    only longer ones are cut and spread. The columns hf_* are this function's own."""
    docs = set_aside(docs, ids)
    source = shipped(docs, ranks_path, pattern)
    encode = _encode(source)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    long = F.char_length(body) > chunk + overlap
    whole = lambda df: df.withColumn(ids, encode(body, F.lit(0), F.char_length(body)))
    short = whole(docs.where(~long))
    rest = [c for c in docs.columns if c != text]
    longs = docs.where(long).withColumn("hf_key", F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in docs.columns]))
    longs = longs.withColumn("hf_key", F.struct("hf_key", F.monotonically_increasing_id().alias("row")))
    parts = longs.select("hf_key", *rest, F.explode(_chunks(chunk, overlap)(body)).alias("hf")).select("hf_key", *rest, "hf.*")
    parts = parts.repartition("hf_key", "no").withColumn("hf_edge", _edges(source, overlap)("body", "start"))
    order = Window.partitionBy("hf_key").orderBy("no")
    cut = F.array_min(F.array_intersect("hf_edge.tail", F.lead("hf_edge.head").over(order)))
    last = F.lead("no").over(order).isNull()
    parts = parts.select("*", cut.alias("hf_cut"), last.alias("hf_last"))
    parts = parts.select("*", F.coalesce(F.lag("hf_cut").over(order), F.lit(0)).alias("hf_from"), F.max(F.col("hf_cut").isNull() & ~F.col("hf_last")).over(Window.partitionBy("hf_key")).alias("hf_lost"))
    upto = F.when(F.col("hf_last"), F.col("start") + F.char_length("body")).otherwise(F.col("hf_cut"))
    stitched = (
        parts.where(~F.col("hf_lost"))
        .withColumn("hf_ids", encode(F.col("body"), F.col("hf_from") - F.col("start"), upto - F.col("start")))
        .groupBy("hf_key")
        .agg(F.array_sort(F.collect_list(F.struct("no", "hf_ids", "hf_from", "start", "body"))).alias("hf"), *[F.first(c).alias(c) for c in rest])
    )
    join = lambda part: F.aggregate("hf", part[0], part[1])
    stitched = stitched.select(
        *rest,
        join((F.lit("").cast("binary"), lambda a, x: F.concat(a, x["hf_ids"]))).alias(ids),
        F.concat_ws("", F.transform("hf", lambda x: F.when(x["no"] == F.size("hf") - 1, x["body"]).otherwise(F.substring(x["body"], 1, chunk)))).alias(text),
    )
    lost = parts.where(F.col("hf_lost")).groupBy("hf_key").agg(F.array_sort(F.collect_list(F.struct("no", "body"))).alias("hf"), *[F.first(c).alias(c) for c in rest])
    lost = lost.select(*rest, F.concat_ws("", F.transform("hf", lambda x: F.when(x["no"] == F.size("hf") - 1, x["body"]).otherwise(F.substring(x["body"], 1, chunk)))).alias(text))
    cols = [*docs.columns, ids]
    return short.select(cols).unionByName(stitched.select(cols)).unionByName(whole(lost).select(cols))


def bpe_decode(docs: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with `decoded`: the raw bytes of the packed ids, one after another (null ids: null)."""
    docs = set_aside(docs, decoded)
    source = shipped(docs, ranks_path, ".")

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = _merger(source)[2].__getitem__
        for batch in batches:
            yield by_slices(lambda packed: pa.array([None if p is None else b"".join(map(token, np.frombuffer(p, "<u4").tolist())) for p in packed.to_pylist()], pa.binary()), batch)

    return docs.withColumn(decoded, run(F.col(ids)))


def ids_array(ids: Column) -> Column:
    """Packed ids as array<long>."""

    @F.arrow_udf("array<long>")
    def run(packed: pa.Array) -> pa.Array:
        return pa.array((None if p is None else np.frombuffer(p, "<u4").astype(np.int64) for p in packed.to_pylist()), pa.list_(pa.int64()))

    return run(ids)
