"""SentencePiece BPE with byte fallback: the unique last token of every prefix, then ids from the end backwards.

Pieces are merged by their scores (best first, of equals the leftmost), so every prefix of a text has one encoding and that
encoding one last token. It is found from left to right, without merging:

1. An automaton over all pieces gives, at each character, the pieces that end there.
2. A piece that ends there is the prefix's last token if it may follow the last token of the prefix before it. Two
   pieces may be neighbours if no merge would have gone across their border: for every piece r that was the end of the left one
   while it was made, and every l that was the start of the right one, r + l is no piece, or is merged later than r or l
   was used up. Answers are kept for each pair.
3. From the text's end backwards, the last token of each prefix gives the ids.

That takes time in proportion to the text, also for very long runs without white space. Pieces that merging their own
characters doesn't give (if any) are never last tokens. Characters without a piece become the byte pieces of their UTF-8
form. Spaces and the mark U+2581 are one; the text gets one in front. Where no piece has a space behind another character,
or a letter beside something else but leading spaces, texts are cut there and the parts' ids kept for a while, as no merge goes
across such a border.

Null texts count as empty: the end id alone, and an empty text when decoded. `ids` are array<int>; null ids are
decoded to null. Rows repeated in full, or with one id, each get their own; an empty table gives an empty result; a column
`ids` (or `decoded`) that docs already have is kept as `ids_input` (`decoded_input`).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import by_slices, set_aside

MARK = "▁"
#: How texts are cut, finest first, and what no piece may then look like.
LETTER = r"[^\W\d_\u00b2\u00b3\u00b9]"  # superscript digits aside
CUTS = (
    (rf" *(?:{LETTER}+|(?:(?!{LETTER})[^ ])+)| +", rf"[^ ] |{LETTER}(?!{LETTER})[^ ]|(?!{LETTER})[^ ]{LETTER}"),
    (" *[^ ]+| +", "[^ ] "),
    ("(?s:.+)", "(?!)"),
)
CACHED = 150_000  # parts of texts whose ids a worker keeps, twice: those met since the last change, and those before it
NEVER = float("inf")
# Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Neighbours(dict):
    """Whether a piece may follow another one, by left << 32 | right."""

    def __init__(self, rank: dict[str, float]):
        super().__init__()
        self.rank = rank
        self.tails: dict[int, list[tuple[str, float]]] = {}  # of each piece: all r that stood at its end, and when they were used up
        self.heads: dict[int, list[tuple[str, float]]] = {}  # the same of its start

    def __missing__(self, pair: int) -> bool:
        rank = self.rank
        clash = any((m := rank.get(r + x)) is not None and m < until_r and m <= until_x for r, until_r in self.tails[pair >> 32] for x, until_x in self.heads[pair & 0xFFFFFFFF])
        self[pair] = not clash
        return not clash


class Pieces(dict):
    """A model's tables; as a dict, parts of texts to their packed ids."""

    def __init__(self, model: bytes):
        super().__init__()
        self.older: dict[str, bytes] = {}
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        n, t = proto.normalizer_spec, proto.trainer_spec
        if t.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not t.byte_fallback or any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in proto.pieces):
            raise ValueError("only byte-fallback BPE models without normalisation or user-defined pieces")
        self.kinds = [p.type for p in proto.pieces]
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == t.eos_piece)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.number = {p.piece.replace(MARK, " "): i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.rank = {p.piece.replace(MARK, " "): -p.score for p in proto.pieces if p.type == NORMAL}
        self.neighbours = Neighbours(self.rank)
        plain = {NORMAL: lambda p: p.piece.replace(MARK, " ").encode(), UNKNOWN: lambda p: t.unk_surface.encode(), CONTROL: lambda p: b"\xff", BYTE: lambda p: bytes([int(p.piece[3:5], 16)])}
        self.raw = [plain[p.type](p) for p in proto.pieces]
        self.parts = next(re.compile(cut).findall for cut, across in CUTS if not any(map(re.compile(across).search, self.number)))
        self.single = {piece: (i, 1) for piece, i in self.number.items() if len(piece) == 1}
        self.automaton = ahocorasick.Automaton()  # of the longer pieces
        last: dict[str, tuple[str, str]] = {}
        for piece, i in self.number.items():
            merged = self.merged(piece, last)
            if len(merged) == 1 < len(piece):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        for piece, i in self.number.items():
            self.neighbours.tails[i], self.neighbours.heads[i] = self.spine(piece, last, 1), self.spine(piece, last, 0)

    def merged(self, piece: str, last: dict[str, tuple[str, str]]) -> list[str]:
        """The pieces that merging leaves of a string; last gets the two parts of every piece that is made."""
        parts, rank = list(piece), self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: rank.get(parts[k] + parts[k + 1], NEVER))
            both = parts[best] + parts[best + 1]
            if both not in rank:
                break
            last.setdefault(both, (parts[best], parts[best + 1]))
            parts[best : best + 2] = [both]
        return parts

    def spine(self, piece: str, last: dict[str, tuple[str, str]], side: int) -> list[tuple[str, float]]:
        """All pieces that stood at the end (side 1) or start (side 0) of a piece while it was made, with the rank of the
        merge that used them up."""
        found, until = [(piece, NEVER)], piece
        while until in last:
            part = last[until][side]
            found.append((part, self.rank[until]))
            until = part
        return found

    def table(self, part: str) -> list[tuple[int, int] | None]:
        """The last token of every prefix and its length (None: a character without a piece). The first is of the empty
        prefix. Where no longer piece fits, it is the last character alone."""
        last, neighbours = [None, *map(self.single.get, part)], self.neighbours
        for end, token in self.automaton.iter(part):
            if (known := last[end + 1]) is None or known[1] == 1:
                if (before := last[end + 1 - token[1]]) is None or neighbours[before[0] << 32 | token[0]]:
                    last[end + 1] = token
        return last

    def backwards(self, part: str) -> list[int]:
        last, at, ids = self.table(part), len(part), []
        while at:
            if (token := last[at]) is None:
                ids += [self.bytes[b] for b in reversed(part[at - 1].encode())]
                at -= 1
            else:
                ids.append(token[0])
                at -= token[1]
        ids.reverse()
        return ids

    def __missing__(self, part: str) -> bytes:
        packed = self.older.get(part) or array("i", self.backwards(part)).tobytes()
        if len(part) <= 64:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[part] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Packed ids (32 bits each) of a text, the end id last."""
        parts = self.parts(" " + text.replace(MARK, " ")) if text else []
        return b"".join(map(self.__getitem__, parts)) + np.int32(self.end).tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, the first one goes; a byte that is no UTF-8 becomes U+FFFD."""
        kinds = self.kinds
        ids = ids[:-1] if ids and kinds[ids[-1]] == CONTROL else ids
        first = next((i for i in ids if kinds[i] != CONTROL), None)
        try:
            text = b"".join(map(self.raw.__getitem__, ids)).decode()
        except UnicodeDecodeError:  # control pieces are no UTF-8 either: they part the bytes around them
            text = "".join(map(self.run_text, self.runs(ids)))
        return text[1:] if first is not None and kinds[first] == NORMAL and text[:1] == " " else text

    def runs(self, ids: list[int]) -> Iterator[list[int]]:
        """Longest runs of byte pieces, and other pieces one by one."""
        run: list[int] = []
        for i in ids:
            if self.kinds[i] == BYTE:
                run.append(i)
                continue
            if run:
                yield run
            run = []
            yield [i]
        if run:
            yield run

    def run_text(self, run: list[int]) -> str:
        if self.kinds[run[0]] == CONTROL:
            return ""
        raw, text, at = b"".join(map(self.raw.__getitem__, run)), [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    text.append(raw[at : at + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                text.append("�")
                size = 1
            at += size
        return "".join(text)


_loaded: dict[str, Pieces] = {}


def _pieces(name: str) -> Pieces:
    """The worker's own tables of a model file."""
    if name not in _loaded:
        with open(SparkFiles.get(name), "rb") as f:
            _loaded[name] = Pieces(f.read())
    return _loaded[name]


def shipped(docs: DataFrame, model_path: str) -> str:
    docs.sparkSession.sparkContext.addFile(model_path)
    return model_path.rpartition("/")[2]


def sp_encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column `ids`: array<int>, the end id last."""
    docs, name = set_aside(docs, ids), shipped(docs, model_path)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(name)

        def make(texts: pa.Array) -> pa.Array:
            packed = [pieces.encode(t or "") for t in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, packed)]) // 4
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4")))

        for batch in batches:
            yield by_slices(make, batch)

    return docs.withColumn(ids, run(F.col(text).cast("string")))


def sp_decode(docs: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with `decoded`: the text of the ids (null ids: null)."""
    docs, name = set_aside(docs, decoded), shipped(docs, model_path)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(name)

        def make(part: pa.Array) -> pa.Array:
            flat, texts, at = part.flatten().to_numpy(zero_copy_only=False).tolist(), [], 0
            for n in part.value_lengths().to_pylist():
                texts.append(None if n is None else pieces.decode(flat[at : at + n]))
                at += n or 0
            return pa.array(texts, pa.string())

        for batch in batches:
            yield by_slices(make, batch)

    return docs.withColumn(decoded, run(F.col(ids)))
