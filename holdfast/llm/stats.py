"""Statistics of whole texts, as double columns: one pass over each text's bytes and words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = (
    "log_chars", "log_words", "mean_word", "long_words", "unique_words", "top_word", "repeated_neighbours", "log_lines", "unique_lines",
    "mean_line", "upper", "digits", "space", "letters", "stops", "marks", "brackets", "symbols", "bars", "quotes", "high_bytes",
)


def _mask(members: bytes) -> np.ndarray:
    m = np.zeros(256)
    m[list(members)] = 1
    return m


CLASSES = np.stack([
    _mask(bytes(range(65, 91))), _mask(b"0123456789"), _mask(b" \t\n\r\x0b\x0c"), _mask(bytes([*range(65, 91), *range(97, 123)])), _mask(b".,;:"),
    _mask(b"!?"), _mask(b"()[]{}<>"), _mask(b"#$%&*@^~\\/=+_"), _mask(b"|"), _mask(b"\"'`-"), _mask(bytes(range(128, 256))),
]).T


def measure(raw: bytes) -> list[float]:
    """The statistics in the order of NAMES; of an empty text all are 0."""
    words = raw.split()
    return measured(raw, words, Counter(words), np.fromiter(map(len, words), np.int64, len(words)))


def measured(raw: bytes, words: list[bytes], counts: Counter, lengths: np.ndarray) -> list[float]:
    if not raw:
        return [0.0] * len(NAMES)
    n = len(raw)
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES / n).tolist()
    k = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(n), np.log1p(len(words)), float(lengths.sum()) / k, float((lengths > 15).sum()) / k, len(counts) / k, max(counts.values(), default=0) / k,
        sum(map(bytes.__eq__, words, words[1:])) / k, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), *shares,
    ]


def text_stats(text: Column, lexicons: dict[str, list[str]] | None = None, count: Callable[[str, int], int] | None = None) -> Column:
    """Struct column of the statistics. lexicons: name to lower-case words; for each, hits_<name> is the
    logarithm of 1 plus the number of the text's distinct words that it has, without punctuation at their ends. count: what
    the field `tokens` is to have, from the text and a bound of the longest run in it, of white space or of none."""
    lexicons = {k: frozenset(w.encode() for w in v) for k, v in (lexicons or {}).items()}
    names = [*NAMES, *(f"hits_{k}" for k in lexicons), *(["tokens"] if count else [])]

    @F.arrow_udf(f"struct<{','.join(f'{n}:double' for n in names)}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for raw in (x for at in range(0, len(texts), 500) for x in texts.slice(at, 500).cast(pa.binary()).to_pylist()):
                raw = raw or b""
                words = raw.split()
                counts, lengths = Counter(words), np.fromiter(map(len, words), np.int64, len(words))
                row = measured(raw, words, counts, lengths)
                if lexicons:
                    seen = distinct_words(counts)
                    row += [float(np.log1p(len(seen & v))) for v in lexicons.values()]
                if count:
                    row.append(float(count(raw.decode(), max(int(lengths.max(initial=0)), len(raw) - int(lengths.sum()) - len(words)))))
                rows.append(row)
            table = np.array(rows, float).reshape(len(rows), len(names))
            yield pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(names))], names=names)

    return run(text.cast("string"))


PUNCTUATION = b".,;:!?\"'()[]{}<>|*#$%&-"


def distinct_words(words: Iterable[bytes]) -> set[bytes]:
    """In lower case, without punctuation at their ends."""
    return {w.lower().strip(PUNCTUATION) for w in words}
