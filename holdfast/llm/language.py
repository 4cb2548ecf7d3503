"""Language identification of texts whose parts may have different languages.

A word is a run of letters with the marks (vowel signs, accents) that follow them. It has a script, by the range of its first
letter; only languages that were seen in that script are its candidates. Each candidate scores the word by its character trigrams. Viterbi's algorithm then finds the
best sequence of languages with a penalty for each switch, and runs of one language are spans.

A text's language is the one with most letters in its spans, its score their share; of languages with equally many,
the first by name. Null texts and texts without any letter are `und` with score 0. Languages are learnt from a bounded
sample of the labelled rows (null languages, null texts and null ids are left out); nothing that the sample has is left
out. Without any labelled row, or in an empty table, every text is `und`. Repeated rows get equal results. A column
`language` that docs already have is kept as `language_input`.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, set_aside

MOST_ROWS = 20_000  # labelled rows learnt from
SWITCH, OUT = 12.0, -1e4  # penalty of a switch; score of a language that isn't a candidate
CACHED = 200_000
# Where ranges of scripts begin (Unicode blocks).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
_STARTS, _NAMES = zip(*SCRIPTS, strict=True)
LETTER = re.compile(r"[^\W\d_]")
_MARKS = "".join(map(re.escape, (chr(c) for c in range(0x300, 0x20000) if unicodedata.category(chr(c))[0] == "M")))
WORD = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*")


def script(word: str) -> str:
    return _NAMES[bisect_right(_STARTS, ord(word[0])) - 1]


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Model:
    """log probabilities of trigrams for each language, and the scripts of each language."""

    def __init__(self, counts: list[tuple[str, str, int]], scripts: list[tuple[str, str, int]]):
        self.languages = sorted({x[0] for x in counts} | {x[0] for x in scripts})
        place = {k: i for i, k in enumerate(self.languages)}
        self.gram: dict[str, int] = {}
        for _, g, _ in counts:
            self.gram.setdefault(g, len(self.gram) + 1)  # row 0: unknown
        table = np.full((len(self.gram) + 1, len(place)), 0.5)
        for lang, g, n in counts:
            table[self.gram[g], place[lang]] += n
        self.table = np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)
        self.masks: dict[str, np.ndarray] = {}
        for lang, s, _ in scripts:
            self.masks.setdefault(s, np.full(len(place), OUT, np.float32))[place[lang]] = 0

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: the candidates' log probabilities, OUT for others; all 0 for unseen scripts."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        parts = [grams(w.lower()) for w in words]
        rows = np.fromiter((self.gram.get(g, 0) for p in parts for g in p), np.int64)
        starts = np.cumsum([0, *map(len, parts[:-1])])
        sums = np.add.reduceat(self.table[rows], starts, axis=0)
        nothing = np.zeros(len(self.languages), np.float32)
        masks = [self.masks.get(script(w)) for w in words]
        known = np.array([m is not None for m in masks])
        return np.where(known[:, None], sums + np.stack([nothing if m is None else m for m in masks]), 0).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word. scores holds the texts' words one text after another. All texts go forward
    side by side, longest first, so that those still running are a prefix."""
    n, k = scores.shape
    best = np.zeros(n, np.int16)
    if not n:
        return best
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    order = order[: int((lengths > 0).sum())]
    starts, lengths = starts[order], lengths[order]
    running = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # texts with a t-th word
    back = np.zeros((n, k), np.int16)
    own = np.arange(k, dtype=np.int16)
    state = scores[starts].copy()
    for t in range(1, lengths[0]):
        a = running[t]
        live = state[:a]
        top = live.argmax(axis=1)
        jump = live[np.arange(a), top] - switch
        stay = live >= jump[:, None]
        at = starts[:a] + t
        back[at] = np.where(stay, own, top[:, None].astype(np.int16))
        state[:a] = np.where(stay, live, jump[:, None]) + scores[at]
    label = state.argmax(axis=1).astype(np.int16)
    for t in range(lengths[0] - 1, -1, -1):
        a = running[t]
        at = starts[:a] + t
        best[at] = label[:a]
        label[:a] = back[at, label[:a]]
    return best


def fit_languages(docs: DataFrame, most: int = MOST_ROWS, text: str = "text", lang: str = "lang") -> Model:
    """A model of the rows with a language that are not held out, about `most` at most: that bounds the trigrams
    that reach the driver."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col("doc_id"))).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), "doc_id")
    rows = bounded_sample(rows, most, "doc_id").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text))
            total: Counter = Counter()
            for lang, counts in words.items():
                for word, n in counts.items():
                    total[lang, "script", script(word)] += n
                    for g in grams(word.lower()):
                        total[lang, "gram", g] += n
            columns = [list(c) for c in zip(*total, strict=True)] if total else [[], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(total.values(), pa.int64())], names=["lang", "kind", "name", "n"])

    sums = rows.mapInArrow(count, "lang string, kind string, name string, n long").groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))
    found = sums.collect()
    pick = lambda kind: sorted((r["lang"], r["name"], r["n"]) for r in found if r["kind"] == kind)
    return Model(pick("gram"), pick("script"))


def last_end(text: str) -> int:
    """Where the last word ends."""
    return WORD.match(text, next(i for i in range(len(text) - 1, -1, -1) if LETTER.match(text[i]))).end()


def identify(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """docs with `language`: struct of lang, score and spans (start, end, lang; code points, end exclusive)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    @F.arrow_udf("struct<lang:string,score:double,spans:array<struct<start:bigint,end:bigint,lang:string>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, names = sent.value, sent.value.languages
        rows: dict[str, int] = {}
        table = np.zeros((0, len(names)), np.float32)
        for texts in batches:
            for at in range(0, len(texts), 2000):
                part = [t or "" for t in texts.slice(at, 2000).to_pylist()]
                words = [WORD.findall(t) for t in part]
                if len(rows) > CACHED:
                    rows, table = {}, table[:0]
                fresh = list(dict.fromkeys(w for ws in words for w in ws if w not in rows))
                table = np.concatenate([table, m.scores(fresh)])
                rows.update(zip(fresh, range(len(rows), len(rows) + len(fresh)), strict=True))
                index = np.fromiter((rows[w] for ws in words for w in ws), np.int64)
                sizes = np.fromiter((len(w) for ws in words for w in ws), np.int64, len(index))
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                labels = viterbi(table[index], lengths, switch) if names else np.zeros(len(index), np.int16)
                langs, scores, spans, p = [], [], [], 0
                for t, n in zip(part, lengths.tolist(), strict=True):
                    own, size = labels[p : p + n], sizes[p : p + n]
                    p += n
                    if not n or not names or not any(map(str.isalpha, t)):
                        langs.append("und"), scores.append(0.0), spans.append([])
                        continue
                    share = np.bincount(own, weights=size, minlength=len(names))
                    top = int(share.argmax())
                    langs.append(names[top]), scores.append(float(share[top] / share.sum()))
                    turns = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), n]
                    ends = [x.span() for x in WORD.finditer(t)] if len(turns) > 2 else None
                    first = ends[0][0] if ends else WORD.search(t).start()
                    close = [e[1] for e in ends] if ends else None
                    spans.append([{"start": ends[a][0] if ends else first, "end": close[b - 1] if ends else last_end(t), "lang": names[own[a]]} for a, b in zip(turns, turns[1:], strict=False)])
                yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["lang", "score", "spans"])

    return set_aside(docs, "language").withColumn("language", run(F.col(text).cast("string")))
