"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, other columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, ids string, score double, audio string"
COPIED = "The quick brown fox jumps over the lazy dog and then it sleeps until noon in the shade of a tree."
TEXTS = [
    None, "", " ", "word", "two words", COPIED, COPIED, COPIED + " Yes", "a" * 5000, " " * 3000, "é" * 300 + " ñ 漢字 Привет мир", "tab\tand\nnew line\r\n\r\n  x",
    "don't we'll 12345 they've   ", "long text with many words " * 2000, "\U0001f600 emoji \U0001f600", "0" * 700,
]


def rows():
    base = [(i, t, "en", "s", None if t is None else len(t), 7, "x", 0.5, "y") for i, t in enumerate(TEXTS)]
    return [*base, base[5], (None, COPIED, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
