import hashlib
import random

import pytest
from pyspark.sql import functions as F

from holdfast.llm import fingerprints as fp

from .cases import docs, none, rows


def shingles(text):
    w = (text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_likeness_is_close_to_jaccard():
    rnd, hashes, errors = random.Random(5), fp.Hashes(), []
    for _ in range(150):
        n = rnd.choice((1, 3, 5, 8, 40, 300, 2000))
        w = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        cut = rnd.randrange(n + 1)
        a, b = " ".join(w), " ".join(w[:cut] + [f"v{i}" for i in range(n - cut)])
        x, y = fp.minhash(a.encode(), hashes), fp.minhash(b.encode(), hashes)
        assert (fp.unpacked(fp.packed(x)) == x).all()
        errors.append(fp.likeness(x, y) - jaccard(a, b))
    assert sum(map(abs, errors)) / len(errors) < 0.04 and abs(sum(errors)) / len(errors) < 0.015 and max(map(abs, errors)) < 0.35


def test_long_texts_in_parts(monkeypatch):
    raw = " ".join(f"w{i}" for i in range(500)).encode()
    whole = fp.minhash(raw, fp.Hashes())
    monkeypatch.setattr(fp, "STEP", 37)
    assert (fp.minhash(raw, fp.Hashes()) == whole).all()


def ring_of(spark, rows):
    """(doc_id, n_chars, edited_sha256, fingerprint) of (doc_id, text) rows, in the order that the module defines."""
    hashes = dict(spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").select("t", F.xxhash64("t")).collect())
    ring = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1] is not None, r[1] or ""))
    want = []
    for (i, t), (_, n) in zip(ring, ring[1:] + ring[:1], strict=True):
        t, n = t or "", n or ""
        cut = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest(), fp.packed(fp.minhash(t.encode(), fp.Hashes()))))
    return sorted(want, key=str)


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_next_document(spark, buckets, monkeypatch):
    plain = fp.in_descending_order
    monkeypatch.setattr(fp, "in_descending_order", lambda df: plain(df, buckets=buckets))
    got = sorted(map(tuple, fp.compare_with_next(docs(spark)).select("doc_id", "n_chars", "edited_sha256", "fingerprint").collect()), key=str)
    assert got == ring_of(spark, [(r[0], r[1]) for r in rows()])


def test_one_id_and_null_ids_of_very_many_rows(spark, monkeypatch):
    plain = fp.in_descending_order
    monkeypatch.setattr(fp, "in_descending_order", lambda df: plain(df, buckets=8))
    many = [(7, f"text {i} of the one id") for i in range(300)] + [(None, f"text {i} without any") for i in range(300)] + [(i, f"text {i} of its own") for i in range(-20, 40)] + [(7, "the same")] * 5
    df = spark.createDataFrame(many, "doc_id long, text string")
    got = sorted(map(tuple, fp.compare_with_next(df).select("doc_id", "n_chars", "edited_sha256", "fingerprint").collect()), key=str)
    assert got == ring_of(spark, many)
    sizes = sorted(r["count"] for r in plain(df, buckets=8).groupBy("hf_bucket").count().collect())
    assert len(sizes) > 60 and sizes[-1] < 120


def test_columns(spark):
    assert fp.compare_with_next(none(spark)).count() == 0
    one = fp.compare_with_next(docs(spark).limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    df = docs(spark).select("text", fp.fingerprint(F.col("text")).alias("a"))
    assert all(r["l"] == 1 and len(r["a"]) == 256 for r in df.withColumn("l", fp.likeness_column(F.col("a"), F.col("a"))).collect())
