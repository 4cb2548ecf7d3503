import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from holdfast.llm import bpe, mixing
from holdfast.llm.stats import text_stats

from .cases import docs, none


def table(spark):
    rnd = random.Random(4)
    plain = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(300):
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 60))]
        kind = ("clean", "toxic", "low")[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]
        if kind == "toxic":
            words[3] = words[9] = rnd.choice(("blorp", "zork"))
        text = " | ".join(words) if kind == "low" else " ".join(words)
        rows.append((i, text, kind))
    return spark.createDataFrame(rows, "doc_id long, text string, domain string")


def test_totals_meet_targets(spark):
    rows = table(spark)
    targets = {"clean": 0.6, "toxic": 0.1, "low": 0.3}
    out = mixing.mix(rows.drop("domain"), rows.select("doc_id", "domain"), targets).collect()
    total, names = sum(r["tokens"] for r in out), sorted(targets)
    for i, n in enumerate(names):
        assert abs(sum(r["rate"] * r["tokens"] * r["posterior"][i] for r in out) / total - targets[n]) < 0.01
    assert len(out) == 300 and all(r["rate"] >= 0 and abs(sum(r["posterior"]) - 1) < 1e-6 for r in out)
    true = {r["doc_id"]: r["domain"] for r in rows.collect()}
    assert np.mean([names[int(np.argmax(r["posterior"]))] == true[r["doc_id"]] for r in out]) > 0.95


def test_rates_equal_brute_force_projected_gradient(spark):
    rnd = np.random.default_rng(3)
    p = rnd.dirichlet((0.3, 0.3, 0.3), 200)
    tokens = rnd.integers(0, 100, 200).astype(float)
    df = spark.createDataFrame([(float(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "tokens double, posterior array<double>")
    for cap, grid in ((None, None), (1.0, None), (None, 512)):
        shares = np.array([0.7, 0.05, 0.25])
        if cap:
            shares *= (total := mixing.largest_total(df, shares.tolist(), cap))
            assert 0.3 < total < ((tokens @ p) / tokens.sum() / [0.7, 0.05, 0.25]).min()
        gradients, reached = mixing.fit_rates(df, shares.tolist(), cap, grid=grid)
        got = np.array([r["rate"] for r in df.withColumn("rate", mixing.rate(F.col("posterior"), gradients, cap=cap)).collect()])
        r, y, first = np.ones(200), np.ones(200), None
        for i in range(len(gradients)):
            now = (y * tokens) @ p / tokens.sum()
            first = now if first is None else first
            new = np.clip(y - p @ ((now - shares) / first), 0, cap)
            r, y = new, new + i / (i + 3) * (new - r)
        assert np.abs(got - r).max() < (0.05 if grid else 1e-3)
        assert np.abs(np.array(reached) - shares).max() < 1e-3 and np.abs((got * tokens) @ p / tokens.sum() - shares).max() < (5e-3 if grid else 1e-3 if cap else mixing.ENOUGH)
        assert cap is None or got.max() <= cap


def test_largest_total_of_separate_domains(spark):
    df = spark.createDataFrame([(60.0, [1.0, 0.0]), (20.0, [1.0, 0.0]), (20.0, [0.0, 1.0]), (0.0, [0.5, 0.5])], "tokens double, posterior array<double>")
    for shares, want in (([0.95, 0.05], 0.8 / 0.95), ([0.5, 0.5], 0.4), ([0.8, 0.2], 1.0)):
        assert abs(mixing.largest_total(df, shares, 1.0) - want) < 0.01
    assert mixing.largest_total(df.where("posterior[0] = 1"), [0.5, 0.5], 1.0) == 1.0 == mixing.largest_total(df.where("tokens < 0"), [0.5, 0.5], 1.0)


def test_tokens_are_ids_and_missed_targets_are_told(spark, caplog):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["a", "don't", " ", "  ", "\n", "\t", "\x1c", "\u00a0", "\u3000", "1", "23", ".", "é漢", "'s", " word"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    df = docs(spark).select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    ranks = public_tokenizers.path(mixing.RANKS)
    coded = bpe.bpe_encode(df, ranks, public_tokenizers.PATTERN)
    both = coded.select(text_stats(F.col("text"), None, mixing.token_counter(coded))["tokens"].alias("tokens"), F.octet_length("ids").alias("n")).collect()
    assert len(both) == df.count() and all(r["tokens"] == r["n"] / 4 for r in both)
    rows = table(spark)
    mixed = mixing.mix(rows.drop("domain"), rows.select("doc_id", "domain"), {"clean": 0.95, "toxic": 0.05}, cap=1.0)
    assert "shares reached" not in caplog.text and np.abs(np.array(mixing.reached_shares(mixed, 2, True)) - (0.95, 0.05)).max() < 1e-3
    mixing.mix(rows.drop("domain"), rows.where("domain = 'clean'").select("doc_id", "domain"), {"clean": 0.2, "toxic": 0.8}, cap=1.0)
    assert "shares reached" in caplog.text


def test_resample_and_odd_rows(spark):
    rows = table(spark)
    known = rows.select("doc_id", "domain")
    kept = mixing.resample(rows, known, {"clean": 0.95, "toxic": 0.05}, cap=1.0)
    counts = {r["domain"]: r["count"] for r in kept.groupBy("domain").count().collect()}
    assert kept.columns == rows.columns and counts["clean"] >= 0.9 * 210 and counts["toxic"] < 40 and kept.select("doc_id").distinct().count() == kept.count()
    for df in (docs(spark), none(spark)):
        assert mixing.resample(df, known).columns == df.columns
        out = mixing.mix(df, known).collect()
        assert len(out) == df.count() and all(r["rate"] >= 0 for r in out)
    assert {r["rate"] for r in mixing.mix(docs(spark), known.limit(0)).collect()} != set()


def test_conflicting_labels_and_clashing_columns(spark):
    rows = table(spark)
    known = rows.select("doc_id", "domain")
    twice = known.union(known.where("doc_id < 100").withColumn("domain", F.lit("toxic")))
    a, b = (sorted(map(tuple, mixing.mix(rows.drop("domain"), k.repartition(n, "domain")).select("doc_id", "rate").collect())) for k, n in ((twice, 3), (twice.orderBy(F.desc("domain")), 5)))
    assert a == b
    c = sorted(map(tuple, mixing.mix(rows.drop("domain").repartition(7, F.xxhash64("text")), twice.repartition(4)).select("doc_id", "rate").collect()))
    assert a == c
    out = mixing.mix(rows.withColumn("rate", F.lit("mine")), known, keep=("doc_id", "rate"))
    assert out.columns == ["doc_id", "rate_input", "tokens", "posterior", "rate"] and {r["rate_input"] for r in out.collect()} == {"mine"}
