from collections import Counter
from math import log

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from holdfast.llm import bpe, lm

from .cases import docs, none

PATH = public_tokenizers.path(lm.RANKS)
RANKS = bpe.read_ranks(open(PATH, "rb").read())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
EDGE = max(RANKS.values()) + 1


def grams(text):
    ids = [EDGE, *LIBRARY.encode_ordinary(text or ""), EDGE]
    return list(zip(ids, ids[1:], strict=False))


def brute(texts):
    """log p of a token after another, from plain counts."""
    two = Counter(g for t in texts for g in grams(t))
    one, context, kinds = Counter(), Counter(), Counter()
    for (a, b), n in two.items():
        one[b] += n
        context[a] += n
        kinds[a] += 1

    def p(gram):
        a, b = gram
        k1, k2 = max(1, len(one)), max(1, kinds[a])
        p1 = (one[b] + k1 / (EDGE + 1)) / (sum(one.values()) + k1)
        return (two[gram] + k2 * p1) / (context[a] + k2)

    return p


TEXTS = ["the cat sat on the mat", "the dog sat", "", "zzz qqq é", "the the the", None, "a" * 3000 + " \x1c\x85 漢字", "the cat sat on the mat"]


@pytest.mark.parametrize("part", [lm.PART, 5, 1])
def test_scores_equal_brute_force(spark, part, monkeypatch):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "the cat", "x"), (1, "no dog", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lm string").repartition(3)
    got = lm.cross_entropy_difference(df, df.where("doc_id in (0, 1)"), ("doc_id", "text"), part=part).collect()
    assert len(got) == len(rows)
    for r in got:
        own, me = grams(r["text"]), (r["doc_id"], r["text"], "x")
        others = [x for i, x in enumerate(rows) if i != rows.index(me)]  # all but the row itself
        t, b = brute([x[1] for x in others if x[0] in (0, 1)]), brute([x[1] for x in others])
        x, y = (-sum(log(m(g)) for g in own) / len(own) for m in (t, b))
        assert r["lm"]["n_tokens"] == len(own) and np.allclose([r["lm"]["target"], r["lm"]["background"], r["lm"]["difference"]], [x, y, x - y], atol=1e-9)


def test_target_rows_and_held_out_rows_of_a_kind_score_alike(spark):
    import random

    draw = random.Random(3)
    kinds = {k: [f"{k}{draw.randrange(10**4)}" for _ in range(60)] for k in ("good", "bad")}
    rows = [(i, " ".join(draw.choice(kinds["good" if i % 2 else "bad"]) for _ in range(60))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["lm"]["difference"] for r in lm.cross_entropy_difference(df, df.where("doc_id % 4 = 1")).collect()}
    mean = lambda r: np.mean([got[i] for i in range(400) if i % 4 == r])
    assert abs(mean(1) - mean(3)) < 0.1 and max(mean(1), mean(3)) < mean(0) - 1 and max(mean(1), mean(3)) < mean(2) - 1


def test_counts_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    parts = [(rng.integers(0, 9, rng.integers(1, 12)), bool(rng.integers(2))) for _ in range(30)]
    monkeypatch.setattr(lm, "STEP", 7)
    counts = lm.Counts()
    for grams_, is_target in parts:
        counts.add(grams_, is_target)
    kinds, target, every = counts.settle()
    all_, good = Counter(x for g, _ in parts for x in g.tolist()), Counter(x for g, t in parts if t for x in g.tolist())
    assert kinds.tolist() == sorted(all_) and every.tolist() == [all_[k] for k in sorted(all_)] and target.tolist() == [good[k] for k in sorted(all_)]
    assert (lm.unplaned(lm.planes([5, 70_000, 0])) == [5, 70_000, 0]).all() and len(lm.unplaned(lm.planes([]))) == 0


def test_odd_rows(spark):
    for df in (docs(spark), none(spark)):
        assert lm.cross_entropy_difference(df, docs(spark)).count() == df.count()
    assert all(r["lm"]["background"] > 0 for r in lm.cross_entropy_difference(docs(spark), none(spark)).collect())
    clash = lm.cross_entropy_difference(docs(spark).withColumnRenamed("fp", "LM"), docs(spark), ("doc_id", "LM"))
    assert clash.columns == ["doc_id", "LM_input", "lm"] and {r["LM_input"] for r in clash.collect()} == {7, None}
