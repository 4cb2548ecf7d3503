import hashlib
import math
import random
import re
import zlib

from holdfast.llm import queries, trie
from holdfast.llm.common import materialise

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - int(math.fmod(c, 20)), [])[: h[c]] + ts[h[c] :] for c, ts in own.items()}


def brute(convs):
    """convs: conversation to its turns. Rows of all prefixes, by walking every one of them."""
    members, found = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        ids, below = members[k], kids.get(k, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves = sum(found[x][0] for x in below) or 1
        saved = sum(found[x][1] for x in below) + (len(ids) - 1) * words
        found[k] = leaves, saved
    ends = {k: sorted(c for c in ids if len(convs[c]) == len(k)) for k, ids in members.items()}
    return sorted((min(ids), len(k), min(members[k[:-1]]) if k else -1, len(ids), len(kids.get(k, [])), *found[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, ids in members.items())


def built(spark, rows, **more):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = trie.prefix_trie(*trie.rebuilt(materialise(trie.turns_of(table))), **more)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in got.select(names).collect())


def test_fattest_numbers(spark):
    want = {(a, b): max(range(a + 1, b + 1), key=lambda x: (x & -x, -x)) for a in range(40) for b in range(a + 1, 41)}
    rows = spark.createDataFrame(list(want), "a long, b long")
    assert {(r[0], r[1]): r[2] for r in rows.select("a", "b", trie.fattest(rows.a, rows.b)).collect()} == want


def test_random_conversations_equal_brute_force(spark):
    for seed in (1,):
        draw = random.Random(seed)
        rows = []
        for c in draw.sample(range(-30, 400), 120):
            n, path = draw.choice((1, 2, 3, 8, 40, 90)), draw.randrange(3)
            for t in range(n):
                text = f"w{path} x {t // 7}" if draw.random() < 0.985 else f"own {c} {t}"
                rows.append((c, t, draw.choice(("user",)), text))
        assert built(spark, rows) == brute(rebuilt(rows))


def test_any_batches_give_one_trie(spark):
    draw = random.Random(4)
    rows = [(c, t, "u", "ab"[draw.random() < 0.2]) for c in range(60) for t in range(draw.choice((2, 5, 17)))]
    want = brute(rebuilt(rows))
    for batches in ((1,), (1, 1, 1, 1)):
        assert built(spark, rows, batches=batches) == want


def test_odd_rows(spark):
    rows = [
        (0, 1, "user", "hello  there\x1f you"), (0, None, None, None), (0, 2, "user", "x"), (0, 2, "user", "x"), (0, 2, "assistant", "x"),  # nulls, ties, repeated rows
        (20, 5, "user", ""), (21, 1, None, "x"), (7, 1, "user", "a" * 50_000 + " b"), (13, 0, "", ""), (None, 0, "user", "nobody"), (None, None, None, None),
        (-3, 0, "user", "minus"), (40, 0, "a", "b c"), (41, 0, "ab", " c"), (45, 0, "a", "b c"),
    ]
    assert built(spark, rows) == brute(rebuilt(rows))


def test_no_rows_and_other_columns(spark):
    assert built(spark, []) == [] and built(spark, [(None, 1, "a", "b")]) == []
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(1, 0, "u", "x")], SCHEMA).withColumns({c: F.lit(7) for c in ("pos", "a", "b", "words", "x", "d", "n")})
    assert trie.prefix_trie(*trie.rebuilt(trie.turns_of(table))).count() >= 1


def test_whole_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(-1 if x is None else x for x in r) for r in queries.op11_z_fast_trie(spark, SF).collect())
    assert got == brute(rebuilt(rows))


def test_sequences_find_where_they_leave(spark):
    """locate against the longest common prefix with what was put in."""
    draw = random.Random(9)
    texts = {c: ["ab"[draw.random() < 0.3] for _ in range(draw.choice((1, 4, 30)))] for c in range(50)}
    rows = [(c, t, "u", x) for c, ts in texts.items() for t, x in enumerate(ts)]
    turns = materialise(trie.turns_of(spark.createDataFrame(rows, SCHEMA)))
    sizes = turns.groupBy("conv_id").agg({"pos": "max"}).toDF("conv_id", "n")
    paths, strings, _ = trie.sequences(turns, sizes)
    known = strings.where("x < 25")
    nodes = trie.build(paths, known)
    first = {tuple(ts) for c, ts in texts.items() if c in {r["x"] for r in known.collect()}}
    lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for r in trie.locate(paths, nodes, strings.where("x >= 25").select("x", "n", "p", "q")).collect():
        assert r["e"] == max(lcp(texts[r["x"]], k) for k in first)
