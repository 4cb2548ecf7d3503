import random

import xxhash
from pyspark.sql import functions as F

from holdfast.llm import simhash
from holdfast.llm.graph import connected_components

from .cases import COPIED, docs, none, rows


def slow(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute(pairs):
    """pairs: (doc_id, fp) -> component of each."""
    comp = list(range(len(pairs)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 2:
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, least.get(find(i))) for i, (d, _) in enumerate(pairs)]


def test_fingerprints_and_components(spark):
    got = [tuple(r) for r in simhash.near_duplicates(docs(spark)).withColumn("fp", simhash.hex64(F.col("fp"))).collect()]
    want = [(r[0], slow(r[1])) for r in rows()]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted([(d, f) for d, f, _ in got], key=key) == sorted([(d, f"{f:016x}") for d, f in want], key=key)
    assert sorted([(d, c) for d, _, c in got], key=key) == sorted(brute(want), key=key)
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_links_of_random_fingerprints(spark):
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for _ in range(200):
        f = rnd.choice(fps)
        for _ in range(rnd.randint(0, 3)):
            f ^= 1 << rnd.randrange(64)
        fps.append(f)
    fps = list(dict.fromkeys(fps))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = simhash.ball_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
    roots = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([tuple(x) for x in links], "a long, b long")).collect()}
    want = dict(brute([(signed(f), f) for f in fps]))
    assert all(roots.get(signed(f), signed(f)) == want[signed(f)] for f in fps)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 80)]
    roots = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(roots) == 51 + 80 and {roots[i] for i in range(51)} == {0} and {roots[1000 + i] for i in range(80)} == {1000}


def test_keep_one(spark):
    kept = simhash.keep_one(docs(spark)).collect()
    assert sum(r["text"] in (COPIED, COPIED + " Yes") for r in kept if r["doc_id"] in (5, 6, 7)) >= 1
    comps = dict(brute([(r[0], slow(r[1])) for r in rows()]))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({c for c in comps.values() if c is not None})
    assert set(kept[0].asDict()) == set(docs(spark).columns)


def test_keep_one_where_ids_repeat(spark):
    a, b, c = COPIED, "some other text that is not like it at all, with words of its own", "third one here"
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (5, b, 3), (None, b, 4), (3, a, 5), (3, c, 6), (None, "alone with no id", 7), (None, "alone with no id", 8), (7, c, 9), (7, c, 9)]
    for order in (1, -1):
        df = spark.createDataFrame(rows[::order], "doc_id long, text string, fp long").repartition(3)
        kept = sorted(map(tuple, simhash.keep_one(df).collect()), key=str)
        assert kept == sorted([(1, a, 0), (5, b, 2), (3, c, 6), (None, "alone with no id", 7)], key=str)
    assert simhash.keep_one(none(spark)).count() == 0
