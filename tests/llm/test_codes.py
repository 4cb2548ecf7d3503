import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import codes, queries

SF = "/root/testdata/sf0.001"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """rows: (id, vector); ids unique. Codes, errors and codebooks by all distances."""
    kept = {i: [math.floor(scale * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    w = len(next(iter(kept.values()))) // parts
    cut = lambda v, p: tuple(v[p * w : p * w + w])
    books = [[cut(kept[i], p) for i in sorted(kept)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda a, book: min((far(a, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for v in kept.values():
                own.setdefault(place(cut(v, p), book)[1], []).append(cut(v, p))
            for k, members in own.items():
                book[k] = tuple(sum(c) // len(members) for c in zip(*members, strict=True))
    out = {}
    for i, v in kept.items():
        found = [place(cut(v, p), book) for p, book in enumerate(books)]
        out[i] = "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)
    return out, books


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_equals_all_distances_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    want, books = brute([(r["vec_id"], r["embedding"]) for r in rows.collect()])
    got = queries.op12_laesa_codes(spark, SF).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_ties_copies_and_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(i, (draw.integers(-2, 3, 32) / 256).tolist(), i % 3 or None) for i in range(150)]
    rows += [(500 + i, rows[i % 4][1], None) for i in range(90)]  # copies
    odd = [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, 2), (903, [float("inf")] + [0.0] * 31, 2), (904, [], 1)]
    want, _ = brute([r[:2] for r in rows])
    made, books = codes.compress(table(spark, rows + odd[:4]))
    got = codes.with_label_error(made).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and len(got) == len(rows)
    sums = {}
    for i, _, label in rows:
        sums[label] = sums.get(label, 0) + want[i][1]
    assert all(r["label_error"] == sums[r["label"]] for r in got)
    with pytest.raises(ValueError):
        codes.compress(table(spark, rows + odd))
    back = codes.restored(made, books).where("vec_id = 0").first()["restored"]
    assert sum((math.floor(256 * x) - math.floor(256 * y)) ** 2 for x, y in zip(rows[0][1], back, strict=True)) == want[0][1]


def test_rows_in_any_order_and_few_rows(spark):
    rows = [(i, [float((i * 7 + j) % 11) for j in range(16)], 1) for i in range(9)]
    want, _ = brute([r[:2] for r in rows])
    for n in (1, 5):
        made, _ = codes.compress(table(spark, rows[::-1]).repartition(n))
        assert {r["vec_id"]: (r["code"], r["error"]) for r in made.collect()} == want
    twice, _ = codes.compress(table(spark, rows + rows))
    assert twice.count() == 18
    nulls, _ = codes.compress(table(spark, [(None, r[1], None) for r in rows]))
    assert nulls.count() == 9


def test_no_rows_no_components_and_clashing_names(spark):
    assert codes.with_label_error(codes.compress(table(spark, []))[0]).count() == 0
    assert [r["code"] for r in codes.compress(table(spark, [(1, [], 1), (2, [], None)]))[0].collect()] == ["00" * 16] * 2
    more = table(spark, [(1, [1.0] * 16, 1)]).withColumns({"v": F.lit(1), "code": F.lit(2), "to_pivots": F.lit(3)})
    assert codes.compress(more)[0].columns == ["vec_id", "label", "code", "error"]


def test_bounds_spare_distances_and_lose_no_tie():
    draw = np.random.default_rng(8)
    for size in (3, 200, 1 << 27):
        entries = draw.integers(-size, size, (64, 4))
        parts = np.concatenate([draw.integers(-size, size, (2_000, 4)), entries, (entries[:-1] + entries[1:]) // 2])
        pivots = codes.far_apart(entries, 4)
        who, best, evaluated = codes.nearest(parts, codes.squared(parts, pivots), entries, pivots)
        every = codes.squared(parts, entries)
        assert (who == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
        if size > 3:
            assert evaluated < 0.35 * every.size

