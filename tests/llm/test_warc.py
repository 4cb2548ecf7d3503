import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from holdfast.llm import warc
from holdfast.llm.common import materialise

BIG = "<p>same</p>" * 20
ROWS = [(3, "http://a/é b", BIG), (1, "http://b", BIG), (2, None, BIG), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "x" * 100), (9, "u", "x" * 99), (10, "u", "x" * 99),
        (None, "n", BIG), (None, None, "alone" * 50), (11, "v", "long " * 40000), (12, "v", "long " * 40000), (8, "u", "x" * 100)]


def run(spark, rows, **sizes):
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, digest long, payload long")
    bundles = warc.write_bundles(warc.plan_records(pages).coalesce(2), **sizes)
    return bundles, warc.resolve_revisits(warc.read_bundles(bundles)).collect()


@pytest.mark.parametrize("sizes", [{}, {"frame": 500, "bundle": 3000}])
def test_round_trip(spark, sizes):
    _, got = run(spark, ROWS, **sizes)
    want = []
    for i, _, html in ROWS:
        raw = (html or "").encode()
        first = min((j for j, _, h in ROWS if (h or "") == (html or "") and j is not None), default=None) if len(raw) >= 100 else None
        visit = first is not None and first != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if visit else "response", first if visit else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]


def test_frames_are_independent_and_the_bundle_is_plain_zstandard(spark):
    bundles, _ = run(spark, ROWS, frame=500, bundle=10_000)
    seen = []
    for r in bundles.collect():
        blob = bytes(r["warc_zst"])
        places = warc.read_seek_table(blob)
        frames = [zstandard.ZstdDecompressor().decompress(blob[a : a + n]) for a, n in places]
        whole = zstandard.ZstdDecompressor().stream_reader(blob, read_across_frames=True).read()
        assert whole == b"".join(frames) and r["n_records"] == len(r["index"])
        for e in r["index"]:
            head, _, end = warc.parse_record(frames[e["frame"]], e["offset"])
            assert end - e["offset"] == e["length"] and head.get("Page-ID") == (None if e["page_id"] is None else str(e["page_id"]))
            assert head["WARC-Date"].endswith("Z") and head["WARC-Record-ID"].startswith("<urn:uuid:")
            seen.append(head["WARC-Record-ID"])
            if head["WARC-Type"] == "revisit":
                assert head["WARC-Refers-To-Target-URI"] in ("http://b", "v") and head["Refers-To-Page-ID"] in ("1", "11")
    assert len(set(seen)) == len(seen) == len(ROWS)


def test_fetch_reads_the_frames_of_its_pages_only(spark):
    bundles, _ = run(spark, ROWS, frame=500, bundle=10_000)
    bundles = materialise(bundles)
    index = warc.index_of(bundles)
    assert index.count() == len(ROWS)
    places = {(r["bundle_id"], r["frame"]) for r in index.where("page_id in (2, 9, 12)").collect()}
    broken = []
    for r in bundles.collect():
        blob = bytearray(r["warc_zst"])
        for i, (at, size) in enumerate(warc.read_seek_table(bytes(blob))):
            if (r["bundle_id"], i) not in places:
                blob[at : at + size] = bytes(size)  # a read of any other frame would fail
        broken.append((r["bundle_id"], bytes(blob)))
    broken = spark.createDataFrame(broken, "bundle_id string, warc_zst binary")
    got = warc.fetch(broken, index, spark.createDataFrame([(2,), (9,), (12,), (9,), (77,)], "page_id long")).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in got) == [(2, "revisit", 1, None), (9, "response", None, b"x" * 99), (12, "revisit", 11, None)]
    with pytest.raises(Exception):  # noqa: B017
        warc.fetch(broken, index, spark.createDataFrame([(1,), (3,), (4,), (11,)], "page_id long")).collect()


def test_no_rows_and_damage(spark):
    assert run(spark, [])[1] == []
    bundles, _ = run(spark, ROWS)
    with pytest.raises(Exception, match="seek table"):
        warc.read_bundles(bundles.withColumn("warc_zst", F.lit(b"0" * 40))).collect()
