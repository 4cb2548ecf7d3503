"""WARC in seekable Zstandard bundles.

Records are grouped into frames that are compressed each on its own; a skippable frame at the end has the
seek table (compressed and raw size of every frame), so any frame can be read alone. The index has, for
each record, its frame and its place in the frame's raw bytes. A bundle is a whole .warc.zst file in a
binary column; Spark's own writers store the table of bundles, so it can lie in any store.

Every record has an id of its own (a random UUID) and a date; the page's id stands in the header Page-ID. Records with
one payload (of at least `least` bytes): that with the smallest page id is the response, the others revisit it, name its
URI, date and page id, and have no block. `index_of` gives the place of every record, and `fetch` reads the records of
some pages: of each bundle only the frames that hold one.

Null payloads are empty. Null page ids: such a row is a revisit if any row with its payload has an id, otherwise a
response; its record has no Page-ID. Rows repeated with their id are all responses. An empty table gives no bundle.
Only the columns of id, URL and payload are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 100
FRAME, BUNDLE = 256 << 10, 16 << 20
# Fixed values of the seekable format: skippable frame number 14, footer magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, refers_url): the last two are null for responses."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = rows.where(F.octet_length("payload") >= least).groupBy(F.sha2("payload", 256).alias("digest")).agg(F.min(named).alias("first"), F.count("*").alias("n"))
    first = first.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    rows = rows.withColumn("digest", F.sha2("payload", 256)).join(first, "digest", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return rows.select("page_id", "url", "payload", "digest", F.when(other, F.col("first.page_id")).alias("refers_to"), F.when(other, F.col("first.url")).alias("refers_url"))


def uri(url: str | None) -> str:
    return re.sub(r"[^!-~]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri(url)}"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To-Target-URI: {uri(refers_url)}", f"WARC-Refers-To-Date: {date}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a place in a frame."""
    end = raw.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in raw[at:end].decode().split("\r\n")[1:])
    size = int(head["Content-Length"])
    return head, raw[end + 4 : end + 4 + size], end + 8 + size


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame: (compressed, raw) sizes, number of frames, descriptor 0, magic."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(blob: bytes) -> list[tuple[int, int]]:
    """(offset, compressed size) of each frame, from the footer alone."""
    n, descriptor, magic = struct.unpack("<IBI", blob[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if descriptor & 0x80 else 8
    at, found, table = 0, [], blob[-9 - n * width : -9]
    for i in range(n):
        size, _ = struct.unpack_from("<II", table, i * width)
        found.append((at, size))
        at += size
    return found


COLUMNS = ("page_id", "url", "payload", "digest", "refers_to", "refers_url")
INDEX = "array<struct<page_id:bigint,frame:int,offset:int,length:int>>"


def write_bundles(records: DataFrame, frame: int = FRAME, bundle: int = BUNDLE, level: int = 3, date: str | None = None) -> DataFrame:
    """(bundle_id, n_records, warc_zst, index) bundles of about `bundle` raw bytes at most, besides single larger
    records. date: when the pages were fetched (UTC, as in 2020-01-31T12:00:00Z); now, where it isn't given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    kind = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level)
        frames: list[tuple[int, int]] = []
        parts, index, raw, held, total = [], [], [], 0, 0

        def close_frame():
            nonlocal held
            block = b"".join(raw)
            parts.append(packer.compress(block))
            frames.append((len(parts[-1]), len(block)))
            raw.clear()
            held = 0

        def close_bundle():
            nonlocal total
            if raw:
                close_frame()
            blob = b"".join(parts) + seek_table(frames)
            row = pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([len(index)], pa.int64()), pa.array([blob], pa.binary()), pa.array([index], kind)], names=["bundle_id", "n_records", "warc_zst", "index"])
            for x in (parts, frames):
                x.clear()
            total = 0
            return row

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                record = record_bytes(*row, date)
                index.append({"page_id": row[0], "frame": len(frames), "offset": held, "length": len(record)})
                raw.append(record)
                held += len(record)
                total += len(record)
                if held >= frame:
                    close_frame()
                if total >= bundle:
                    yield close_bundle()
                    index = []
        if index:
            yield close_bundle()

    return records.select(*COLUMNS).mapInArrow(run, f"bundle_id string, n_records long, warc_zst binary, index {INDEX}")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload): one row for each index
    entry, by its frame and place; only frames with an entry are read. Revisits have no payload; their digest is the
    record's. A response whose payload doesn't have its record's digest is an error."""
    names = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for blob, index in zip(batch.column("warc_zst"), batch.column("index"), strict=True):
                blob, index = blob.as_py(), index.as_py()
                places = read_seek_table(blob)
                at, raw, rows = -1, b"", []
                for entry in index:
                    if entry["frame"] != at:
                        at = entry["frame"]
                        offset, size = places[at]
                        raw = unpacker.decompress(blob[offset : offset + size])
                    head, block, end = parse_record(raw, entry["offset"])
                    if end != entry["offset"] + entry["length"]:
                        raise ValueError(f"record {entry['page_id']} has another length than its index entry")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if (is_response := head["WARC-Type"] == "response") and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"record {entry['page_id']} has another payload than its digest says")
                    number = lambda name: int(head[name]) if name in head else None
                    rows.append((number("Page-ID"), head["WARC-Target-URI"], head["WARC-Type"], digest, len(block) if is_response else None, number("Refers-To-Page-ID"), block if is_response else None))
                for i in range(0, len(rows), 1000):
                    columns = zip(*rows[i : i + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, names.values(), strict=True)], names=list(names))

    return bundles.select("warc_zst", "index").mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def index_of(bundles: DataFrame) -> DataFrame:
    """(page_id, bundle_id, frame, offset, length) of every record."""
    return bundles.select("bundle_id", F.explode("index").alias("e")).select("e.page_id", "bundle_id", "e.frame", "e.offset", "e.length")


def fetch(bundles: DataFrame, index: DataFrame, pages: DataFrame) -> DataFrame:
    """The records of some pages, as read_bundles gives them (a revisit has no payload; its response is the page
    `refers_to`). index: of index_of; pages: page_id. Bundles without such a record aren't read, and of the others
    only the frames that hold one."""
    wanted = index.join(pages.select("page_id").distinct(), "page_id", "left_semi")
    entry = F.struct("page_id", "frame", "offset", "length")
    wanted = wanted.groupBy(F.col("bundle_id").alias("hf_bundle")).agg(F.sort_array(F.collect_list(F.struct("frame", "offset", entry.alias("e")))).alias("hf"))
    found = bundles.select("bundle_id", "warc_zst").join(wanted, F.col("bundle_id") == F.col("hf_bundle"))
    return read_bundles(found.select("warc_zst", F.col("hf.e").alias("index")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records with the payload's length of every revisit taken from the response that it refers to."""
    said = records.where((F.col("record_type") == "response") & F.col("page_id").isNotNull())
    said = said.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload_bytes").alias("hf_bytes"))
    revisits = records.where(F.col("record_type") == "revisit").join(said, ["refers_to", "payload_digest"], "left")
    known = F.coalesce("hf_bytes", F.raise_error(F.lit("a revisit refers to no response with its payload")).cast("long"))
    revisits = revisits.withColumn("payload_bytes", known).select(records.columns)
    return records.where(F.col("record_type") == "response").unionByName(revisits)
