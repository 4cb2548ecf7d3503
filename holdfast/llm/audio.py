"""MPEG audio columns: write payloads into protected frames, read any MPEG audio stream back.

The reader takes MPEG-1, 2 and 2.5, layers I to III: it skips ID3v2, finds the first frame, follows
headers, resynchronises after damage, reads Xing/Info/VBRI tables and ID3v1 tags, verifies checksums and
returns exact durations (samples over sample rate) and the byte offset of every frame for seeking.

The writer keeps a payload without loss: each Layer III frame has an empty side information (it decodes to
silence), so all bytes behind it are ancillary data, which hold the payload. An Info frame with frame
count, byte count, seek table and checksums stands first, an ID3v2 tag before it has the payload's length.

Defined results: null bytes are taken as empty; bytes without any frame give n_frames 0, duration 0 and a
null payload; damaged frames count in crc_bad; bytes skipped while resynchronising count in skipped_bytes. Repeated
rows get equal results, an empty table an empty one; a column `audio` that docs already have is kept as `audio_input`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import set_aside

# Fixed values of the MPEG audio header: kbit/s by index for (version 1?, layer), Hz by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}

PAD_TO = 64
#: What read_stream finds, in Spark's types.
FIELDS = {
    "n_frames": "bigint", "n_samples": "bigint", "sample_rate": "int", "channels": "int", "version": "string", "layer": "int",
    "duration_s": "double", "mean_kbps": "double", "min_kbps": "int", "max_kbps": "int", "vbr": "string", "vbr_frames": "bigint",
    "crc_ok": "bigint", "crc_bad": "bigint", "crc_absent": "bigint", "tag_crc_ok": "boolean", "music_crc_ok": "boolean",
    "resyncs": "bigint", "skipped_bytes": "bigint", "tags": "map<string,string>", "toc": "array<bigint>", "frame_offsets": "array<bigint>",
}
STORED = {"payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string"}
ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "map<string,string>": pa.map_(pa.string(), pa.string()), "array<bigint>": pa.list_(pa.int64()),
}


@lru_cache(maxsize=4096)
def header(h: bytes) -> tuple | None:
    """(length, samples, rate, channels, version bits, layer, kbps, protected, side bytes), or None if invalid.
    Free-format frames (bitrate index 0) have no length in the header and count as invalid."""
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer = h[1] >> 3 & 3, 4 - (h[1] >> 1 & 3)
    bitrate, rate = h[2] >> 4, h[2] >> 2 & 3
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or h[3] & 3 == 2:
        return None
    v1 = version == 3
    kbps, hz, padding = BITRATES[v1, layer][bitrate], RATES[version][rate], h[2] >> 1 & 1
    channels = 1 if h[3] >> 6 == 3 else 2
    samples = 384 if layer == 1 else 1152 if layer == 2 or v1 else 576
    length = (12 * kbps * 1000 // hz + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + padding
    side = 0 if layer < 3 else ((17 if channels == 1 else 32) if v1 else (9 if channels == 1 else 17))
    return length, samples, hz, channels, version, layer, kbps, not h[1] & 1, side


@lru_cache(maxsize=1 << 16)
def frame_crc(protected: bytes) -> int:
    """The frame checksum: polynomial 0x8005, most significant bit first, from 0xFFFF."""
    crc = 0xFFFF
    for byte in protected:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _advanced(n_bytes: int) -> np.ndarray:
    """For each 16-bit state, the reflected CRC-16 (0xA001) after n_bytes zero bytes."""
    state = np.arange(65536, dtype=np.uint32)
    for _ in range(8 * n_bytes):
        state = np.where(state & 1, state >> 1 ^ 0xA001, state >> 1)
    return state.astype(np.uint16)


@lru_cache(maxsize=None)
def _steps() -> tuple[np.ndarray, list[int]]:
    return _advanced(2), _advanced(16).tolist()


def music_crc(data: bytes) -> int:
    """CRC-16 of the Info tag (reflected 0x8005 from 0). Lanes of 16 bytes go side by side; zeros in
    front change nothing, so the first lane is filled up there."""
    two, lane = _steps()
    words = np.frombuffer(b"\0" * (-len(data) % 16) + data, "<u2").reshape(-1, 8)
    part = np.zeros(len(words), np.uint16)
    for j in range(8):
        part = two[part ^ words[:, j]]
    crc = 0
    for p in part.tolist():
        crc = lane[crc] ^ p
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write_stream(payload: bytes) -> bytes:
    """An MPEG-1 Layer III stream (mono, 32 kHz, variable bitrate, protected frames) that holds payload."""
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    frame = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    tag = b"ID3\x03\0\0" + _syncsafe(len(frame)) + frame
    frames, sizes, at = [], [], 0
    room = [(i, header(bytes((0xFF, 0xFA, i << 4 | 2 << 2, 0xC0)))[0] - 23) for i in range(1, 15)]
    while at < len(payload):
        left = len(payload) - at
        index, size = next((r for r in room if r[1] >= left), room[-1])
        head = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0xC0))
        body = payload[at : at + size]
        frames.append(head + frame_crc(head[2:] + bytes(17)).to_bytes(2, "big") + bytes(17) + body + bytes(size - len(body)))
        sizes.append(len(frames[-1]))
        at += size
    music = b"".join(frames)
    head = bytes((0xFF, 0xFB, 5 << 4 | 2 << 2, 0xC0))
    whole = header(head)[0] + len(music)
    starts = np.cumsum([header(head)[0], *sizes[:-1]])
    toc = bytes(min(255, int(starts[len(sizes) * p // 100]) * 256 // whole) for p in range(100))
    info = head + bytes(17) + b"Xing" + (15).to_bytes(4, "big") + len(sizes).to_bytes(4, "big") + whole.to_bytes(4, "big") + toc + (100).to_bytes(4, "big")
    info += b"holdfast1" + bytes((0x03, 0)) + bytes(4 + 2 + 2 + 1 + 1 + 3 + 1 + 1 + 2) + whole.to_bytes(4, "big") + music_crc(music).to_bytes(2, "big")
    info += music_crc(info).to_bytes(2, "big")
    return tag + info + bytes(header(head)[0] - len(info)) + music


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """End of the ID3v2 tags at the start, and their text frames."""
    at, tags = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = sum((b & 0x7F) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        major, p, end = data[at + 3], at + 10, min(at + 10 + size, len(data))
        while major >= 3 and p + 10 <= end and data[p : p + 4].strip(b"\0"):
            raw = data[p + 4 : p + 8]
            n = sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if major == 4 else int.from_bytes(raw, "big")
            name, body = data[p : p + 4].decode("latin-1"), data[p + 10 : min(p + 10 + n, end)]
            if name[0] == "T" and body:
                coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                text = body[1:].decode(coding, "replace").rstrip("\0")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                tags[key] = value
            p += 10 + n
        at = at + 10 + size + (10 if data[at + 5] & 0x10 else 0)
    return min(at, len(data)), tags


def _layer1_bits(data: bytes, at: int, channels: int) -> bytes:
    """The bytes that a Layer I checksum covers besides the header: 4 bits for each subband and channel."""
    bound = (data[at + 3] >> 4 & 3) * 4 + 4 if data[at + 3] >> 6 == 1 else 32
    return data[at + 6 : at + 6 + (4 * (bound * channels + 32 - bound) + 7) // 8]


def read_stream(data: bytes) -> tuple[dict, bytes | None]:
    """The fields of a stream and the payload that write_stream has put into it (None if there is none)."""
    at, tags = _id3v2(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(key, text)
    offsets, rows, info, synced, resyncs, skipped = [], [], None, False, 0, 0
    crc_ok = crc_bad = crc_absent = 0
    first = at
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and not synced:  # a lost reader trusts a header only if another one, or the end, follows
            h = h if at + h[0] == end or header(data[at + h[0] : at + h[0] + 4]) else None
        if not h or at + h[0] > end:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            resyncs += synced
            skipped += nxt - at
            at, synced = nxt, False
            continue
        synced = True
        length, _, _, channels, _, layer, _, protected, side = h
        body = at + (6 if protected else 4) + side
        if not offsets and info is None and (data[body : body + 4] in (b"Xing", b"Info") or data[at + 36 : at + 40] == b"VBRI"):
            info, first = (at, body, h), at
        else:
            offsets.append(at)
            rows.append(h)
            if not protected:
                crc_absent += 1
            elif layer == 2:  # its checksum ends inside the allocation tables: not verified
                crc_absent += 1
            else:
                covered = data[at + 6 : body] if layer == 3 else _layer1_bits(data, at, channels)
                good = frame_crc(data[at + 2 : at + 4] + covered) == int.from_bytes(data[at + 4 : at + 6], "big")
                crc_ok, crc_bad = crc_ok + good, crc_bad + (not good)
        at += length
    if at < end:
        skipped += end - at
    kind = vbr_frames = tag_ok = music_ok = None
    toc: list[int] = []
    if info:
        start, body, h = info
        kind = data[body : body + 4].decode() if data[start + 36 : start + 40] != b"VBRI" else "VBRI"
        if kind == "VBRI":
            v = data[start + 36 :]
            vbr_frames = int.from_bytes(v[14:18], "big")
            entries, scale, width = (int.from_bytes(v[a : a + 2], "big") for a in (18, 20, 22))
            steps = [int.from_bytes(v[26 + i * width : 26 + (i + 1) * width], "big") * scale for i in range(entries)] if width else []
            toc = np.cumsum([start + h[0], *steps]).tolist()
        else:
            flags, p = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8
            if flags & 1:
                vbr_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            total = end - start
            if flags & 2:
                total, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                toc, p = [start + b * total // 256 for b in data[p : p + 100]], p + 100
            p += 4 * bool(flags & 8)
            if p + 36 <= start + h[0] and data[p : p + 9].strip(b"\0"):
                tag_ok = music_crc(data[start : p + 34]) == int.from_bytes(data[p + 34 : p + 36], "big")
                music_ok = music_crc(data[start + h[0] : start + int.from_bytes(data[p + 28 : p + 32], "big")]) == int.from_bytes(data[p + 32 : p + 34], "big")
    samples = sum(r[1] for r in rows)
    rate = rows[0][2] if rows else None
    fields = {
        "n_frames": len(rows), "n_samples": samples, "sample_rate": rate, "channels": rows[0][3] if rows else None,
        "version": VERSIONS[rows[0][4]] if rows else None, "layer": rows[0][5] if rows else None,
        "duration_s": float(sum(r[1] / r[2] for r in rows)) if len({r[2] for r in rows}) > 1 else samples / rate if rows else 0.0,
        "mean_kbps": sum(r[6] for r in rows) / len(rows) if rows else None,
        "min_kbps": min((r[6] for r in rows), default=None), "max_kbps": max((r[6] for r in rows), default=None),
        "vbr": kind, "vbr_frames": vbr_frames, "crc_ok": crc_ok, "crc_bad": crc_bad, "crc_absent": crc_absent,
        "tag_crc_ok": tag_ok, "music_crc_ok": music_ok, "resyncs": resyncs, "skipped_bytes": skipped, "tags": tags, "toc": toc, "frame_offsets": offsets,
    }
    payload = None
    if (size := tags.get("payload_bytes", "")).isdigit():
        payload = b"".join(data[o + 6 + r[8] : o + r[0]] for o, r in zip(offsets, rows, strict=True) if r[7] and r[5] == 3)[: int(size)]
    return fields, payload


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % PAD_TO or (0 if raw else PAD_TO))


def write_audio(text: Column) -> Column:
    """Binary column: the text's UTF-8 bytes, zeros up to a positive multiple of 64, as an MPEG audio stream."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((write_stream(padded(t or b"")) for t in texts.cast(pa.binary()).to_pylist()), pa.binary())

    return run(text.cast("string"))


def read_audio(media: Column) -> Column:
    """Struct column: the payload's digests and the fields of read_stream, from the stored bytes."""
    kinds = STORED | FIELDS

    @F.arrow_udf(f"struct<{','.join(f'{k}:{v}' for k, v in kinds.items())}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for stored in batches:
            columns: dict[str, list] = {name: [] for name in kinds}
            for data in stored.to_pylist():
                fields, payload = read_stream(data or b"")
                fields["tags"] = list(fields["tags"].items())
                fields |= {"payload_bytes": None, "payload_sha256": None, "tail_crc32": None} if payload is None else {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-PAD_TO:])}
                fields |= {"media_bytes": len(data or b""), "media_sha256": hashlib.sha256(data or b"").hexdigest()}
                for name, values in columns.items():
                    values.append(fields[name])
            yield pa.StructArray.from_arrays([pa.array(v, ARROW[kinds[k]]) for k, v in columns.items()], names=list(columns))

    return run(media)


def audio_features(docs: DataFrame, media: str = "media") -> DataFrame:
    """docs with column `audio`: what read_audio finds in the binary column `media`."""
    return set_aside(docs, "audio").withColumn("audio", read_audio(F.col(media)))


def seek_offset(audio: Column, seconds: Column) -> Column:
    """Byte offset of the frame that sounds at a time, from the column `audio` (streams of one rate): null before
    the start, from the end on, and where there is no frame."""
    frame = F.floor(seconds * audio["sample_rate"] / (audio["n_samples"] / audio["n_frames"]))
    return F.when((frame >= 0) & (frame < audio["n_frames"]), F.get(audio["frame_offsets"], frame.cast("int")))
