import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.llm import audio

from .cases import docs, none


def crc_slow(data):
    crc = 0
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ 0xA001 if crc & 1 else crc >> 1
    return crc


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(payload):
    media = audio.write_stream(payload)
    fields, back = audio.read_stream(media)
    assert back == payload and fields["crc_bad"] == 0 and fields["crc_ok"] == fields["n_frames"] == fields["vbr_frames"]
    if payload:
        assert fields["tag_crc_ok"] and fields["music_crc_ok"] and fields["skipped_bytes"] == 0
        assert fields["n_samples"] == 1152 * fields["n_frames"]


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=200))
def test_music_crc(data):
    assert audio.music_crc(data) == crc_slow(data)


def test_damage_is_found_and_skipped():
    media = bytearray(audio.write_stream(b"q" * 6000))
    whole, _ = audio.read_stream(bytes(media))
    offset = whole["frame_offsets"][1]
    flipped = bytearray(media)
    flipped[offset + 10] ^= 1  # side information
    fields, _ = audio.read_stream(bytes(flipped))
    assert fields["crc_bad"] == 1 and not fields["music_crc_ok"]
    lost = media[: offset + 1] + b"junk \xff\xfb junk" + media[offset + 1 :]
    fields, _ = audio.read_stream(bytes(lost))
    assert fields["resyncs"] == 1 and fields["n_frames"] == whole["n_frames"] - 1 and fields["skipped_bytes"] > 0
    assert audio.read_stream(b"no audio")[0]["n_frames"] == 0


def test_id3v1_and_plain_layer2():
    h = bytes((0xFF, 0xFD, 0x84, 0x00))  # MPEG-1 layer II, 128 kbit/s... 160 at index 8; 48 kHz
    n = audio.header(h)[0]
    data = (h + bytes(n - 4)) * 3 + b"TAG" + b"Song".ljust(30, b"\0") + bytes(95)
    fields, payload = audio.read_stream(data)
    assert fields["n_frames"] == 3 and fields["layer"] == 2 and fields["tags"]["title"] == "Song" and payload is None
    assert fields["duration_s"] == 3 * 1152 / fields["sample_rate"] and fields["frame_offsets"] == [0, n, 2 * n]


def test_column(spark):
    for df in (docs(spark), none(spark)):
        got = audio.audio_features(df.withColumn("media", audio.write_audio(F.col("text")))).select("text", "audio.*").collect()
        assert len(got) == df.count()
        for r in got:
            raw = audio.padded((r["text"] or "").encode())
            assert r["payload_bytes"] == len(raw) > 0 and len(raw) % 64 == 0
            assert r["payload_sha256"] == hashlib.sha256(raw).hexdigest() and r["tail_crc32"] == zlib.crc32(raw[-64:])


def test_seek_and_clashing_column(spark):
    df = docs(spark).withColumn("media", audio.write_audio(F.col("text")))
    out = audio.audio_features(df)
    assert {"audio_input", "audio"} <= set(out.columns) and {r["audio_input"] for r in out.collect()} == {"y", None}
    rows = out.select("audio.*", *[audio.seek_offset(F.col("audio"), F.lit(s)).alias(f"s{i}") for i, s in enumerate((0.0, 0.05, -1.0, 1e6))]).collect()
    for r in rows:
        at = int(0.05 * 32000 // 1152)
        assert r["s0"] == r["frame_offsets"][0] and r["s1"] == (r["frame_offsets"][at] if at < r["n_frames"] else None) and r["s2"] is None and r["s3"] is None
