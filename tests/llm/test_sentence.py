import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from holdfast.llm import sentence

from .cases import TEXTS, docs, none

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    with open(PATH, "rb") as f:
        return sentence.Pieces(f.read())


def test_equals_the_library(spark, library):
    got = sentence.sp_decode(sentence.sp_encode(docs(spark), PATH), PATH).collect()
    assert len(got) == len(TEXTS) + 3 and {r["ids_input"] for r in got} == {"x", None}
    for r in got:
        want = library.encode(r["text"] or "", add_eos=True)
        assert r["ids"] == want and r["decoded"] == library.decode(want) == (r["text"] or "")


def test_random_texts_equal_the_library(pieces, library):
    draw = random.Random(5)
    alphabet = ["a", "b", "e", " ", "  ", "▁", "t", "h", "ing", "in", "the", "0", "12", "\n", "é", "ñ", "漢", "日本", "\x00", "<s>", "</s>", "<0x0A>", "\U0001f600", "ü", "!", "...", "//", " " * 37, "\r\n", "http"]
    for _ in range(5_000):
        text = "".join(draw.choices(alphabet, k=draw.randint(0, 30)))
        want = library.encode(text, add_eos=True)
        assert pieces.backwards(" " + text.replace("▁", " ")) + [pieces.end] == want or not text
        assert memoryview(pieces.encode(text)).cast("i").tolist() == want
        assert pieces.decode(want) == library.decode(want)


def test_any_ids_are_decoded_as_by_the_library(pieces, library):
    draw = random.Random(6)
    for _ in range(5_000):
        ids = [draw.choice((draw.randrange(32_000), draw.randrange(3, 259), draw.randrange(3), 259, 28705)) for _ in range(draw.randint(0, 12))]
        assert pieces.decode(ids) == library.decode(ids)


def test_every_prefix_ends_with_its_own_encodings_last_token(pieces, library):
    text = " unbelievable  straightforward 漢字 naïve"
    for end, token in enumerate(pieces.table(text)[1:], 1):
        want = library.encode(text[1:end], add_eos=False)[-1:] if end > 1 else [pieces.number[" "]]
        assert [token[0]] == want if token else want[0] in pieces.bytes.values()


def test_parts_are_dropped_from_the_cache_and_found_again(pieces, library, monkeypatch):
    monkeypatch.setattr(sentence, "CACHED", 3)
    for text in ("one two three four five", "two four one", "five six seven eight nine one"):
        assert memoryview(pieces.encode(text)).cast("i").tolist() == library.encode(text, add_eos=True)
        assert len(pieces) <= 3 and len(pieces.older) <= 3


def test_long_runs_take_linear_time(spark, library):
    text = "ab" * 100_000 + "漢" * 50_000
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sentence.sp_encode(rows, PATH).first()["ids"] == library.encode(text, add_eos=True)


def test_no_rows_and_null_ids(spark):
    assert sentence.sp_encode(none(spark), PATH).count() == 0
    rows = spark.createDataFrame([(None, 1), ([2], 2)], "ids array<int>, decoded int")
    got = sentence.sp_decode(rows, PATH).orderBy("decoded_input").collect()
    assert [r["decoded"] for r in got] == [None, ""]


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        sentence.Pieces(proto.SerializeToString())


def test_ids_are_digested_as_decimals(spark, tmp_path, library):
    import hashlib

    from holdfast.llm import queries

    docs(spark).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_sentence_pieces(spark, str(tmp_path)).join(docs(spark).select("doc_id", "text").distinct(), "doc_id").where(F.col("doc_id").isNotNull())
    for r in got.collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
