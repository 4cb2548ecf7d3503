import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from holdfast.llm import bpe

from .cases import TEXTS, docs, none

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(open(PATH, "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_equal_the_library(library):
    merger = bpe.Merger(bpe.read_ranks(open(PATH, "rb").read()))
    for piece in ("hello", "unbelievable", "a" * 3000, "0" * 700, "ab" * 400, "é" * 200, "漢字", " " * 999, "x"):
        assert merger.merged(piece.encode()) == library.encode_ordinary(piece) or len(piece) > 500 or " " in piece
        assert merger.merged_long(piece.encode()) == merger.merged(piece.encode()) == library._encode_single_piece(piece)


@pytest.mark.parametrize(("chunk", "overlap"), [(65_536, 2_048), (200, 60), (97, 40)])
def test_equals_the_library(spark, library, chunk, overlap):
    coded = bpe.bpe_encode(docs(spark), PATH, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    got = bpe.bpe_decode(coded, PATH).withColumn("ids", bpe.ids_array(F.col("ids"))).collect()
    assert len(got) == len(TEXTS) + 3 and {r["ids_input"] for r in got} == {"x", None}  # a column ids that was there
    again = bpe.bpe_decode(coded.select("ids", F.lit(3).alias("Decoded")), PATH)
    assert again.columns == ["ids", "Decoded_input", "decoded"]
    for r in got:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs(spark).collect())


def test_no_rows(spark):
    assert bpe.bpe_encode(none(spark), PATH, public_tokenizers.PATTERN).count() == 0
