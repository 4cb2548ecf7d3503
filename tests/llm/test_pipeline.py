import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from holdfast.llm import bpe, simhash

from .cases import docs as odd_docs
from .cases import none

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF))
        assert docs.columns == first.columns, name
        sizes.append(docs.count())
        if name == "near_duplicates":
            prints = [simhash.simhash64((r["text"] or "").encode()) for r in docs.collect()]
            assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in docs.collect()}
            good, bad = [k for k, q in labels.items() if q == 1], [k for k, q in labels.items() if q == 0]
            assert sum(k in kept for k in good) >= 0.97 * len(good) and sum(k in kept for k in bad) <= 0.2 * len(bad)
    assert sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2] and sizes[4] > 0.8 * sizes[3]
    assert docs.where("text rlike '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}'").count() == 0
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == set(text) and len(out) == len(text)
    for r in out:
        ids = library.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_odd_rows_an_empty_table_and_other_columns(spark, tmp_path):
    sf = str(tmp_path)
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    odd_docs(spark).write.parquet(f"{sf}/documents.parquet")
    for first in (odd_docs(spark), none(spark)):
        docs = first
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialise(stage(spark, docs, sf))
            assert docs.columns == first.columns and docs.count() <= first.count(), name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert out.count() == docs.count()
    out = corpus_pipeline.run(spark, sf).collect()
    assert len({r["doc_id"] for r in out if r["doc_id"] is not None}) == len([r for r in out if r["doc_id"] is not None])
