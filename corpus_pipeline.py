"""The corpus pipeline: five stages, each over all documents that the one before it kept.

1. quality: documents that the rule ensemble scores under its threshold go.
2. near_duplicates: of each SimHash component the document with the smallest id stays.
3. personal_data: spans of personal data are replaced by their kind in square brackets.
4. mixing: documents stay with the rates, at most 1, that bring expected domain token totals next to targets.
5. encoding: the texts' byte-level BPE ids (packed, little-endian unsigned 32-bit) and their digests.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents. Null and empty texts are scored,
compared, mixed and encoded as empty ones (they stay null until they are encoded). Of rows that share a doc_id, or have
none, each is judged by its own text; rows repeated in full are copies. An empty table gives an empty result. Columns that
documents has besides its own go through all stages but the last (names hf_* are the operators' own). ORACLE_SQL is None: the
stages fit models and follow links, which SQL can't express; tests hold them against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import bpe, mixing, pii, quality, simhash
from holdfast.llm.common import materialise, table

TARGETS = {"clean": 0.95, "toxic": 0.05}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return mixing.resample(docs, labels.select("doc_id", mixing.label_domain(F.col("quality"), F.col("toxic")).alias("domain")), TARGETS, cap=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_first_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_domains),
    ("encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
