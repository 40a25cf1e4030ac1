"""A corpus pipeline: each stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.common import written
from voxtally.llm.exact import keep_one_of_equal
from voxtally.llm.packing import pack_documents
from voxtally.llm.resampling import keep_resampled
from voxtally.llm.secrets import fit_network, redact_secrets
from voxtally.llm.simhash import keep_one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards those labelled as good."""
    return keep_resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id; of rows that were delivered twice, one."""
    return keep_one_of_equal(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints of 3-word shingles link at 3 bits or fewer, that with the smallest id."""
    return keep_one_of_each(docs, size=3).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and the length counted again."""
    out = redact_secrets(docs, fit_network(docs))
    if "n_chars" not in docs.columns:
        return out
    changed = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]

# Trained models, fingerprints and a tokenizer are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
