"""The training-text pipeline: quality, near copies, shared passages, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servemetry.llm import jaccard_join, packing, quality, secret_scan, substrings
from servemetry.sources.storage import fresh_path

VOCABULARY, WINDOW, END_ID = "byte_bpe_50k.json", 1024, 0


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars after texts were changed."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, as they are."""
    return quality.passing(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return jaccard_join.one_of_each_group(docs, words=5, num=80, den=100)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds; those left without words go."""
    return _recounted(substrings.without_repeats(docs))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return _recounted(secret_scan.without_secrets(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of WINDOW tokens."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), window=WINDOW, end_id=END_ID)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("substring_dedup", passage_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: Tokens, chunk digests and randomness tests have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
