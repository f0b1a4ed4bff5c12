"""Corpus pipeline: language, near copies, benchmark leaks, source mix, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ebbtide.llm import decontaminate, language, mixing, shingles, tokens
from ebbtide.llm.common import table
from ebbtide.session import shared_folder

#: No SQL: language prototypes, near-duplicate groups and token ids are not expressible; tests hold brute-force versions against it.
ORACLE_SQL = None


#: Rows that are handed to Python at a time: texts may be long, and what a batch takes is held by Spark and by the worker.
BATCH_ROWS = "1000"


def _lean(spark: SparkSession) -> None:
    """Small batches for the Python steps of all stages, so that executors have room for every stage."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; those without letters or unlike all languages go."""
    _lean(spark)
    return language.recognised(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, candidates by SimHash fingerprints and min-hash bands, a Jaccard similarity of 0.8 or more."""
    _lean(spark)
    return shingles.deduplicated(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    _lean(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _lean(spark)
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the binary format, read back: one row per document with its place, length and checksum."""
    _lean(spark)
    return tokens.stored_tokens(docs, keep=100_000, chars=1 << 20)  # executors are full of earlier stages by now


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("mix", mix_sources),
    ("token_ids", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again for the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
