"""Corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of `documents`. `run` writes each stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spreadloom.llm import decontam, exactdedup, packing, quality, simhash
from spreadloom.llm.common import save


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a rule ensemble fitted on the labels does not reject; null and empty texts are scored like any other."""
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for the case of A-Z: the one with the largest doc_id."""
    return exactdedup.keep_one(spark, docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share four fifths of their shingles of five words, or whose SimHash
    fingerprints lie within two of 64 bits: the one with the smallest doc_id. Rows without a doc_id stay."""
    return simhash.keep_one(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item within eight edits in a hundred characters."""
    return decontam.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows and their places in sequences of 2048 tokens; a null text is the end id alone."""
    return packing.pack(docs, packing.word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Scores, fingerprints and token ids have no SQL form; tests/llm/test_pipeline.py runs the stages by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
