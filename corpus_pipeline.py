"""A corpus pipeline: quality rules, near duplicates, personal data, mixing, then token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from overlapse.llm import mixing, ngram_join, pii, quality
from overlapse.llm.common import tidied, written
from overlapse.llm.queries import piece_digest


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that are common in their host."""
    return quality.cleaned(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.first_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to equal source weights, in random order."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, counted and summed up, after a round trip."""
    return piece_digest(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: Near-duplicate classes and piece encoding have no SQL form; tests/llm checks run() against a brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; what earlier stages wrote is then removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with tidied(spark, keep=1):
        for i, (_, stage) in enumerate(STAGES[:-1]):
            with tidied(spark, keep=1):
                docs = written(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
