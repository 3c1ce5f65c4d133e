"""A corpus pipeline over documents: each stage calls one operator of quadloom.llm, is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import language_id, ngram_join, packing, secret_scan, substring_dedup
from quadloom.llm import text as X

#: No SQL expresses a fitted model; tests hold run() against brute-force versions.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is not told, go."""
    return language_id.accepted(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least doc_id (rows without one, or that share one, are told by row keys)."""
    return ngram_join.representatives(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that repeat are removed; documents of which nothing is left go."""
    return _counted(substring_dedup.cleaned(docs))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return _counted(secret_scan.redacted(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and place."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_stage),
    ("ngram_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after the other over documents."""
    docs = X.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = X.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
