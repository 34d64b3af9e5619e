"""Language ID, near-dedup, secret scans, source mixing and packing, one after another, over the documents table.

Each stage works on all rows that the one before it kept. run() writes every stage but the last as Parquet in the shared folder and
reads it again as the next stage's documents. All stages but the last return the columns of documents; what each does
with nulls, empty and long texts, ties, repeated rows, empty tables and further columns is said in its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm import langid, mixing, neardup, packing, secrets
from rankforge.llm.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources are brought to their target weights."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with the training sequence that holds it."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None  # k-means, signatures and the knapsack program are beyond SQL; tests/llm holds run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
