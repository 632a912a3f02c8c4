"""The corpus pipeline: quality rules, near-duplicates, secrets, packing; each stage is written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import packing, repetition, secrets, simhash
from quillon.llm.common import Shelf
from quillon.llm.queries import piece_counter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return repetition.filter_docs(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 and more over five-word shingles stays."""
    return simhash.keep_one_similar(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, but not clear examples (more than two owners), are cut out of the texts; all documents stay, and n_chars follows the text."""
    before = docs.columns
    clean = secrets.redact(docs, max_owners=2, max_repos=None)
    if "n_chars" in before:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return clean.select(*[F.col(f"`{c}`") for c in before])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, in tokens, with their training row."""
    return packing.pack_docs(docs, piece_counter())


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("secret_scan", secret_scan), ("best_fit_packing", pack)]
#: Fingerprints and packing are not expressible in SQL; a test runs the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    shelf = Shelf(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = shelf.put(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k > 0:
            shelf.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
