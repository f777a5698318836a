"""A training corpus from ``documents``: quality rules, near-dedup, secret scans, mixing to target weights, packing.

Each stage is a function of (spark, docs, sf_dir), ``docs`` being all that the stage before it kept; all but the last return
the columns of ``documents``. ``run`` writes every stage's result to the shared folder and reads it again. The stages bound the session's batches to Python
(``small_batches``): they follow one another on the same executors, whose memory the largest batches of all of them decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import mixing, packing, quality, secret_scan, simhash
from quire.session import shared_folder, ship, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counted rules and the classifier keep."""
    return quality.keep_good(docs, small_batches(ship(spark)).read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies."""
    small_batches(ship(spark))
    return simhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced (and ``n_chars`` counted again)."""
    small_batches(ship(spark))
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    small_batches(ship(spark))
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and the sequences they lie in."""
    small_batches(ship(spark))
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", redact_secrets), ("source_mix", source_mix), ("packing", pack)]

#: The classifier, the fingerprints and the tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
