"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialstats.llm.decontaminate import drop_contaminated
from trialstats.llm.exact_dedup import drop_exact_copies
from trialstats.llm.mixing import sampled_documents
from trialstats.llm.quality import drop_poor
from trialstats.llm.simhash import drop_near_copies
from trialstats.session import stored_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sampled_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
]

# The classifier is fitted and XXH64 fingerprints are no SQL, so the rows are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored_table(stage(spark, docs, sf_dir))
    return docs
