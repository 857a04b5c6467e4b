"""A corpus prepared in five stages, each an operator of flowmill.llm.

run(spark, sf_dir) applies STAGES to `documents`; each stage is written as Parquet to the folder the executors
share and read back as the next one's input. The last stage returns packed pieces, the others the columns of
documents. A quadratic discriminant, boosted trees and a genetic algorithm have no SQL form, so ORACLE_SQL is None
and tests/llm/test_pipeline.py compares every stage with a plain version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowmill.llm import mixing, near_dedup, packing, pii, quality
from flowmill.llm.common import cut


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind."""
    return pii.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 4096."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("pii", without_personal_data),
    ("mixing", mixed_sources),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
