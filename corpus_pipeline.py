"""A training-corpus pipeline: quality rules, near-duplicates, decontamination, personal data, source mix.

Each stage reads what its predecessor kept as Parquet. All stages but the last return the
columns of ``documents``; the last returns them once per copy that the mix reads, with
epoch, words and position, in training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import decontaminate, mixing, neardup, pii, quality
from clauseloom.session import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    ratios = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, ratios).where("quality_rules.kept").drop("quality_rules")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each personal span as <KIND>; n_chars follows the text."""
    model = pii.trained(pii.pattern_counts(docs))
    masked = docs.withColumn("text", pii.masked(F.col("text"), model))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents once per copy that the mix reads, in training order."""
    mix = mixing.curriculum(docs)
    return mix.select("doc.*", F.col("epoch").alias("mix_epoch"), F.col("words").alias("mix_words"), F.col("position").alias("mix_position"))


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("source_mix", source_mix),
]

#: The likelihood ratio, sketches and the span classifier are no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
