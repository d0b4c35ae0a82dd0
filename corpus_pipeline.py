"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the driver or
:func:`run` writes it as Parquet and reads it again as the next stage's ``docs``.
All stages but the last return the columns of ``documents`` and only drop rows;
the last adds each document's place in the mixed order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithoflow.llm import decontaminate as benchmarks
from lithoflow.llm import exact, mix, near, quality
from lithoflow.plans.tables import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of the stage's own input, held-out fold apart."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs.where(~quality.held_out()), labels.where(~quality.held_out()))
    return quality.good(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return exact.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the smallest id stays."""
    return near.near_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return benchmarks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, all columns, with its block, slot and place in the mixed order; a column with one of these names becomes ``input_`` and the name."""
    return mix.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("source mixing", mixing_stage),
]

#: Two stages (classifier, near dedup) have no SQL form; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
