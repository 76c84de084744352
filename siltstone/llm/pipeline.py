"""Runs stages one after another, each one's result written to the shared folder and reread as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.scratch import Scratch

Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]


def run_stages(stages: list[Stage], spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written stage outlives lost executors; the input of a stage is removed once its output is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in stages:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
