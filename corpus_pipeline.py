"""From raw documents to packed training sequences: STAGES in order, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import mixing, neardup, packing, pii, rules
from siltstone.llm.pipeline import run_stages


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the rules reject go."""
    return rules.quality_filter(docs, rules.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each class of near copies, the document with the smallest id stays."""
    return neardup.keep_one_of_each(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: personal data are replaced; n_chars follows the text."""
    return pii.pseudonymize(docs, pii.key_of(spark)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every document stays, those of rare sources are repeated up to twice."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: pieces of the documents, with their token ids and their places in sequences."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("PII", pseudonyms),
    ("mixing", mix_sources),
    ("best-fit packing", best_fit_packing),
]
#: Hashing, sampling and tokenising can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stages(STAGES, spark, sf_dir)
