"""Versioned tables: snapshots, embedding versions with a pointer, append-only logs, content-addressed files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_graph(nodes: DataFrame, edges: DataFrame, root: str, snapshot: str) -> None:
    nodes.write.mode("errorifexists").parquet(f"{root}/nodes/snapshot={snapshot}")
    edges.distinct().write.mode("errorifexists").parquet(f"{root}/edges/snapshot={snapshot}")


def load_graph(spark: SparkSession, root: str, snapshot: str) -> tuple[DataFrame, DataFrame]:
    from siltstone.operators.graph import problems

    nodes, edges = (spark.read.parquet(f"{root}/{t}/snapshot={snapshot}") for t in ("nodes", "edges"))
    bad = problems(nodes, edges).first()
    if bad:
        raise ValueError(f"{bad.problem}: {bad.id}")
    return nodes, edges


def save_version(embeddings: DataFrame, root: str, version: str, saved_at: Column) -> None:
    embeddings.withColumn("saved_at", saved_at).write.mode("errorifexists").parquet(f"{root}/version_id={version}")


def list_versions(spark: SparkSession, root: str, now: Column, days: int = 21) -> DataFrame:
    v = spark.read.parquet(root).groupBy(F.col("version_id").cast("string").alias("version_id")).agg(F.max("saved_at").alias("saved_at"), F.count(F.lit(1)).alias("n"))
    return v.where(F.col("saved_at") >= now - F.make_interval(days=F.lit(days))).orderBy("saved_at")


def publish_index(rows: DataFrame, root: str, version: str, pointer_seq: int) -> None:
    """A new version of an index is written whole; then one more row in its log points to it, so readers change over at once."""
    rows.write.mode("errorifexists").parquet(f"{root}/versions/{version}")
    rows.sparkSession.createDataFrame([("index", version, pointer_seq)], "name string, version string, seq long").coalesce(1).write.mode("append").json(f"{root}/pointer")


def open_index(spark: SparkSession, root: str, dim: int, embedding: str = "embedding") -> DataFrame:
    """The version that the newest pointer names; vectors of another length than ``dim`` are an error."""
    found = read_log(spark, f"{root}/pointer", "name string, version string, seq long", "name").first()
    if found is None:
        raise ValueError("no index was published")
    rows = spark.read.parquet(f"{root}/versions/{found.version}")
    if not rows.where(F.size(embedding) != dim).isEmpty():
        raise ValueError(f"vectors of version {found.version} don't have {dim} numbers")
    return rows


def merge_segment(main: DataFrame, wal: DataFrame, root: str, version: str, pointer_seq: int) -> None:
    """The write-ahead segment goes into a new version of the main index; the caller empties the segment once that is published."""
    publish_index(main.unionByName(wal), root, version, pointer_seq)


def save_report(rows: DataFrame, path: str) -> None:
    """An evaluation report as one JSON file's folder."""
    rows.coalesce(1).write.mode("overwrite").json(path)


# Tiers of synthetic rows, their folders and texts; the second tier tells an original text and is hard.
TIERS = (
    ("tier1_easy", "/mock/tier1/", "easy authentic example "),
    ("tier2_contradiction", "/mock/tier2/", "topically coherent contradiction "),
    ("tier3_hard_negatives", "/mock/tier3/", "hard negative "),
)


def manifests(spark: SparkSession, n: int = 100) -> DataFrame:
    """Synthetic training rows, ``n`` of each tier: (image_path, text, original_text, label, difficulty, tier)."""
    tiers = spark.createDataFrame([(*t, t[0] == TIERS[1][0]) for t in TIERS], "tier string, folder string, words string, hard boolean")
    i = F.col("id").cast("string")
    return spark.range(n).join(F.broadcast(tiers), F.lit(True)).select(
        F.concat("folder", i, F.lit(".jpg")).alias("image_path"), F.concat("words", i).alias("text"), F.when(F.col("hard"), F.concat(F.lit("original "), i)).alias("original_text"),
        F.when(F.col("hard"), 1).otherwise(F.col("id") % 2).cast("int").alias("label"), F.when(F.col("hard"), "hard").alias("difficulty"), "tier",
    )


def settings(defaults: dict, prefix: str, environment: dict[str, str], overrides: str = "{}") -> dict:
    """Defaults, then environment variables with the prefix, then a JSON object; values take the defaults' types, unknown names are errors."""
    own = {k[len(prefix) :].lower(): v for k, v in environment.items() if k.upper().startswith(prefix.upper())}
    out = dict(defaults)
    for k, v in [*((k, v) for k, v in own.items() if k in defaults), *json.loads(overrides).items()]:
        if k not in defaults:
            raise KeyError(k)
        kind = type(defaults[k])
        out[k] = v.strip().lower() in ("1", "true", "yes", "on") if kind is bool and isinstance(v, str) else v if defaults[k] is None else kind(v)
    return out


def append_log(rows: DataFrame, root: str) -> None:
    """A change of a registry is one more row; the newest per key counts."""
    rows.write.mode("append").json(root)


def read_log(spark: SparkSession, root: str, schema: str, key: str, seq: str = "seq") -> DataFrame:
    """The newest row of each key; a missing log is empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json(root)
    return rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*rows.columns), seq).alias("r")).select("r.*")


def store_files(files: DataFrame, root: str) -> None:
    """Content-addressed: files (content, ext) that aren't there yet, under their SHA-256."""
    rows = files.select(F.sha2("content", 256).alias("digest"), "ext", "content").dropDuplicates(["digest"])
    spark = files.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        rows = rows.join(spark.read.parquet(root).select("digest"), "digest", "left_anti")
    rows.write.mode("append").parquet(root)
