"""Gapless ranks and running sums inside groups of any size, without ever gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_salts(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def salted_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, salts: int | None = None) -> DataFrame:
    """Adds ``name``: a rank from 0, gapless inside each group of ``keys``.

    Each group is dealt over ``salts`` by a hash of ``order``; the counts of (keys, salt) become offsets by a running
    sum over at most ``salts`` rows per group, and the rows are numbered inside (keys, salt). The ranks depend on the
    values alone: rows equal in ``order`` are interchangeable. ``order`` should tell rows of a hot group apart.
    """
    salts = salts or default_salts(df)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on: Column = F.col("_salt") == F.col("_s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_row", F.row_number().over(inside)).join(offsets, on, "left")
    return ranked.withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("long")).drop("_salt", "_s", "_before", "_row", "_n", *[f"_k{i}" for i in range(len(keys))])


def running_sum(df: DataFrame, order: str, value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows of smaller ``order``, which is unique. No task sees all rows.

    Rows are dealt by quantiles of ``order`` (a list of ``parts`` numbers); the parts' sums, one row each, become offsets.
    """
    parts = parts or default_salts(df)
    cuts = df.select(F.col(order).cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.001) if parts > 1 else []
    edges = sorted(set(cuts))
    part = F.lit(0)
    if edges:
        part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(order).cast("double")))
    dealt = df.withColumn("_part", part.cast("int"))
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")
