"""Micro-batches and black-box scoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import vectors as V


def micro_batches(requests: DataFrame, size: int = 32, wait_ms: int = 50) -> DataFrame:
    """(worker, id, batch): up to ``size`` requests, or those within ``wait_ms`` of a batch's first, per worker in order of (ms, id)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ms", "id"])
        ms = pdf.ms.to_numpy()
        starts, at = [], 0
        while at < len(ms):  # a step per batch: its end is found by bisection
            starts.append(at)
            at = min(at + size, int(np.searchsorted(ms, ms[at] + wait_ms, side="right")))
        batch = np.searchsorted(starts, np.arange(len(ms)), side="right") - 1
        return pd.DataFrame({"worker": pdf.worker, "id": pdf.id, "batch": batch})

    return requests.groupBy("worker").applyInPandas(fold, "worker long, id long, batch int")


def predict(rows: DataFrame, scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], features: str, dim: int, names: list[str], batch: int = 1024) -> DataFrame:
    """Adds probabilities, predicted class and its name. ``scorer`` makes a function from features (arrays of ``dim`` numbers) to logits in each worker."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    udf = predict_batch_udf(scorer, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[dim]])
    out = rows.withColumn("logits", udf(F.col(features)))
    out = out.withColumn("probs", V.softmax(F.col("logits"))).drop("logits")
    return out.withColumn("class_index", V.argmax(F.col("probs"))).withColumn("class_name", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("class_index") + 1)).withColumn("probabilities", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.col("probs")))


def batch_stats(requests: DataFrame) -> DataFrame:
    """One row over requests (worker, batch, latency_ms): their number, that of batches, the averages, and requests per second of ``ms``."""
    size = F.countDistinct("worker", "batch")
    span = (F.max("ms") - F.min("ms")) / 1000.0
    avg = lambda a, b: F.when(b > 0, F.try_divide(a, b)).otherwise(0.0)
    return requests.agg(F.count(F.lit(1)).alias("total_requests"), size.alias("total_batches"), avg(F.count(F.lit(1)).cast("double"), size).alias("avg_batch_size"), avg(F.sum("latency_ms"), F.count(F.lit(1))).alias("avg_latency_ms"), avg(F.count(F.lit(1)).cast("double"), span).alias("throughput"))


def index_stats(main: DataFrame, wal: DataFrame, dim: int) -> DataFrame:
    """Vectors in the index and its write-ahead segment, and their bytes as 32-bit floats."""
    n = main.agg(F.count(F.lit(1)).alias("m")).join(wal.agg(F.count(F.lit(1)).alias("wal_size")))
    total = F.col("m") + F.col("wal_size")
    return n.select(total.alias("total_vectors"), "wal_size", (total * dim * 4).alias("memory_bytes"))


def lru_hits(queries: DataFrame, capacity: int = 10_000) -> DataFrame:
    """(cache, seq, hit) of a least-recently-used cache per ``cache`` over (cache, seq, key), in order of seq. A worker holds ``capacity`` keys."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[object, None] = {}
        hits = []
        pdf = pdf.sort_values("seq")
        for key in pdf.key.tolist():
            hit = key in held
            held.pop(key, None)
            held[key] = None
            if len(held) > capacity:
                del held[next(iter(held))]
            hits.append(hit)
        return pd.DataFrame({"cache": pdf.cache, "seq": pdf.seq, "hit": hits})

    return queries.select("cache", "seq", "key").groupBy("cache").applyInPandas(fold, "cache long, seq long, hit boolean")


def cache_hits(queries: DataFrame, bucket: Column) -> DataFrame:
    """Hit rate of a result cache keyed by (bucket, k), unbounded: all but the first of each key are hits."""
    g = queries.groupBy(bucket.alias("bucket"), "k").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.when(F.sum("n") > 0, F.try_divide(F.sum(F.col("n") - 1).cast("double"), F.sum("n"))).otherwise(0.0).alias("hit_rate"), F.sum("n").alias("n"))
