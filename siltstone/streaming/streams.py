"""Ordered and incremental behaviour as Structured Streaming queries, and a runner that drains a source."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from siltstone.operators import credibility
from siltstone.scratch import ready_workers, shared_dir


def every(stream: DataFrame, minutes: int, keep, checkpoint: str, mode: str = "append"):
    """Starts a query that gives a batch to ``keep`` every so many minutes, as an offline refresh does."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=f"{minutes} minutes").foreachBatch(keep).start()


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs over all that is available, with a checkpoint in the shared folder; the result of the last batches as a table."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={n:06d}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{root}/out")
    if mode == "complete":
        rows = rows.where(F.col("batch") == F.lit(rows.agg(F.max("batch")).first()[0]))
    return rows.drop("batch")


def events(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def history(items: DataFrame) -> DataFrame:
    """Accumulating label counts per domain (complete mode)."""
    return credibility.history(items)


def first_seen(items: DataFrame, keys: list[str], delay: str = "60 days") -> DataFrame:
    """The first row of each key, forgotten after ``delay`` of event time."""
    return items.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def windows(items: DataFrame, key: str, size: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    return items.withWatermark("ts", delay).groupBy(F.window("ts", size, slide), key).agg(F.count(F.lit(1)).alias("n"))


class RollingBuffer:
    """The newest ``most`` rows (seq, ...) of a stream, written to ``root`` per batch; pass ``keep`` to foreachBatch.

    A restarted stream finds the buffer of the batch before, and a batch that runs again writes the same buffer. Older ones go.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = 10_000):
        self.spark, self.root, self.most = spark, root, most

    def _path(self, n: int):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch={n}")

    def _exists(self, n: int) -> bool:
        path = self._path(n)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def keep(self, batch: DataFrame, n: int) -> None:
        rows = batch.unionByName(self.spark.read.schema(batch.schema).parquet(f"{self.root}/batch={n - 1}")) if n and self._exists(n - 1) else batch
        rows.orderBy(F.desc("seq")).limit(self.most).write.mode("overwrite").parquet(f"{self.root}/batch={n}")
        if n > 1 and self._exists(n - 2):
            path = self._path(n - 2)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def rows(self, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/batch={n}")


def timers(items: DataFrame, minutes: int = 30) -> DataFrame:
    """Items (id, created_at, done: boolean) without a done event within ``minutes`` of event time are given back as deferred."""
    ready_workers(items.sparkSession)

    def work(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (due, done) = state.get
            state.remove()
            if not done:
                yield pd.DataFrame({"id": [key[0]], "due": [pd.Timestamp(due, unit="ms")]})
            return
        due, done = state.get if state.exists else (None, False)
        for pdf in batches:
            start = int(pdf.created_at.min().timestamp() * 1000) + minutes * 60_000
            due = start if due is None else min(due, start)
            done = done or bool(pdf.done.any())
        state.update((due, done))
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    keyed = items.withWatermark("created_at", "0 seconds").groupBy("id")
    return keyed.applyInPandasWithState(work, "id long, due timestamp", "due long, done boolean", "append", "EventTimeTimeout")
