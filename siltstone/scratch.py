"""Tables written to the folder that the driver and all executors share, to cut lineage between stages.

A written table outlives the executors that made it, so a later stage never recomputes an earlier one and the
loss of an executor costs only the tasks it ran.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one is made and set if master and executors are one machine, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        found = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", found)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def ready_workers(spark: SparkSession) -> None:
    """Lets Python workers started from another working directory import this package."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, paths)])


class Scratch:
    """Written tables of one operator call. ``save`` writes and rereads, ``drop`` removes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n, self.saved = 0, []
        ready_workers(spark)

    def save(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.option("compression", codec).mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.saved.append(out)
        return out

    def drop_all_but(self, *tables: DataFrame) -> None:
        kept = {t._scratch_path for t in tables}
        self.drop(*[t for t in self.saved if t._scratch_path not in kept])
        self.saved = list(tables)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
