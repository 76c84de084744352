"""Reading tables and registering queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """``t.orders`` reads the table orders of a folder; only the columns that a query uses are scanned."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def size(self, name: str) -> int:
        """Files of a table."""
        return len(getattr(self, name).inputFiles())

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable:
        def add(f: Callable[[Tables], DataFrame]) -> Callable:
            queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
