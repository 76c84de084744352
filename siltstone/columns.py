"""Columns by their exact name or place, in tables that may hold others of names that differ in case only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(df: DataFrame, name: str) -> int:
    """The column of exactly this name, else the only one that differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    same = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(same) != 1:
        raise ValueError(f"no column {name!r}, or several: {df.columns}")
    return same[0]


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with columns named ``_0``, ``_1`` and so on."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Columns under new names: pick(df, id="doc_id")."""
    return numbered(df).select(*[F.col(f"_{place(df, c)}").alias(k) for k, c in names.items()])


def whole(x: Column) -> Column:
    """As long; null where it isn't a whole number."""
    return x.try_cast("long")
