"""Joins whose hot keys are never gathered in one task, whatever the session's adaptive settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot, so fewer keys than this are, and they may be broadcast.
PARTS = 1024


def join_by_count(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str, total: int) -> DataFrame:
    """Inner join on ``keys``, which are unique in ``right`` and not null; ``count`` is how many of the ``total`` rows of ``left`` each has.

    Rows of hot keys meet a broadcast of fewer than ``PARTS`` rows; the others are shuffled, at most ``total / PARTS`` to a key.
    Both tables are read twice.
    """
    hot = right.where(F.col(count) > total / PARTS)
    rest = right.where(F.col(count) <= total / PARTS)
    near = left.join(F.broadcast(hot), list(keys))
    return near.unionByName(left.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(rest, list(keys)))
