"""Connected components over any number of links, as tables only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.scratch import Scratch

#: Links that one task finishes.
FEW = 2000


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b: long): root is the smallest node of its component.

    Each round hooks every node on its smallest neighbour, follows the hooks to their roots by pointer doubling, and
    contracts the links to roots; the links shrink until none is left, and the last ``FEW`` are finished by one task. A hot node costs one row per link.
    """
    names = None
    left = _ordered(edges)
    left = scratch.save(left)
    while n := left.count():
        few = n <= FEW
        hook = scratch.save(left.coalesce(1).mapInArrow(_finish, "node long, root long") if few else left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while not few:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            step = hook.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
            step = scratch.save(step)
            moved = not step.where("moved").isEmpty()
            scratch.drop(hook)
            hook = step
            if not moved:
                break
        hook = hook.select("node", "root")
        a = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        # every larger end has a hook, a smaller end may be a root
        if names is None:
            roots = left.select(F.col("a").alias("node")).distinct()
            names = roots.join(hook, "node", "left_anti").select("node", F.col("node").alias("root")).unionByName(hook)
        else:
            names = names.join(hook.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        names = scratch.save(names)
        if few:
            break
        left = scratch.save(_ordered(left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
    return names if names is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes but the roots, of at most ``FEW`` links in one task."""
    held = list(batches)
    a, b = (np.concatenate([np.zeros(0, np.int64), *[x.column(c).to_numpy() for x in held]]) for c in ("a", "b"))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, b, root[a])
        np.minimum.at(new, a, root[b])
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["node", "root"])


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
