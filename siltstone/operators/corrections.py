"""Moderators' corrections as batches: merges, splits and confirmations, what has to be classified again, and the deferred backlog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import graph

ACTIONS = ("merge", "split", "confirm")


def checked(corrections: DataFrame) -> DataFrame:
    """The corrections; an unknown action is an error."""
    known = F.col("action").isin(*ACTIONS)
    return corrections.withColumn("action", F.when(F.coalesce(known, F.lit(False)), F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown action "), F.coalesce("action", F.lit("null"))))))


@dataclass
class Corrected:
    """Tables after a batch of corrections."""

    nodes: DataFrame
    edges: DataFrame
    requeued: DataFrame
    backlog: DataFrame
    affected: DataFrame


def moved(before: DataFrame, after: DataFrame, pairs: DataFrame) -> DataFrame:
    """(old, new, moved): the distance between the old entity's former embedding and the new one's present embedding, null if either is missing. Tables: (id, embedding)."""
    d = F.sqrt(F.aggregate(F.zip_with("b", "a", lambda x, y: (y.cast("double") - x) * (y.cast("double") - x)), F.lit(0.0), lambda s, v: s + v))
    out = pairs.join(before.select(F.col("id").alias("old"), F.col("embedding").alias("b")), "old", "left").join(after.select(F.col("id").alias("new"), F.col("embedding").alias("a")), "new", "left")
    return out.select("old", "new", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), d).alias("moved"))


def apply(corrections: DataFrame, reassigned: DataFrame, nodes: DataFrame, edges: DataFrame, before: DataFrame, after: DataFrame, records: DataFrame, seen: DataFrame, backlog: DataFrame) -> Corrected:
    """A batch of corrections (correction_id, action, source, target, deferred_id) on entities that no other correction of the batch names.

    A merge moves ``source`` into ``target``; a split makes node ``target`` and moves the contents of ``reassigned`` (correction_id, content)
    from ``source`` to it. Contents are classified again if their record leans on the graph and the embedding they see moved, once ever:
    ``seen`` (content_id) are left out. backlog: (item_id, ...) without the confirmed, merged or split items.
    """
    c = checked(corrections)
    merges = c.where("action = 'merge'").select("source", "target")
    splits = c.where("action = 'split'").select("correction_id", F.col("source").alias("old"), F.col("target").alias("new"))
    moves = reassigned.join(splits, "correction_id").select("content", "old", "new")
    said = edges.where("type = 'mentions'")
    fell = moves.join(said.select(F.col("src").alias("content"), F.col("dst").alias("old")).distinct(), ["content", "old"])

    new_edges = graph.split_edges(graph.merge_edges(edges, merges), moves)
    gone = merges.where("source <> target").select(F.col("source").alias("id"))
    new_nodes = nodes.join(gone, "id", "left_anti").unionByName(splits.select(F.col("new").alias("id"), F.lit("entity").alias("kind")))

    # who saw which entity, and which one they see now
    merged = said.join(merges.select(F.col("source").alias("dst"), F.col("target").alias("new")), "dst").select(F.col("src").alias("content_id"), F.col("dst").alias("old"), "new")
    stayed = said.join(merges.select(F.col("target").alias("dst")), "dst").select(F.col("src").alias("content_id"), F.col("dst").alias("old"), F.col("dst").alias("new"))
    left = said.join(splits.select(F.col("old").alias("dst")), "dst").select(F.col("src").alias("content_id"), F.col("dst").alias("old"))
    left = left.join(moves.select(F.col("content").alias("content_id"), "old"), ["content_id", "old"], "left_anti").withColumn("new", F.col("old"))
    views = merged.unionByName(stayed).unionByName(left).unionByName(moves.select(F.col("content").alias("content_id"), "old", "new")).distinct()
    shifts = moved(before, after, views.select("old", "new").distinct())
    shifted = views.join(shifts, ["old", "new"]).select("content_id", F.col("old").alias("entity"), "moved")
    requeued = graph.requeue(shifted, records).join(seen.select("content_id").distinct(), "content_id", "left_anti")

    touched = graph.affected(edges, merges).select(F.col("target").alias("entity"), "id")
    touched = touched.unionByName(fell.select(F.col("new").alias("entity"), F.col("content").alias("id"))).unionByName(splits.select(F.col("new").alias("entity"), F.explode(F.array("old", "new")).alias("id"))).distinct()
    done = c.where("deferred_id is not null").select(F.col("deferred_id").alias("item_id")).distinct()
    return Corrected(new_nodes, new_edges, requeued, backlog.join(done, "item_id", "left_anti"), touched)


def defer(items: DataFrame, now: Column) -> DataFrame:
    """Stale items as backlog rows."""
    return items.select(F.col("id").alias("item_id"), "mention", "candidates", now.alias("auto_resolved_at"))
