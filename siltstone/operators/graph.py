"""Property graph as tables: nodes (id, kind), edges (src, dst, type) with set semantics. Each change is a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def neighbors(edges: DataFrame, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """(id, dst) of outgoing edges of ``nodes`` (id)."""
    e = edges if kind is None else edges.where(F.col("type") == kind)
    return nodes.select("id").join(e, F.col("id") == F.col("src")).select("id", "dst").distinct()


def mentioning(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(content, entity) of contents that mention any of ``entities`` (id)."""
    return edges.where("type = 'mentions'").join(entities.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("content"), F.col("dst").alias("entity")).distinct()


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, id): duplicate node ids and endpoints without a node."""
    twice = nodes.groupBy("id").count().where("count > 1").select(F.lit("duplicate id").alias("problem"), "id")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return twice.unionByName(ends.select(F.lit("unknown endpoint").alias("problem"), "id"))


def merge_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges after merging source into target: redirected, without loops inside a merged pair. merges: (source, target), disjoint."""
    def moved(end: str) -> DataFrame:
        return merges.where("source <> target").select(F.col("source").alias(f"_{end}"), F.col("target").alias(f"_{end}_to"))

    e = edges.join(moved("src"), F.col("src") == F.col("_src"), "left").join(moved("dst"), F.col("dst") == F.col("_dst"), "left")
    e = e.withColumn("touched", F.col("_src").isNotNull() | F.col("_dst").isNotNull())
    e = e.select(F.coalesce("_src_to", "src").alias("src"), F.coalesce("_dst_to", "dst").alias("dst"), "type", "touched")
    return e.where("not (touched and src = dst)").select("src", "dst", "type").distinct()


def merge_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Entities (id, canonical_name, aliases) after merges: the target takes over the source's names in order, without its own or repeats."""
    s = entities.join(merges.where("source <> target"), F.col("id") == F.col("source")).groupBy("target").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat(F.array("canonical_name"), "aliases").alias("n")))), lambda x: x["n"])).alias("extra"))
    t = entities.join(merges.where("source <> target").select(F.col("source").alias("id")), "id", "left_anti").join(s, F.col("id") == F.col("target"), "left")
    names = F.array_distinct(F.concat("aliases", F.coalesce("extra", F.array().cast("array<string>"))))
    return t.select("id", "canonical_name", F.filter(names, lambda x: (x != "") & (x != F.col("canonical_name"))).alias("aliases"))


def affected(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """(target, id): the target and the neighbours whose edges were rewired."""
    m = merges.where("source <> target")
    out = edges.join(m, F.col("src") == F.col("source")).select("target", F.col("dst").alias("id"), "source")
    into = edges.join(m, F.col("dst") == F.col("source")).select("target", F.col("src").alias("id"), "source")
    rewired = out.unionByName(into).where("id <> source and id <> target").select("target", "id")
    return rewired.unionByName(merges.select("target", F.col("target").alias("id"))).distinct()


def split_edges(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Mention edges of the listed contents go over to the new entity. moves: (content, old, new)."""
    m = moves.select(F.col("content").alias("_c"), F.col("old").alias("_o"), "new").distinct()
    e = edges.join(m, (F.col("src") == F.col("_c")) & (F.col("dst") == F.col("_o")) & (F.col("type") == "mentions"), "left")
    return e.select("src", F.coalesce("new", "dst").alias("dst"), "type").distinct()


def requeue(affected_contents: DataFrame, records: DataFrame, shift: float = 0.1, contribution: float = 0.2) -> DataFrame:
    """Contents to classify again: mentioned the entity, leaned on the graph, and the embedding moved (or is unknown), once each.

    affected_contents: (content_id, entity, moved: double or null); records: (content_id, mentioned, graph_contribution).
    """
    j = affected_contents.join(records, "content_id").where((F.col("graph_contribution") > contribution) & F.array_contains("mentioned", F.col("entity")))
    return j.where(F.col("moved").isNull() | (F.col("moved") >= shift)).select("content_id").distinct()


def snapshot_edges(edges: DataFrame) -> DataFrame:
    """Edges once each, sorted by source, target and type."""
    return edges.select("src", "dst", "type").distinct().orderBy("src", "dst", "type")


def populate(items: DataFrame, mentions: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of new contents, and pending mentions with all entities resolved in their document.

    items: (content_id, source_id); mentions: (content_id, text, entity_id or null); known: (content_id) that are skipped.
    """
    new = items.join(known.select("content_id").distinct(), "content_id", "left_anti").dropDuplicates(["content_id"])
    own = mentions.join(new.select("content_id"), "content_id", "left_semi")
    posted = new.select(F.col("content_id").alias("src"), F.col("source_id").alias("dst"), F.lit("posted_by").alias("type"))
    said = own.where("entity_id is not null").select(F.col("content_id").alias("src"), F.col("entity_id").alias("dst"), F.lit("mentions").alias("type")).distinct()
    cooc = own.groupBy("content_id").agg(F.array_sort(F.collect_set("entity_id")).alias("cooc"))
    return posted.unionByName(said), own.where("entity_id is null").join(cooc, "content_id").select("content_id", "text", "cooc")
