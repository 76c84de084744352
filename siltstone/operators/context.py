"""Mentions in texts: extraction with a label map, exact and fuzzy lookup together, and a text's context from the entity graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import knn, resolve

# Entity types of named-entity labels.
TYPES = {
    "PERSON": "person", "ORG": "organization", "NORP": "organization", "GPE": "location", "LOC": "location", "FAC": "location",
    "PRODUCT": "product", "EVENT": "event", "WORK_OF_ART": "product",
}


def entity_type(label: Column) -> Column:
    """The type of a label, null for labels that are not kept."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), label)


def places(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, place, mention) of all runs of 1 to 3 tokens, by length, then place."""
    toks = texts.select(key, T.tokens(F.coalesce(text, F.lit(""))).alias("toks"))
    return toks.select(key, F.posexplode(T.ngrams(F.col("toks"))).alias("place", "mention"))


def dictionary(words: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """An extractor that finds the surfaces of ``words`` (surface, label), whatever their case."""
    known = words.select(T.clean_mention(F.col("surface")).alias("surface"), "label").where("surface <> ''").distinct()

    def extract(texts: DataFrame, key: str) -> DataFrame:
        return places(texts, key).withColumn("surface", F.lower("mention")).join(known, "surface").select(key, "place", F.col("mention").alias("text"), "label")

    return extract


def extract_entities(texts: DataFrame, extractor: Callable[[DataFrame, str], DataFrame], key: str = "id") -> DataFrame:
    """(key, place, text, label, entity_type) of what an extractor finds; labels without a type go. Blank texts have none.

    An extractor takes (texts, key) and gives (key, place, text, label), so a model may be plugged in as a pandas function.
    """
    found = extractor(texts.where(T.strip(F.coalesce("text", F.lit(""))) != ""), key)
    return found.withColumn("entity_type", entity_type(F.col("label"))).where("entity_type is not null")


def register_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """An alias table with further rows (alias, entity_id, seq); blanks go. The exact lookup takes the last of an alias, the fuzzy one the first of a pair."""
    return aliases.unionByName(new.select(T.clean_mention(F.col("alias")).alias("alias"), "entity_id", "seq").where("alias <> ''"))


def alias_stats(aliases: DataFrame) -> DataFrame:
    return aliases.agg(F.countDistinct("alias").alias("total_aliases"), F.countDistinct("entity_id").alias("total_entities"), F.countDistinct(F.substring("alias", 1, resolve.PREFIX)).alias("bucket_count"))


def normalize(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(mention_id, entity_id, score): exact lookup with score 1, else fuzzy lookup; null and 0 if neither finds it. mentions: (mention_id, mention)."""
    exact = resolve.exact_lookup(mentions.select("mention_id", "mention"), aliases)
    rest = exact.where("entity_id is null").select("mention_id", "mention")
    return exact.where("entity_id is not null").select("mention_id", "entity_id", F.lit(1.0).alias("score")).unionByName(resolve.fuzzy_lookup(rest, aliases))


def lookup(ids: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(key, place, id, embedding) of lists of ids (key, ids): each in its place, null where there is none. embeddings: (id, embedding)."""
    return ids.select("key", F.posexplode("ids").alias("place", "id")).join(embeddings.select("id", "embedding"), "id", "left").select("key", "place", "id", "embedding")


def graph_context(texts: DataFrame, aliases: DataFrame, embeddings: DataFrame, key: str = "id", dim: int | None = None) -> DataFrame:
    """(key, n_entities, confidence, pooled): each entity that a text mentions and that has an embedding counts once, by its first mention.

    The pool is weighted by how the mention was resolved; texts without any have confidence 0 and, if ``dim`` is given, zeros, else null.
    Distinct mentions are resolved once, however many texts hold them.
    """
    said = places(texts, key)
    distinct = said.select("mention").distinct().select(F.col("mention").alias("mention_id"), "mention")
    found = normalize(distinct, aliases).where("entity_id is not null")
    hits = said.join(found, F.col("mention") == F.col("mention_id")).join(embeddings.select(F.col("id").alias("entity_id"), "embedding"), "entity_id")
    first = Window.partitionBy(key, "entity_id").orderBy("place")
    hits = hits.withColumn("n", F.row_number().over(first)).where("n = 1")
    weight = F.when(F.col("score") >= 1, resolve.GRAPH_WEIGHT["exact"]).otherwise(resolve.GRAPH_WEIGHT["high"])
    pooled = knn.pool(hits, [key], weight=weight)
    sums = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_entities"), F.avg("score").alias("confidence"))
    zeros = F.array_repeat(F.lit(0.0), dim) if dim else F.lit(None).cast("array<double>")
    out = texts.select(key).join(sums, key, "left").join(pooled, key, "left")
    return out.select(key, F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("pooled", zeros).alias("pooled"))


def with_defaults(requests: DataFrame, answers: DataFrame, key: str, defaults: dict[str, Column], late: Column | None = None) -> DataFrame:
    """Requests with their answers' columns; defaults where there is no answer or it came too late (``late``: a condition on answers)."""
    in_time = answers if late is None else answers.where(~F.coalesce(late, F.lit(True)))
    own = in_time.select(key, F.struct(*defaults).alias("answer"))
    out = requests.join(own, key, "left")
    return out.select(*requests.columns, *[F.when(F.col("answer").isNull(), d).otherwise(F.col(f"answer.{c}")).alias(c) for c, d in defaults.items()], F.col("answer").isNull().alias("timed_out"))
