"""Entity resolution: alias tables, exact and fuzzy lookup, blocked scoring and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vectors as V

# Prefix length, candidates per prefix, and thresholds.
PREFIX, BUCKET, ACCEPT = 3, 50, 0.92
MERGE, REVIEW = 0.85, 0.65
#: Tasks that a hot prefix is dealt to.
SALTS = 16
#: Planes of the signature block, for embeddings of 64 numbers; others need planes of their own length.
SIGNATURES = V.gauss_planes(64)
GRAPH_WEIGHT = {"exact": 1.0, "high": 0.85, "provisional": 0.5, "unresolved": 0.0}


def alias_table(entities: DataFrame) -> DataFrame:
    """(alias, entity_id, seq) of entities (entity_id, canonical_name, aliases, seq): the canonical name first; blanks go."""
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    out = entities.select("entity_id", "seq", F.posexplode(names).alias("pos", "name"))
    return out.select(T.clean_mention(F.col("name")).alias("alias"), "entity_id", F.struct("seq", "pos").alias("seq")).where("alias <> ''")


def exact_lookup(mentions: DataFrame, aliases: DataFrame, stripped: bool = False) -> DataFrame:
    """Adds entity_id by the alias's last writer, null if there is none. mentions: (mention, ...); ``stripped`` ones have no white space at the ends."""
    clean = F.lower("mention") if stripped else T.clean_mention(F.col("mention"))
    last = aliases.groupBy(F.col("alias").alias("clean")).agg(F.max_by("entity_id", "seq").alias("entity_id"))
    return mentions.select(F.struct(*mentions.columns).alias("row"), clean.alias("clean")).join(last, "clean", "left").select("row.*", "entity_id")


def fuzzy_lookup(mentions: DataFrame, aliases: DataFrame, bucket: int = BUCKET, accept: float = ACCEPT) -> DataFrame:
    """(mention_id, entity_id, score): best alias among the first ``bucket`` with the mention's prefix, first wins ties."""
    first = aliases.groupBy("alias", "entity_id").agg(F.min("seq").alias("seq")).withColumn("prefix", F.substring("alias", 1, PREFIX))
    salted = first.withColumn("salt", F.pmod(F.xxhash64("alias", "entity_id"), F.lit(SALTS)))
    for keys in (["prefix", "salt"], ["prefix"]):  # a hot prefix is cut per salt first, so no task sorts all its aliases
        salted = salted.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where(F.col("n") <= bucket)
    # a row per prefix holds its aliases, so that a hot prefix of mentions can be dealt over tasks by the copies below
    lists = salted.groupBy("prefix").agg(F.collect_list(F.struct("alias", "entity_id", "n")).alias("found"))
    lists = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    clean = mentions.select("mention_id", T.clean_mention(F.col("mention")).alias("m")).withColumn("prefix", F.substring("m", 1, PREFIX)).withColumn("part", F.pmod(F.xxhash64("mention_id", "m"), F.lit(SALTS)).cast("int"))
    scored = clean.join(lists, ["prefix", "part"]).select("mention_id", "m", F.explode("found").alias("f")).select("mention_id", "m", "f.*").withColumn("score", T.similarity(F.col("m"), F.col("alias")))
    best = scored.groupBy("mention_id").agg(F.max_by(F.struct("entity_id", "score"), F.struct("score", -F.col("n"))).alias("best"))
    best = best.where(F.col("best.score") >= accept).select("mention_id", "best.*")
    return mentions.select("mention_id").join(best, "mention_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def candidates(mentions: DataFrame, entities: DataFrame, planes: list[list[float]] = SIGNATURES) -> DataFrame:
    """Distinct (mention_id, entity_id) that share a first token, a signature, or are named as co-occurring. Empty ``planes`` leave the signatures out; an embedding of another length than theirs is an error."""
    names = F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    blocks = entities.select("entity_id", names.alias("name")).select("entity_id", T.first_token(F.col("name")).alias("k")).where("k <> ''").distinct()
    found = mentions.select("mention_id", T.first_token(F.col("text")).alias("k")).join(blocks, "k").select("mention_id", "entity_id")
    found = found.unionByName(mentions.select("mention_id", F.explode("cooc").alias("entity_id")))
    if planes:
        def signed(t: DataFrame, key: str) -> DataFrame:
            fits = F.size("embedding") == len(planes[0])
            return t.where("embedding is not null").select(key, F.when(fits, V.signature(F.col("embedding"), planes)).otherwise(F.raise_error(F.lit("embedding and planes differ in length"))).alias("k"))

        found = found.unionByName(signed(mentions, "mention_id").join(signed(entities, "entity_id"), "k").select("mention_id", "entity_id"))
    return found.distinct()


def resolve(mentions: DataFrame, entities: DataFrame, planes: list[list[float]] = SIGNATURES, merge: float = MERGE, review: float = REVIEW) -> DataFrame:
    """(mention_id, entity_id, score, action): .4 cosine + .25 name similarity + .2 co-occurrence + .15 type.

    Scores are rounded to 12 decimals before they are compared, so that the order of additions doesn't decide at a threshold.
    """
    if review > merge:
        raise ValueError("review threshold above merge threshold")
    m = mentions.select("mention_id", F.col("text").alias("m_text"), F.col("entity_type").alias("m_type"), F.col("cooc").alias("m_cooc"), F.col("embedding").alias("m_emb"))
    e = entities.select("entity_id", "canonical_name", "aliases", "entity_type", "embedding")
    pairs = candidates(mentions, entities, planes).join(e, "entity_id").join(m, "mention_id")
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    best = F.array_max(F.transform(names, lambda n: T.similarity(T.clean_mention(F.col("m_text")), F.lower(n))))
    score = 0.4 * F.coalesce(V.cosine(F.col("m_emb"), F.col("embedding")), F.lit(0.0)) + 0.25 * best
    score = score + 0.2 * F.coalesce(F.array_contains("m_cooc", F.col("entity_id")).cast("double"), F.lit(0.0)) + 0.15 * F.coalesce((F.col("m_type") == F.col("entity_type")).cast("double"), F.lit(0.0))
    top = pairs.withColumn("s", F.round(score, 12)).where("s > 0").groupBy("mention_id").agg(F.max("s").alias("score"), F.min_by("entity_id", F.struct(-F.col("s"), "entity_id")).alias("best"))
    out = mentions.select("mention_id").join(top, "mention_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    action = F.when(F.col("score") >= merge, "merge").when(F.col("score") >= review, "review").otherwise("create")
    return out.select("mention_id", F.when(action != "create", F.col("best")).alias("entity_id"), "score", action.alias("action"))


def blocking_savings(mentions: DataFrame, entities: DataFrame, planes: list[list[float]] = SIGNATURES) -> DataFrame:
    """Comparisons without and with blocking."""
    naive = mentions.agg(F.count(F.lit(1)).alias("m")).join(entities.agg(F.count(F.lit(1)).alias("e")))
    return naive.join(candidates(mentions, entities, planes).agg(F.count(F.lit(1)).alias("blocked"))).select((F.col("m") * F.col("e")).alias("naive"), "blocked")
