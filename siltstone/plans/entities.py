"""Entity-resolution queries. Entities: benchmark items by their first three tokens, or customers by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vectors as V
from siltstone.operators import resolve
from siltstone.plans.tables import Tables, registry

QUERIES, ORACLES, query = registry()
#: Texts of fewer files than this are dealt out first.
SMALL = 8

GRAMS = r"""toks AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''\-]*') AS t FROM documents),
grams AS (SELECT doc_id, unnest(flatten(list_transform(range(1, 4), lambda n: list_transform(range(0, greatest(len(t) - n + 1, 0)), lambda i: array_to_string(t[i + 1 : i + n], ' '))))) AS g FROM toks)"""
ITEMS = r"""items AS (SELECT item_id, lower(array_to_string(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''\-]*')[1:3], ' ')) AS alias FROM benchmark),
alias AS (SELECT alias, max(item_id) AS entity_id FROM items WHERE alias <> '' GROUP BY alias)"""


def _grams(t: Tables):
    """(doc_id, gram) of runs of 1 to 3 tokens. Texts that lie in few files are dealt out first."""
    docs = t.documents.select("doc_id", "text").repartition(t.spark.sparkContext.defaultParallelism) if t.size("documents") < SMALL else t.documents.select("doc_id", "text")
    return docs.select("doc_id", T.tokens(F.col("text")).alias("toks")).select("doc_id", F.explode(T.ngrams(F.col("toks"))).alias("gram"))


def item_entities(t: Tables):
    name = F.array_join(F.slice(T.tokens(F.col("text")), 1, 3), " ")
    return t.benchmark.select(F.col("item_id").alias("entity_id"), name.alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.col("item_id").alias("seq"))


@query(f"WITH {GRAMS}, {ITEMS} SELECT doc_id, count(*) AS n_resolved, count(DISTINCT entity_id) AS n_entities FROM grams JOIN alias ON lower(g) = alias GROUP BY doc_id")
def resolve_exact_mentions(t: Tables):
    """Mentions of each document that are aliases. Aliases are a dimension; Spark broadcasts them if they are small."""
    mentions = _grams(t).withColumnRenamed("gram", "mention")
    found = resolve.exact_lookup(mentions, resolve.alias_table(item_entities(t)), stripped=True).where("entity_id is not null")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_resolved"), F.countDistinct("entity_id").alias("n_entities"))


@query(f"WITH {GRAMS} SELECT g AS gram, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM grams GROUP BY g HAVING count(*) >= 50")
def candidate_ngrams(t: Tables):
    per = _grams(t).groupBy("gram", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("gram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs")).where("n >= 50")


@query("""
WITH a AS (SELECT lower(c_name) AS alias, c_custkey AS entity_id, row_number() OVER (PARTITION BY lower(substr(c_name, 1, 3)) ORDER BY c_custkey) AS n FROM customer),
m AS (SELECT c_custkey AS mention_id, lower(replace(c_name, '#', '')) AS m FROM customer),
s AS (SELECT mention_id, entity_id, n, CASE WHEN m = alias THEN 1.0 ELSE 1 - levenshtein(m, alias) / greatest(length(m), length(alias))::DOUBLE END AS score FROM m JOIN a ON substr(m, 1, 3) = substr(alias, 1, 3) AND n <= 50),
b AS (SELECT mention_id, arg_max(entity_id, (score, -n)) AS e, max(score) AS s FROM s GROUP BY mention_id)
SELECT mention_id, CASE WHEN s >= 0.92 THEN e END AS entity_id, CASE WHEN s >= 0.92 THEN round(s, 9) ELSE 0 END AS score FROM m LEFT JOIN b USING (mention_id)
""")
def fuzzy_alias_lookup(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.col("c_custkey").alias("seq"))
    m = t.customer.select(F.col("c_custkey").alias("mention_id"), F.replace(F.col("c_name"), F.lit("#"), F.lit("")).alias("mention"))
    return resolve.fuzzy_lookup(m, resolve.alias_table(c)).select("mention_id", "entity_id", F.round("score", 9).alias("score"))


def _mentions(t: Tables):
    """Customers as entities whose key gives the embedding; the mentions are suppliers' names told as customers'."""
    emb = t.embeddings
    e = t.customer.join(emb, F.col("c_custkey") == F.col("vec_id") + 1, "left")
    e = e.select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("Client "), F.col("c_custkey").cast("string")).alias("canonical_name"), F.array(F.col("c_name")).alias("aliases"), F.col("c_mktsegment").alias("entity_type"), "embedding")
    m = t.supplier.join(emb, F.col("s_suppkey") == F.col("vec_id") + 1, "left")
    m = m.select(F.col("s_suppkey").alias("mention_id"), F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("text"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("entity_type"), F.array(F.col("s_suppkey") + 1, F.col("s_suppkey") + 2).alias("cooc"), "embedding")
    return m, e


def _planes_sql(planes: list[list[float]], op: str, join: str) -> str:
    return join.join(f"CASE WHEN list_inner_product(embedding::DOUBLE[], [{', '.join(map(repr, p))}]::DOUBLE[]) {op} 0 THEN {{{i}}} ELSE {{z}} END" for i, p in enumerate(planes))


SIGNATURES = V.gauss_planes(64)
BUCKETS = V.normal_planes(64)


SIGNED = "sg AS (SELECT vec_id + 1 AS id, " + _planes_sql(SIGNATURES, ">=", " || ").format(*["'1'"] * 8, z="'0'") + " AS k FROM embeddings)"
ER = "WITH " + SIGNED + """,
e AS (SELECT c_custkey AS entity_id, 'client ' || c_custkey AS n1, lower(c_name) AS n2, c_mktsegment AS et, embedding AS ee FROM customer LEFT JOIN embeddings ON c_custkey = vec_id + 1),
m AS (SELECT s_suppkey AS mention_id, lower('Customer#' || lpad(s_suppkey::VARCHAR, 9, '0')) AS mt, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS ty, [s_suppkey + 1, s_suppkey + 2] AS cooc, embedding AS me FROM supplier LEFT JOIN embeddings ON s_suppkey = vec_id + 1),
c AS (SELECT mention_id, entity_id FROM m JOIN e ON mt = n2 OR mt = 'client' UNION SELECT mention_id, unnest(cooc) FROM m
  UNION SELECT mention_id, entity_id FROM m JOIN sg x ON x.id = mention_id JOIN sg y ON x.k = y.k JOIN e ON y.id = entity_id),
s AS (SELECT mention_id, entity_id,
  round(0.4 * coalesce(list_cosine_similarity(me::DOUBLE[], ee::DOUBLE[]), 0) + 0.25 * greatest(1 - levenshtein(mt, n1) / greatest(length(mt), length(n1))::DOUBLE, 1 - levenshtein(mt, n2) / greatest(length(mt), length(n2))::DOUBLE)
  + 0.2 * list_contains(cooc, entity_id)::INT + 0.15 * (ty = et)::INT, 12) AS score FROM c JOIN e USING (entity_id) JOIN m USING (mention_id)),
b AS (SELECT mention_id, arg_min(entity_id, (-score, entity_id)) AS best, max(score) AS score FROM s WHERE score > 0 GROUP BY mention_id)
"""


@query(ER + """SELECT mention_id, CASE WHEN score >= 0.65 THEN best END AS entity_id, round(coalesce(score, 0), 6) AS score,
CASE WHEN score >= 0.85 THEN 'merge' WHEN score >= 0.65 THEN 'review' ELSE 'create' END AS action FROM m LEFT JOIN b USING (mention_id)""")
def blocked_resolution(t: Tables):
    """By all three blocks: first token, signature and co-occurrence."""
    return resolve.resolve(*_mentions(t), planes=SIGNATURES).withColumn("score", F.round("score", 6))


@query(ER + "SELECT (SELECT count(*) FROM m) * (SELECT count(*) FROM e) AS naive, (SELECT count(*) FROM c) AS blocked")
def blocking_savings(t: Tables):
    return resolve.blocking_savings(*_mentions(t), planes=SIGNATURES)


@query(f"SELECT signature, count(*) AS n, min(vec_id) AS first FROM (SELECT vec_id, {_planes_sql(SIGNATURES, '>=', ' || ').format(*["'1'"] * 8, z="'0'")} AS signature FROM embeddings) GROUP BY signature")
def lsh_signatures(t: Tables):
    return t.embeddings.select("vec_id", V.signature(F.col("embedding"), SIGNATURES).alias("signature")).groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))


@query(f"SELECT vec_id, ({_planes_sql(BUCKETS, '>', ' + ').format(*[1 << i for i in range(16)], z=0)})::INT AS bucket FROM embeddings")
def lsh_buckets(t: Tables):
    return t.embeddings.select("vec_id", V.bucket(F.col("embedding"), BUCKETS).alias("bucket"))
