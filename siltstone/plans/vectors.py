"""Vector-context queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import vectors as V
from siltstone.operators import batching, knn
from siltstone.plans.tables import Tables, registry

QUERIES, ORACLES, query = registry()
KNN = """d AS (SELECT q.vec_id AS query_id, b.vec_id AS node_id, list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))) AS distance FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS rank FROM d)"""


def _base(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


@query(f"WITH {KNN} SELECT query_id, node_id, round(distance, 6) AS distance, rank::INT AS rank FROM k WHERE rank <= 5")
def knn_topk(t: Tables):
    b = _base(t)
    return knn.nearest(b.where("id % 20 = 0"), b, 5).select("query_id", "node_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {KNN} SELECT query_id, node_id, rank::INT AS rank, CASE WHEN node_id % 10 = 3 THEN 'wal' ELSE 'main' END AS segment FROM k WHERE rank <= 5")
def knn_with_wal(t: Tables):
    """Main index and write-ahead segment are searched as one."""
    b = _base(t)
    both = b.where("id % 10 <> 3").unionByName(b.where("id % 10 = 3"))
    return knn.nearest(b.where("id % 20 = 0"), both, 5).select("query_id", "node_id", "rank", F.when(F.col("node_id") % 10 == 3, "wal").otherwise("main").alias("segment"))


def _pool_sql(keys: str, w: str, rows: str) -> str:
    return f"WITH {rows}, x AS (SELECT {keys}, {w} AS w, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM r) SELECT {keys}, (pos - 1)::INT AS pos, round(sum(w * v) / sum(w), 6) AS v FROM x GROUP BY {keys}, pos"


@query(_pool_sql("query_id", "1.0", KNN + ", r AS (SELECT query_id, embedding FROM k JOIN embeddings ON node_id = vec_id WHERE rank <= 5)"))
def temporal_context(t: Tables):
    """Mean of the embeddings of each query's neighbours."""
    b = _base(t)
    near = knn.nearest(b.where("id % 20 = 0"), b, 5).join(b, F.col("node_id") == F.col("id"))
    return knn.pool(near, ["query_id"]).select("query_id", F.posexplode("pooled").alias("pos", "v")).select("query_id", "pos", F.round("v", 6).alias("v"))


@query(_pool_sql("label", "1.0", "r AS (SELECT label, embedding FROM embeddings)"))
def mean_pool(t: Tables):
    return knn.pool(_base(t), ["label"]).select("label", F.posexplode("pooled").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("v"))


@query(_pool_sql("label", "(1 + vec_id % 7)", "r AS (SELECT label, embedding, vec_id FROM embeddings)").replace("label, (1", "label, (1"))
def attention_pool(t: Tables):
    return knn.pool(_base(t), ["label"], weight=(1 + F.col("id") % 7).cast("double")).select("label", F.posexplode("pooled").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("v"))


STATS = """x AS (SELECT label < 5 AS g, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings), p AS (SELECT g, pos, avg(v) AS mean, stddev_pop(v) AS std FROM x GROUP BY g, pos),
n AS (SELECT label < 5 AS g, count(*) AS n, avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS norm_mean, stddev_pop(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS norm_std FROM embeddings GROUP BY 1)"""


@query(f"WITH {STATS} SELECT g, pos::INT AS pos, round(mean, 6) AS mean, round(std, 6) AS std, n, round(norm_mean, 6) AS norm_mean, round(norm_std, 6) AS norm_std FROM p JOIN n USING (g)")
def embedding_stats(t: Tables):
    s = knn.stats(_base(t).withColumn("g", F.col("label") < 5), ["g"])
    return s.select("g", "pos", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "n", *[F.round(c, 6).alias(c) for c in ("norm_mean", "norm_std")])


@query(f"""WITH {STATS} SELECT (SELECT n FROM n WHERE NOT g) AS n,
round((SELECT least(1, max(abs(b.mean - a.mean) / greatest(a.std, 1e-8)) / 5) FROM p a JOIN p b ON a.pos = b.pos WHERE a.g AND NOT b.g), 6) AS marginal,
round((SELECT least(1, abs(b.norm_mean - a.norm_mean) / a.norm_mean) FROM n a, n b WHERE a.g AND NOT b.g), 6) AS norm""")
def drift_marginal_and_norm(t: Tables):
    b = _base(t)
    return knn.drift(b.where("label < 5"), b.where("label >= 5")).select("n", F.round("marginal", 6).alias("marginal"), F.round("norm", 6).alias("norm"))


@query()
def drift_report(t: Tables):
    b = _base(t)
    return knn.drift(b.where("label < 5"), b.where("label >= 5"))


@query("""WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8 AS n FROM embeddings),
c AS (SELECT a.vec_id AS id, b.vec_id AS other, list_inner_product(a.e, b.e) / (a.n * b.n) AS cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id)
SELECT id, arg_min(other, (abs(cosine - 0.55), other)) AS other, round(arg_min(cosine, (abs(cosine - 0.55), other)), 6) AS cosine FROM c WHERE cosine BETWEEN 0.4 AND 0.7 GROUP BY id""")
def hard_contradictions(t: Tables):
    return knn.contradictions(_base(t)).withColumn("cosine", F.round("cosine", 6))


@query("SELECT round(sum(n - 1) / sum(n)::DOUBLE, 9) AS hit_rate, sum(n)::BIGINT AS n FROM (SELECT user_id % 97 AS bucket, event_type AS k, count(*) AS n FROM events GROUP BY 1, 2)")
def cache_hit_rate(t: Tables):
    q = t.events.select("user_id", F.col("event_type").alias("k"))
    return batching.cache_hits(q, F.col("user_id") % 97).withColumn("hit_rate", F.round("hit_rate", 9))


@query("SELECT vec_id, round(1 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))), 6) AS distance FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings)")
def half_cosine(t: Tables):
    a, b = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    return t.embeddings.select("vec_id", F.round(1 - V.cosine(a, b), 6).alias("distance"))


@query("SELECT vec_id, (list_position(z, list_max(z)) - 1)::INT AS class_index, ['satire', 'authentic', 'news', 'mixed', 'other'][list_position(z, list_max(z))] AS class_name FROM (SELECT vec_id, embedding[1:5]::DOUBLE[] AS z FROM embeddings)")
def scored_classes(t: Tables):
    """A black-box scorer on the first five components."""

    def make():
        return lambda x: x[:, :5]

    return batching.predict(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x")), make, "x", 64, ["satire", "authentic", "news", "mixed", "other"]).select("vec_id", "class_index", "class_name")


@query("""WITH RECURSIVE e AS (SELECT user_id % 16 AS worker, event_id AS id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id % 16 ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
r AS (SELECT worker, id, k, 0 AS batch, ms AS first, 1 AS n FROM e WHERE k = 1
UNION ALL SELECT e.worker, e.id, e.k, CASE WHEN n >= 32 OR ms - first > 50 THEN batch + 1 ELSE batch END, CASE WHEN n >= 32 OR ms - first > 50 THEN ms ELSE first END, CASE WHEN n >= 32 OR ms - first > 50 THEN 1 ELSE n + 1 END FROM r JOIN e ON e.worker = r.worker AND e.k = r.k + 1)
SELECT worker, id, batch::INT AS batch FROM r""")
def micro_batches(t: Tables):
    return batching.micro_batches(t.events.select((F.col("user_id") % 16).alias("worker"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ms")))
