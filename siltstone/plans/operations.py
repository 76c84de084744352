"""Queries for context, corrections, rollout logs, compatibility, losses, caches and synthetic rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import vectors as V
from siltstone.operators import batching, context, corrections, metrics, resolve, review, rollout
from siltstone.plans import entities, graph, models
from siltstone.plans.tables import Tables, registry
from siltstone.sources import feeds, store

QUERIES, ORACLES, query = registry()

TEXTS = r"""toks AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''\-]*') AS t FROM benchmark),
runs AS (SELECT item_id, flatten(list_transform(range(1, 4), lambda n: list_transform(range(0, greatest(len(t) - n + 1, 0)), lambda i: array_to_string(t[i + 1 : i + n], ' ')))) AS g FROM toks),
grams AS (SELECT item_id, unnest(g) AS g, unnest(range(len(g))) AS place FROM runs),
items AS (SELECT item_id, lower(array_to_string(t[1:3], ' ')) AS alias FROM toks WHERE len(t) > 0)"""
FOUND = f"""{TEXTS}, exact AS (SELECT alias, max(item_id) AS entity_id FROM items GROUP BY alias), d AS (SELECT DISTINCT g AS m, lower(g) AS c FROM grams),
fz AS (SELECT alias, item_id AS entity_id, row_number() OVER (PARTITION BY substr(alias, 1, 3) ORDER BY item_id) AS n FROM items),
s AS (SELECT m, entity_id, n, 1 - levenshtein(c, alias) / greatest(length(c), length(alias))::DOUBLE AS score FROM d JOIN fz ON substr(c, 1, 3) = substr(alias, 1, 3) AND n <= 50 WHERE c NOT IN (SELECT alias FROM exact)),
r AS (SELECT m, entity_id, 1.0 AS score FROM d JOIN exact ON c = alias UNION ALL SELECT m, arg_max(entity_id, (score, -n)), max(score) FROM s GROUP BY m HAVING max(score) >= 0.92)"""


def _texts(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("id"), "text")


@query(f"""WITH {FOUND}, h AS (SELECT item_id, entity_id, score, place, embedding FROM grams JOIN r ON g = m JOIN embeddings ON vec_id = entity_id),
f AS (SELECT item_id, entity_id, arg_min(score, place) AS score, any_value(embedding)::DOUBLE[] AS e FROM h GROUP BY 1, 2),
p AS (SELECT item_id, count(*) AS n, avg(score) AS c, sum(CASE WHEN score >= 1 THEN 1 ELSE 0.85 END * list_inner_product(e, list_transform(range(1, len(e) + 1), lambda i: i::DOUBLE))) / sum(CASE WHEN score >= 1 THEN 1 ELSE 0.85 END) AS v FROM f GROUP BY item_id)
SELECT item_id, coalesce(n, 0) AS n_entities, round(coalesce(c, 0), 9) AS confidence, round(coalesce(v, 0), 5) AS weighed FROM benchmark LEFT JOIN p USING (item_id)""")
def graph_context(t: Tables):
    """Context of each benchmark text; the pooled vector is given as its inner product with 1, 2, 3 and so on."""
    emb = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    out = context.graph_context(_texts(t), resolve.alias_table(entities.item_entities(t)), emb, dim=64)
    weighed = V.total(F.transform("pooled", lambda x, i: x * (i + 1)))
    return out.select(F.col("id").alias("item_id"), "n_entities", F.round("confidence", 9).alias("confidence"), F.round(weighed, 5).alias("weighed"))


@query(f"WITH {FOUND} SELECT m AS mention, entity_id, round(score, 9) AS score FROM r")
def normalized_mentions(t: Tables):
    """Exact lookup, then fuzzy, of all runs of tokens in the benchmark's texts."""
    said = context.places(_texts(t)).select("mention").distinct().select(F.col("mention").alias("mention_id"), "mention")
    found = context.normalize(said, resolve.alias_table(entities.item_entities(t))).where("entity_id is not null")
    return found.select(F.col("mention_id").alias("mention"), "entity_id", F.round("score", 9).alias("score"))


LABELS = ("PERSON", "ORG", "GPE", "EVENT", "WORK_OF_ART", "CARDINAL")


@query(f"""WITH {TEXTS}, w AS (SELECT DISTINCT alias, {list(LABELS)}[(item_id % 6 + 1)::INT] AS label FROM items)
SELECT item_id, place::INT AS place, g AS text, label, CASE label WHEN 'PERSON' THEN 'person' WHEN 'ORG' THEN 'organization' WHEN 'GPE' THEN 'location' WHEN 'EVENT' THEN 'event' ELSE 'product' END AS entity_type
FROM grams JOIN w ON lower(g) = alias WHERE label <> 'CARDINAL'""")
def entity_extraction(t: Tables):
    """By a dictionary of the benchmark's first tokens; one of six labels has no type and is left out."""
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("entity_id") % 6 + 1).cast("int"))
    words = entities.item_entities(t).select(F.col("canonical_name").alias("surface"), label.alias("label"))
    return context.extract_entities(_texts(t), context.dictionary(words)).select(F.col("id").alias("item_id"), "place", "text", "label", "entity_type")


@query("""WITH a AS (SELECT lower(c_name) AS alias, c_custkey AS id FROM customer UNION ALL SELECT lower(trim(s_name)), s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)
SELECT count(DISTINCT alias) AS total_aliases, count(DISTINCT id) AS total_entities, count(DISTINCT substr(alias, 1, 3)) AS bucket_count FROM a""")
def alias_stats(t: Tables):
    """Customers' names, and suppliers' names registered later."""
    c = t.customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.col("c_custkey").alias("seq"))
    seq = F.struct((F.col("s_suppkey") + 10_000_000).alias("seq"), F.lit(0).alias("pos"))
    late = t.supplier.select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("  ").alias("alias"), F.col("s_suppkey").alias("entity_id"), seq.alias("seq"))
    return context.alias_stats(context.register_aliases(resolve.alias_table(c), late))


@query("""SELECT o_orderkey, CASE WHEN value IS NULL OR value > 80 THEN -1 ELSE value END AS score, value IS NULL OR value > 80 AS timed_out FROM orders LEFT JOIN events ON o_orderkey = event_id""")
def answers_in_time(t: Tables):
    """Events are answers to orders, of as many milliseconds as their value; 80 are allowed."""
    answers = t.events.select(F.col("event_id").alias("o_orderkey"), F.col("value").alias("score"))
    return context.with_defaults(t.orders.select("o_orderkey"), answers, "o_orderkey", {"score": F.lit(-1.0)}, late=F.col("score") > 80)


def _corrected(t: Tables) -> corrections.Corrected:
    s = lambda c: F.concat(F.lit("s"), c.cast("string"))
    k = F.col("s_suppkey")
    action = F.when(k % 10 == 1, "merge").when(k % 10 == 5, "split").when(k % 10 == 7, "confirm")
    target = F.when(k % 10 == 1, s(k + 1)).when(k % 10 == 5, F.concat(s(k), F.lit("b")))
    c = t.supplier.select(k.alias("correction_id"), action.alias("action"), s(k).alias("source"), target.alias("target"), F.when(k % 20 < 10, k).alias("deferred_id")).where("action is not null")
    moved = t.lineitem.where("l_suppkey % 10 = 5 and l_orderkey % 2 = 0").select(F.col("l_suppkey").alias("correction_id"), F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("content")).distinct()
    edges = graph.edges(t)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("kind", F.lit("node"))
    vec = lambda ids, at: ids.join(t.embeddings.select(F.col("vec_id").alias("at"), "embedding"), at == F.col("at")).select("id", "embedding")
    before = vec(t.supplier.select("s_suppkey", s(k).alias("id")), k % 100)
    same = F.when(k % 4 == 0, k % 100).otherwise(k % 100 + 1)
    after = vec(t.supplier.where("s_suppkey % 3 <> 0").select("s_suppkey", s(k).alias("id")), same).unionByName(vec(t.supplier.where("s_suppkey % 10 = 5").select("s_suppkey", F.concat(s(k), F.lit("b")).alias("id")), k % 100 + 2))
    records = t.lineitem.groupBy(F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("content_id")).agg(F.collect_set(s(F.col("l_suppkey"))).alias("mentioned"), (F.max("l_discount") * 4).alias("graph_contribution"))
    seen = t.orders.where("o_orderkey % 11 = 0").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("content_id"))
    backlog = t.supplier.select(k.alias("item_id"), F.col("s_name").alias("mention"))
    return corrections.apply(c, moved, nodes, edges, before, after, records, seen, backlog)


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS k FROM lineitem), c AS (SELECT l_orderkey AS o FROM lineitem GROUP BY 1 HAVING max(l_discount) * 4 > 0.2),
b AS (SELECT s_suppkey AS k, embedding AS e FROM supplier JOIN embeddings ON vec_id = s_suppkey % 100),
a AS (SELECT s_suppkey::VARCHAR AS k, embedding AS e FROM supplier JOIN embeddings ON vec_id = CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 100 ELSE s_suppkey % 100 + 1 END WHERE s_suppkey % 3 <> 0
UNION ALL SELECT s_suppkey || 'b', embedding FROM supplier JOIN embeddings ON vec_id = s_suppkey % 100 + 2 WHERE s_suppkey % 10 = 5),
v AS (SELECT o, k, (k + 1)::VARCHAR AS n FROM l WHERE k % 10 = 1 UNION SELECT o, k, k::VARCHAR FROM l WHERE k % 10 = 2 AND k - 1 IN (SELECT s_suppkey FROM supplier)
UNION SELECT o, k, CASE WHEN o % 2 = 0 THEN k || 'b' ELSE k::VARCHAR END FROM l WHERE k % 10 = 5)
SELECT DISTINCT 'c' || o AS content_id FROM v JOIN c USING (o) LEFT JOIN b ON b.k = v.k LEFT JOIN a ON a.k = v.n WHERE o % 11 <> 0 AND (a.e IS NULL OR b.e IS NULL OR list_distance(a.e::DOUBLE[], b.e::DOUBLE[]) >= 0.1)""")
def correction_requeue(t: Tables):
    """Suppliers are merged, split and confirmed; orders that mention them are classified again if the embedding they see moved."""
    return _corrected(t).requeued


@query("SELECT s_suppkey AS item_id, s_name AS mention FROM supplier WHERE s_suppkey % 10 NOT IN (1, 5, 7) OR s_suppkey % 20 >= 10")
def deferred_backlog(t: Tables):
    return _corrected(t).backlog


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS k FROM lineitem)
SELECT 's' || (k + 1) AS entity, count(*) + 1 AS n FROM l WHERE k % 10 = 1 GROUP BY k UNION ALL SELECT 's' || s_suppkey || 'b', count(o) + 2 FROM supplier LEFT JOIN l ON k = s_suppkey AND o % 2 = 0 WHERE s_suppkey % 10 = 5 GROUP BY s_suppkey
UNION ALL SELECT 's' || (s_suppkey + 1), 1 FROM supplier WHERE s_suppkey % 10 = 1 AND s_suppkey NOT IN (SELECT k FROM l)""")
def correction_affected(t: Tables):
    return _corrected(t).affected.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


CLUSTERS = """WITH RECURSIVE i AS (SELECT s_suppkey AS id, s_nationkey AS top, [lower(x) FOR x IN string_split(s_name || ' of ' || (s_suppkey % 7), ' ')] AS w, (s_suppkey % 13) / 13.0 AS p FROM supplier),
l AS (SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON a.top = b.top OR len(list_intersect(a.w, b.w)) >= 0.6 * len(list_distinct(list_concat(a.w, b.w)))),
r(id, root) AS (SELECT id, id FROM i UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE l.b <> r.id), c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
k AS (SELECT 'cluster:' || substr(sha1(array_to_string(list_sort(list(id::VARCHAR)), '|')), 1, 12) AS cluster_id, arg_min(id, (-p, id)) AS representative, list(id ORDER BY -p, id) AS members, round(sum(p) + 0.05 * ln(count(*)), 6) AS aggregate_priority FROM c JOIN i USING (id) GROUP BY root)"""


def _clusters(t: Tables):
    i = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" of "), (F.col("s_suppkey") % 7).cast("string")).alias("mention"), F.col("s_nationkey").alias("top"), (F.col("s_suppkey") % 13 / 13.0).alias("priority"))
    return review.clusters(i).withColumn("aggregate_priority", F.round("aggregate_priority", 6))


@query(CLUSTERS + " SELECT cluster_id, representative, array_to_string(members, ',') AS members, aggregate_priority FROM k ORDER BY aggregate_priority DESC, representative LIMIT 1")
def next_cluster(t: Tables):
    return review.next_cluster(_clusters(t)).withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query(CLUSTERS + " SELECT cluster_id, ['merge', 'reject', 'create', 'split', 'escalate'][(representative % 5 + 1)::INT] AS action, unnest(members) AS id FROM k WHERE representative % 3 <> 0")
def cluster_resolutions(t: Tables):
    c = _clusters(t)
    action = F.element_at(F.array(*[F.lit(x) for x in review.DECISIONS]), (F.col("representative") % 5 + 1).cast("int"))
    return review.resolve_clusters(c, c.where("representative % 3 <> 0").select("cluster_id", action.alias("action")))


@query("""WITH v AS (SELECT event_id, (SELECT count(*) FROM events b WHERE b.ts BETWEEN a.ts - INTERVAL 5 MINUTE AND a.ts) / 5.0::DOUBLE AS v, a.* EXCLUDE (event_id) FROM events a)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 30 MINUTE ELSE ts + INTERVAL 2 HOUR END AS auto_resolve_at, v AS velocity,
round(0.35 * least(1, ln(1 + user_id % 120) / ln(101)) + 0.25 * greatest(0, least(1, value / 100)) + 0.25 * least(1, v / 60) + 0.15 * greatest(0, 1 - abs(value / 100 - 0.5)), 6) AS priority FROM v""")
def pushed_items(t: Tables):
    ts = F.col("ts").cast("timestamp")
    v = F.col("value") / 100
    items = t.events.select("event_id", ts.alias("created_at"), F.when(F.col("event_id") % 2 == 1, ts + F.expr("interval 2 hours")).alias("auto_resolve_at"), (F.col("user_id") % 120).cast("double").alias("affected"), v.alias("impact"), F.array(v, F.lit(0.5)).alias("scores"))
    return review.push(items).select("event_id", F.col("auto_resolve_at").cast("timestamp_ntz").alias("auto_resolve_at"), "velocity", F.round("priority", 6).alias("priority"))


@query("""WITH s AS (SELECT user_id, event_id, ts, ['shadow', 'canary_5', 'canary_25', 'canary_50', 'production'][(event_id % 5 + 1)::INT] AS target, event_id % 3 = 0 AS done FROM events),
l AS (SELECT user_id, max(event_id) FILTER (NOT done) AS b, max(event_id) FILTER (done) AS c FROM s GROUP BY 1)
SELECT l.user_id AS version, coalesce(d.target, 'shadow') AS state, d.ts AS entered_at, CASE WHEN b IS NOT NULL AND (c IS NULL OR b > c) THEN o.target END AS pending FROM l LEFT JOIN s d ON d.event_id = c LEFT JOIN s o ON o.event_id = b""")
def transition_log(t: Tables):
    k = F.col("event_id")
    target = F.element_at(F.array(*[F.lit(x) for x in ("shadow", "canary_5", "canary_25", "canary_50", "production")]), (k % 5 + 1).cast("int"))
    return rollout.transition_log(t.events.select(F.col("user_id").alias("version"), k.alias("seq"), F.col("ts").cast("timestamp_ntz").alias("ts"), target.alias("target"), F.when(k % 3 == 0, "complete").otherwise("begin").alias("status")))


@query("""SELECT n_nationkey AS model, r_regionkey AS context, r_regionkey <= n_regionkey AND r_regionkey * 20 / 100.0 < 0.75 AS compatible,
CASE WHEN r_regionkey > n_regionkey OR r_regionkey * 20 / 100.0 >= 0.75 THEN 'critical' WHEN r_regionkey * 20 / 100.0 >= 0.5 THEN 'warning' ELSE 'healthy' END AS severity,
CASE WHEN r_regionkey > n_regionkey THEN 'architecture ' || r_regionkey || ' isn''t allowed' ELSE 'drift ' || format('{:.3f}', (r_regionkey * 20 / 100.0)::DOUBLE) END AS reason FROM nation, region""")
def compatibility_check(t: Tables):
    """Every model, a nation, with every context, a region."""
    m = t.nation.select(F.col("n_nationkey").alias("model"), F.sequence(F.lit(0), F.col("n_regionkey").cast("int")).alias("allowed"))
    c = t.region.select(F.col("r_regionkey").alias("context"), F.col("r_regionkey").cast("int").alias("gnn"), (F.col("r_regionkey") * 20 / 100.0).cast("double").alias("score"))
    pairs = t.nation.select(F.col("n_nationkey").alias("model")).join(F.broadcast(t.region.select(F.col("r_regionkey").alias("context"))), F.lit(True))  # five regions
    return rollout.compatibility(pairs, m, c)


@query("SELECT DISTINCT event_type AS gnn, event_type || '-context' AS context FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_id = (SELECT min(event_id) FROM events))")
def pruned_tracks(t: Tables):
    tracks = t.events.select(F.col("event_type").alias("gnn"), F.concat("event_type", F.lit("-context")).alias("context")).distinct()
    first = t.events.agg(F.min_by("event_type", "event_id").alias("gnn"))
    return rollout.pruned_tracks(tracks, first)


LOSS = """x AS (SELECT (vec_id % 5)::INT AS target, embedding::DOUBLE[] AS em FROM embeddings), y AS (SELECT target, em, list_transform(em[1:5], lambda v: exp(4 * v)) AS e FROM x),
z AS (SELECT target, list_transform(e, lambda v: v / list_sum(e)) AS p, list_transform(em, lambda v: 1 / (1 + exp(-v))) AS g FROM y),
w AS (SELECT target, p, 0.5 * (list_avg(g[1:32]) + list_avg(g[33:64])) AS g, [0.1, 0.9, 0.8, 0.2, 0.4][target + 1]::DOUBLE AS t FROM z),
l AS (SELECT sum(-ln(p[target + 1]) * (1 + target)) / sum(1 + target) AS ce, avg(pow(1 - p[target + 1], 2) * -ln(p[target + 1]) * (1 + target)) AS focal, avg(-(t * ln(g) + (1 - t) * ln(1 - g))) AS gate,
0.1 * avg(list_sum(list_transform(range(1, 6), lambda i: (p[i] - p[6 - i]) * (ln(p[i]) - ln(p[6 - i]))))) AS kl FROM w)"""


@query(f"WITH {LOSS} SELECT 1 AS phase, round(ce, 6) AS loss FROM l UNION ALL SELECT 2, round(focal + gate, 6) FROM l UNION ALL SELECT 3, round(focal + gate + kl, 6) FROM l")
def phased_loss(t: Tables):
    p = models.predictions(t).withColumn("alt_probs", F.reverse("probs"))
    gate = lambda first: F.transform(F.slice("embedding", first, 32), lambda x: 1 / (1 + F.exp(-x.cast("double"))))
    p = p.withColumn("t_gate", gate(1)).withColumn("v_gate", gate(33))
    parts = [metrics.phased_loss(p, phase, [1, 2, 3, 4, 5], list(models.TARGETS)) for phase in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("phase", F.round("loss", 6).alias("loss"))


@query("WITH g AS (SELECT list_transform(embedding::DOUBLE[], lambda v: 1 / (1 + exp(-v))) AS g FROM embeddings) SELECT round(sum(list_sum(g)) / sum(len(g)), 6) AS mean, round(var_pop(list_avg(g)), 9) AS variance, count(*) AS n FROM g")
def gate_overall(t: Tables):
    g = t.embeddings.select(F.transform("embedding", lambda x: 1 / (1 + F.exp(-x.cast("double")))).alias("gate"))
    return metrics.gate_overall(g).select(F.round("mean", 6).alias("mean"), F.round("variance", 9).alias("variance"), "n")


@query("""SELECT count(*) AS total_requests, count(DISTINCT (user_id % 16, event_id // 32)) AS total_batches, round(count(*) / count(DISTINCT (user_id % 16, event_id // 32))::DOUBLE, 6) AS avg_batch_size,
round(avg(value), 6) AS avg_latency_ms, round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0)::DOUBLE, 9) AS throughput FROM events""")
def batch_stats(t: Tables):
    r = t.events.select((F.col("user_id") % 16).alias("worker"), F.floor(F.col("event_id") / 32).alias("batch"), F.col("value").alias("latency_ms"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"))
    s = batching.batch_stats(r)
    return s.select("total_requests", "total_batches", F.round("avg_batch_size", 6).alias("avg_batch_size"), F.round("avg_latency_ms", 6).alias("avg_latency_ms"), F.round("throughput", 9).alias("throughput"))


@query("SELECT count(*) AS total_vectors, count(*) FILTER (vec_id % 10 = 3) AS wal_size, count(*) * 64 * 4 AS memory_bytes FROM embeddings")
def index_stats(t: Tables):
    return batching.index_stats(t.embeddings.where("vec_id % 10 <> 3"), t.embeddings.where("vec_id % 10 = 3"), 64)


@query()
def lru_cache(t: Tables):
    """Caches of 40 results, one per event type."""
    return batching.lru_hits(t.events.select((F.col("user_id") % 4).alias("cache"), F.col("event_id").alias("seq"), F.hash("event_type", F.floor(F.col("value"))).alias("key")), 40)


@query("""SELECT * FROM (VALUES ('reuters_world', 'Reuters', 'reuters.com'), ('bbc_news', 'BBC', 'bbc.co.uk'), ('ap_top', 'Associated Press', 'apnews.com'), ('npr_news', 'NPR', 'npr.org'), ('guardian_world', 'The Guardian', 'theguardian.com'),
('local', 'local', 'www.feeds.example.com:80')) v(feed, outlet, domain)""")
def feed_outlets(t: Tables):
    known = feeds.outlets(t.spark)
    asked = known.select("feed", "feed_url").unionByName(t.spark.createDataFrame([("local", "http://www.Feeds.example.com:80/rss")], "feed string, feed_url string"))
    return feeds.with_outlet(asked, known).select("feed", "outlet", "domain")


@query("""SELECT '/mock/tier' || t || '/' || i || '.jpg' AS image_path, ['easy authentic example ', 'topically coherent contradiction ', 'hard negative '][t] || i AS text, CASE WHEN t = 2 THEN 'original ' || i END AS original_text,
CASE WHEN t = 2 THEN 1 ELSE (i % 2)::INT END AS label, CASE WHEN t = 2 THEN 'hard' END AS difficulty, ['tier1_easy', 'tier2_contradiction', 'tier3_hard_negatives'][t] AS tier FROM range(100) a(i), range(1, 4) b(t)""")
def synthetic_manifests(t: Tables):
    return store.manifests(t.spark)


@query("SELECT * FROM (VALUES (1, 'projections', 0.001), (2, 'projections,cross_attention,reasoning,modality_dropout', 0.0005), (3, 'all', 0.0001)) v(phase, unfrozen_modules, learning_rate)")
def optimizer_configs(t: Tables):
    phases = t.spark.range(1, 4).select(F.col("id").cast("int").alias("phase"))
    return rollout.optimizer_configs(phases).withColumn("unfrozen_modules", F.array_join("unfrozen_modules", ","))
