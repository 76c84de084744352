"""Graph and review queries. Contents: orders; entities: suppliers; sources: customers; review items: events."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import graph, review
from siltstone.plans.tables import Tables, registry

QUERIES, ORACLES, query = registry()
EDGES = """e AS (SELECT DISTINCT 'c' || l_orderkey AS src, 's' || l_suppkey AS dst, 'mentions' AS type FROM lineitem UNION SELECT 'c' || o_orderkey, 'u' || o_custkey, 'posted_by' FROM orders)"""


def edges(t: Tables):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    m = t.lineitem.select(name("c", "l_orderkey").alias("src"), name("s", "l_suppkey").alias("dst"), F.lit("mentions").alias("type")).distinct()
    return m.unionByName(t.orders.select(name("c", "o_orderkey").alias("src"), name("u", "o_custkey").alias("dst"), F.lit("posted_by").alias("type")))


def merges(t: Tables):
    return t.supplier.where("s_suppkey % 10 = 1").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source"), F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string")).alias("target"))


@query(f"WITH {EDGES}, m AS (SELECT 's' || s_suppkey AS source, 's' || (s_suppkey + 1) AS target FROM supplier WHERE s_suppkey % 10 = 1) SELECT DISTINCT src, coalesce(target, dst) AS dst, type FROM e LEFT JOIN m ON dst = source")
def graph_merge(t: Tables):
    return graph.merge_edges(edges(t), merges(t))


@query(f"WITH {EDGES}, m AS (SELECT 's' || s_suppkey AS source, 's' || (s_suppkey + 1) AS target FROM supplier WHERE s_suppkey % 10 = 1) SELECT target, src AS id FROM e JOIN m ON dst = source UNION SELECT target, target FROM m")
def merge_affected(t: Tables):
    return graph.affected(edges(t), merges(t))


@query(f"WITH {EDGES} SELECT DISTINCT src, CASE WHEN dst = 's1' AND type = 'mentions' AND substr(src, 2)::BIGINT % 2 = 0 THEN 's1b' ELSE dst END AS dst, type FROM e")
def graph_split(t: Tables):
    moves = t.orders.where("o_orderkey % 2 = 0").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("content"), F.lit("s1").alias("old"), F.lit("s1b").alias("new"))
    return graph.split_edges(edges(t), moves)


@query(f"WITH {EDGES} SELECT src AS id, dst FROM e WHERE type = 'mentions' AND src IN (SELECT 'c' || o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def graph_neighbors(t: Tables):
    return graph.neighbors(edges(t), t.orders.where("o_orderstatus = 'F'").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("id")), "mentions")


@query(f"WITH {EDGES} SELECT dst AS entity, count(*) AS n FROM e WHERE type = 'mentions' GROUP BY dst")
def affected_contents(t: Tables):
    all_ = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return graph.mentioning(edges(t), all_).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT l_orderkey AS content_id FROM lineitem JOIN (SELECT l_orderkey, max(l_discount) AS c FROM lineitem GROUP BY l_orderkey) USING (l_orderkey) JOIN supplier ON s_suppkey = l_suppkey WHERE c > 0.05 AND (s_suppkey % 3 = 0 OR s_suppkey % 7 >= 1)""")
def requeue_gate(t: Tables):
    a = t.lineitem.select(F.col("l_orderkey").alias("content_id"), F.col("l_suppkey").alias("entity")).distinct().withColumn("moved", F.when(F.col("entity") % 3 == 0, None).otherwise(F.col("entity") % 7 / 10.0))
    r = t.lineitem.groupBy(F.col("l_orderkey").alias("content_id")).agg(F.collect_set("l_suppkey").alias("mentioned"), (F.max("l_discount") * 4).alias("graph_contribution"))
    return graph.requeue(a, r, 0.1, 0.2)


@query("""SELECT 'c' || o_orderkey AS src, 'u' || o_custkey AS dst, 'posted_by' AS type FROM orders WHERE o_orderkey % 5 <> 0
UNION SELECT 'c' || l_orderkey, 's' || l_suppkey, 'mentions' FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_suppkey % 4 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)""")
def populate_graph_edges(t: Tables):
    return _populate(t)[0]


@query("""WITH l AS (SELECT * FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)), c AS (SELECT l_orderkey, list_sort(list(DISTINCT 's' || l_suppkey) FILTER (l_suppkey % 4 <> 0)) AS cooc FROM l GROUP BY l_orderkey)
SELECT 'c' || l_orderkey AS content_id, 'supplier ' || l_suppkey AS text, coalesce(array_to_string(cooc, ','), '') AS cooc FROM l JOIN c USING (l_orderkey) WHERE l_suppkey % 4 = 0""")
def pending_mentions(t: Tables):
    return _populate(t)[1].withColumn("cooc", F.array_join("cooc", ","))


def _populate(t: Tables):
    cid = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    items = t.orders.select(cid("o_orderkey").alias("content_id"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("source_id"))
    said = t.lineitem.select(cid("l_orderkey").alias("content_id"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("text"), F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("entity_id"))
    return graph.populate(items, said, t.orders.where("o_orderkey % 5 = 0").select(cid("o_orderkey").alias("content_id")))


@query("SELECT event_id, (SELECT count(*) FROM events b WHERE b.ts BETWEEN a.ts - INTERVAL 5 MINUTE AND a.ts) / 5.0::DOUBLE AS velocity FROM events a")
def ingest_velocity(t: Tables):
    return review.velocity(t.events.select("event_id", "ts")).select("event_id", "velocity")


@query("""WITH p AS (SELECT event_id, (user_id % 120)::DOUBLE AS n, least(1, value / 100) AS impact, (event_id % 90)::DOUBLE AS v, CASE WHEN event_id % 3 = 0 THEN [value / 100, 0.5] WHEN event_id % 3 = 1 THEN [value / 100] ELSE [] END AS c FROM events)
SELECT event_id, round(0.35 * least(1, ln(1 + n) / ln(101)) + 0.25 * greatest(0, impact) + 0.25 * least(1, v / 60) + 0.15 * CASE len(c) WHEN 2 THEN greatest(0, 1 - abs(c[1] - c[2])) WHEN 1 THEN greatest(0, 1 - 2 * abs(c[1] - 0.75)) ELSE 0 END, 6) AS priority FROM p""")
def review_priority(t: Tables):
    v = F.col("value") / 100
    c = F.when(F.col("event_id") % 3 == 0, F.array(v, F.lit(0.5))).when(F.col("event_id") % 3 == 1, F.array(v)).otherwise(F.array().cast("array<double>"))
    return t.events.select("event_id", F.round(review.priority((F.col("user_id") % 120).cast("double"), v, (F.col("event_id") % 90).cast("double"), c), 6).alias("priority"))


@query("""WITH RECURSIVE i AS (SELECT s_suppkey AS id, s_nationkey AS top, [lower(x) FOR x IN string_split(s_name || ' of ' || (s_suppkey % 7), ' ')] AS w, (s_suppkey % 13) / 13.0 AS p FROM supplier),
l AS (SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON a.top = b.top OR len(list_intersect(a.w, b.w)) >= 0.6 * len(list_distinct(list_concat(a.w, b.w)))),
r(id, root) AS (SELECT id, id FROM i UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE l.b <> r.id), c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT 'cluster:' || substr(sha1(array_to_string(list_sort(list(id::VARCHAR)), '|')), 1, 12) AS cluster_id, arg_min(id, (-p, id)) AS representative, count(*) AS n, array_to_string(list(id ORDER BY -p, id), ',') AS members, round(sum(p) + 0.05 * ln(count(*)), 6) AS aggregate_priority FROM c JOIN i USING (id) GROUP BY root""")
def review_clusters(t: Tables):
    i = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" of "), (F.col("s_suppkey") % 7).cast("string")).alias("mention"), F.col("s_nationkey").alias("top"), (F.col("s_suppkey") % 13 / 13.0).alias("priority"))
    members = F.array_join(F.transform("members", lambda x: x.cast("string")), ",")
    return review.clusters(i).select("cluster_id", "representative", F.size("members").cast("long").alias("n"), members.alias("members"), F.round("aggregate_priority", 6).alias("aggregate_priority"))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) AND event_id % 2 = 0 OR event_id % 2 = 1 AND ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)")
def stale_items(t: Tables):
    ts = F.col("ts").cast("timestamp")
    items = t.events.select("event_id", ts.alias("created_at"), F.when(F.col("event_id") % 2 == 1, ts + F.expr("interval 1 hour")).alias("auto_resolve_at"))
    now = items.agg(F.max("created_at").alias("now"))
    return review.stale(items.join(F.broadcast(now)), F.col("now")).select("event_id")


@query("SELECT count(*) FILTER (event_id % 4 = 0) AS depth, round(count(*) FILTER (event_id % 4 = 1) / count(*) FILTER (event_id % 4 <> 0)::DOUBLE, 9) AS auto_rate, round(avg(CASE WHEN event_id % 4 <> 0 THEN event_id % 600 END), 6) AS mean_seconds FROM events")
def queue_stats(t: Tables):
    ts = F.col("ts").cast("timestamp")
    items = t.events.select(ts.alias("created_at"), F.when(F.col("event_id") % 4 != 0, ts + F.make_interval(secs=F.col("event_id") % 600)).alias("resolved_at"), (F.col("event_id") % 4 == 1).alias("auto"))
    return review.queue_stats(items).select("depth", F.round("auto_rate", 9).alias("auto_rate"), F.round("mean_seconds", 6).alias("mean_seconds"))
