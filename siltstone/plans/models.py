"""Evaluation, loss, curriculum and rollout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import vectors as V
from siltstone.operators import metrics, rollout
from siltstone.plans.tables import Tables, registry

QUERIES, ORACLES, query = registry()
PRED = "p AS (SELECT (vec_id % 5)::INT AS target, list_transform(range(5), lambda i: exp(4 * embedding[i + 1]::DOUBLE)) AS e FROM embeddings), q AS (SELECT target, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM p), r AS (SELECT target, probs, list_position(probs, list_max(probs)) - 1 AS predicted, list_max(probs) AS confidence FROM q)"
TARGETS = (0.1, 0.9, 0.8, 0.2, 0.4)


def predictions(t: Tables):
    probs = V.softmax(F.transform(F.slice("embedding", 1, 5), lambda x: 4 * x.cast("double")))
    r = t.embeddings.select((F.col("vec_id") % 5).cast("int").alias("target"), probs.alias("probs"), "embedding")
    return r.withColumn("predicted", V.argmax(F.col("probs"))).withColumn("confidence", F.array_max("probs"))


CLASSES = f"""WITH {PRED}, c AS (SELECT c::INT AS cls, count(*) FILTER (target = c AND predicted = c) AS tp, count(*) FILTER (target <> c AND predicted = c) AS fp, count(*) FILTER (target = c AND predicted <> c) AS fn, count(*) FILTER (target = c) AS support FROM r, range(5) t(c) GROUP BY c),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"""


@query(CLASSES + "SELECT cls, tp, fp, fn, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f")
def classification_report(t: Tables):
    return metrics.per_class(predictions(t), 5).select("cls", "tp", "fp", "fn", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(CLASSES + "SELECT round(sum(tp) / sum(support)::DOUBLE, 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, sum(support)::BIGINT AS n FROM f")
def evaluation_summary(t: Tables):
    return metrics.summary(predictions(t), 5).select(*[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")], "n")


@query("WITH s AS (SELECT n_chars AS score, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)), r AS (SELECT pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM s) SELECT round((sum(k) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 9) AS auroc FROM r")
def auroc_quality(t: Tables):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("positive"))
    return metrics.auroc(rows).select(F.round("auroc", 9).alias("auroc"))


@query(f"WITH {PRED}, b AS (SELECT least(15, floor(confidence * 15) + 1) AS bin, count(*) AS n, avg(confidence) AS c, avg((target = predicted)::INT) AS a FROM r GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b")
def ece_15(t: Tables):
    return metrics.ece(predictions(t).withColumn("correct", F.col("target") == F.col("predicted"))).select(F.round("ece", 6).alias("ece"), "n")


@query(f"WITH {PRED} SELECT round(avg(abs(confidence - (target = predicted)::INT)), 6) AS calibration_error FROM r")
def calibration_gap(t: Tables):
    return metrics.calibration_gap(predictions(t).withColumn("correct", F.col("target") == F.col("predicted"))).select(F.round("calibration_error", 6).alias("calibration_error"))


@query("WITH g AS (SELECT (vec_id % 5)::INT AS target, 1 / (1 + exp(-unnest(embedding)::DOUBLE)) AS g FROM embeddings) SELECT target, round(avg(g), 6) AS mean, round(var_pop(g), 6) AS variance, count(*) AS n FROM g GROUP BY target")
def gate_stats(t: Tables):
    gates = t.embeddings.select((F.col("vec_id") % 5).cast("int").alias("target"), F.transform("embedding", lambda x: 1 / (1 + F.exp(-x.cast("double")))).alias("gate"))
    return metrics.gate_stats(gates).select("target", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "n")


@query(f"WITH {PRED}, h AS (SELECT -list_sum(list_transform(probs, lambda x: x * ln(x))) AS h FROM r) SELECT round(avg(h), 6) AS mean, round(min(h), 6) AS least, round(max(h), 6) AS most, round(avg(h) / ln(5), 6) AS normalized, round(avg((h / ln(5) < 0.3)::INT), 6) AS collapsed FROM h")
def attention_entropy(t: Tables):
    h = metrics.attention_entropy(predictions(t).select(F.col("probs").alias("p")))
    return h.select(*[F.round(c, 6).alias(c) for c in h.columns])


@query(f"WITH {PRED} SELECT round(avg(pow(1 - probs[target + 1], 2) * -ln(probs[target + 1]) * (1 + target)), 6) AS focal, round(sum(-ln(probs[target + 1]) * (1 + target)) / sum(1 + target), 6) AS weighted_ce FROM r")
def focal_loss(t: Tables):
    p = F.element_at("probs", F.col("target") + 1)
    w = (1 + F.col("target")).cast("double")
    return predictions(t).agg(F.round(metrics.focal(p, w), 6).alias("focal"), F.round(F.sum(-F.log(p) * w) / F.sum(w), 6).alias("weighted_ce"))


@query("WITH g AS (SELECT [0.1, 0.9, 0.8, 0.2, 0.4]::DOUBLE[][(vec_id % 5 + 1)::INT] AS t, 1 / (1 + exp(-list_avg(embedding::DOUBLE[]))) AS g FROM embeddings) SELECT round(avg(-(t * ln(g) + (1 - t) * ln(1 - g))), 6) AS loss FROM g".replace("]::DOUBLE[][(", "][("))
def gate_bce(t: Tables):
    mean = V.total(F.transform("embedding", lambda x: x.cast("double"))) / F.size("embedding")
    target = F.element_at(F.array(*[F.lit(x) for x in TARGETS]), (F.col("vec_id") % 5 + 1).cast("int"))
    return t.embeddings.agg(F.round(metrics.gate_bce(1 / (1 + F.exp(-mean)), target), 6).alias("loss"))


@query(f"WITH {PRED} SELECT round(0.1 * avg(list_sum(list_transform(range(1, 6), lambda i: (probs[i] - probs[6 - i]) * (ln(probs[i]) - ln(probs[6 - i]))))), 6) AS loss FROM r")
def symmetric_kl(t: Tables):
    return predictions(t).agg(F.round(metrics.symmetric_kl(F.col("probs"), F.reverse("probs")), 6).alias("loss"))


CURRICULUM = "s AS (SELECT range AS epoch, 1 / (1 + exp(-0.5 * (5 - range))) AS a, greatest(0, 1 / (1 + exp(-0.5 * (range - 5))) - 1 / (1 + exp(-0.5 * (range - 16)))) AS b, 1 / (1 + exp(-0.5 * (range - 14))) AS c FROM range(1, 31))"


@query(f"WITH {CURRICULUM} SELECT epoch, round(a / (a + b + c), 9) AS tier1, round(b / (a + b + c), 9) AS tier2, round(c / (a + b + c), 9) AS tier3 FROM s")
def curriculum_weights(t: Tables):
    w = rollout.curriculum(t.spark.range(1, 31).withColumnRenamed("id", "epoch"))
    return w.select("epoch", *[F.round(c, 9).alias(c) for c in ("tier1", "tier2", "tier3")])


@query(f"""WITH {CURRICULUM}, w AS (SELECT epoch, a / (a + b + c) AS x, b / (a + b + c) AS y, c / (a + b + c) AS z FROM s), n AS (SELECT *, round_even(x * 64, 0)::INT AS i, round_even(y * 64, 0)::INT AS j, round_even(z * 64, 0)::INT AS k FROM w)
SELECT epoch, i + CASE WHEN x >= y AND x >= z THEN 64 - i - j - k ELSE 0 END AS n_tier1, j + CASE WHEN y > x AND y >= z THEN 64 - i - j - k ELSE 0 END AS n_tier2, k + CASE WHEN z > x AND z > y THEN 64 - i - j - k ELSE 0 END AS n_tier3 FROM n""")
def tier_counts(t: Tables):
    return rollout.tier_counts(rollout.curriculum(t.spark.range(1, 31).withColumnRenamed("id", "epoch")), 64)


GATE = "g AS (SELECT o_orderkey, ['shadow', 'canary_5', 'canary_25', 'canary_50', 'production', 'rolled_back'][(o_orderkey % 6 + 1)::INT] AS state, (o_orderkey % 30)::DOUBLE AS hours, (o_orderkey % 97) / 97.0 AS drift, (o_orderkey % 13) / 100.0 AS o, (o_orderkey % 17) / 100.0 AS c FROM orders)"


@query(f"""WITH {GATE}, a AS (SELECT *, CASE WHEN state = 'rolled_back' THEN 'hold' WHEN drift > 0.75 OR o > 0.12 OR c > 0.15 THEN 'rollback' WHEN state = 'production' THEN 'hold'
WHEN hours < CASE state WHEN 'shadow' THEN 6 WHEN 'canary_5' THEN 24 ELSE 12 END THEN 'hold' WHEN drift >= 0.5 THEN 'hold' ELSE 'promote' END AS action,
CASE WHEN state = 'rolled_back' THEN 'rolled back' WHEN drift > 0.75 THEN 'drift' WHEN o > 0.12 THEN 'overrides' WHEN c > 0.15 THEN 'calibration' WHEN state = 'production' THEN 'end of path'
WHEN hours < CASE state WHEN 'shadow' THEN 6 WHEN 'canary_5' THEN 24 ELSE 12 END THEN 'dwell' WHEN drift >= 0.5 THEN 'drift warning' ELSE 'ready' END AS reason FROM g)
SELECT o_orderkey, state, action, reason, CASE action WHEN 'rollback' THEN 'rolled_back' WHEN 'hold' THEN state ELSE CASE state WHEN 'shadow' THEN 'canary_5' WHEN 'canary_5' THEN 'canary_25' WHEN 'canary_25' THEN 'canary_50' ELSE 'production' END END AS next_state FROM a""")
def rollout_gate(t: Tables):
    k = F.col("o_orderkey")
    states = F.array(*[F.lit(x) for x in ("shadow", "canary_5", "canary_25", "canary_50", "production", "rolled_back")])
    rows = t.orders.select("o_orderkey", F.element_at(states, (k % 6 + 1).cast("int")).alias("state"), (k % 30).cast("double").alias("hours_in_state"), (k % 97 / 97.0).alias("drift"), (k % 13 / 100.0).alias("override"), (k % 17 / 100.0).alias("calibration"))
    return rollout.gate(rows).select("o_orderkey", "state", "action", "reason", "next_state")


@query("SELECT count(*) AS n, round(avg((event_id % 20 <> 0)::INT), 9) AS agreement, CASE WHEN avg((event_id % 20 = 0)::INT) FILTER (value >= 50) > 0.25 THEN 'block' WHEN avg((event_id % 20 <> 0)::INT) < 0.95 THEN 'hold' ELSE 'promote' END AS action FROM events")
def promotion_readiness(t: Tables):
    agree = rollout.agreement(F.when(F.col("event_id") % 20 == 0, "a").otherwise("b"), F.lit("b"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    return rollout.readiness(t.events.select(agree.alias("agree"), (F.col("value") / 100).alias("drift"))).select("n", F.round("agreement", 9).alias("agreement"), "action")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'full_retrain' WHEN o_orderkey % 7 = 0 THEN 'phase3_finetune' WHEN (o_orderkey % 11) / 100.0 >= 0.08 THEN 'targeted_finetune' WHEN o_orderkey % 40 > 21 THEN 'scheduled_retrain' ELSE 'none' END AS action,
CASE WHEN o_orderkey % 50 = 0 THEN 'critical' WHEN o_orderkey % 7 = 0 THEN 'high' WHEN (o_orderkey % 11) / 100.0 >= 0.08 THEN 'medium' ELSE 'low' END AS priority FROM orders""")
def retrain_decision(t: Tables):
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", (k % 50 == 0).alias("architecture_changed"), F.when(k % 7 == 0, "critical").otherwise("healthy").alias("drift_status"), (k % 11 / 100.0).alias("override"), (k % 40).alias("age_days"))
    return rollout.retrain(rows, 0.04).select("o_orderkey", "action", "priority")


@query("SELECT n_nationkey AS model, max(CASE WHEN r_regionkey <= n_regionkey AND (r_regionkey * 20) / 100.0 < 0.75 THEN r_regionkey END) AS context FROM nation, region GROUP BY n_nationkey")
def latest_compatible_context(t: Tables):
    m = t.nation.select(F.col("n_nationkey").alias("model"), F.sequence(F.lit(0), F.col("n_regionkey")).alias("allowed"))
    c = t.region.select(F.col("r_regionkey").alias("context"), F.col("r_regionkey").alias("gnn"), (F.col("r_regionkey") * 20 / 100.0).alias("score"), F.col("r_regionkey").alias("seq"))
    return rollout.latest_compatible(m, c)


@query("SELECT event_id, round((floor(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) - floor(epoch(ts)))::DOUBLE / 3600, 6) AS hours FROM events")
def state_dwell(t: Tables):
    e = t.events.select("event_id", F.col("user_id").alias("version"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("ts"))
    return rollout.transitions(e).select("event_id", F.round("hours", 6).alias("hours"))


@query("""WITH RECURSIVE e AS (SELECT user_id % 8 AS run, event_id AS epoch, value AS loss, (event_id % 10) / 50.0 AS grad, (event_id % 100) / 400.0 AS gv, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS k FROM events),
r AS (SELECT run, epoch, k, 1 AS phase, loss::DOUBLE AS best, 0 AS since FROM e WHERE k = 1
UNION ALL SELECT run, epoch, k, CASE WHEN up THEN phase + 1 ELSE phase END, CASE WHEN up THEN NULL WHEN better THEN loss ELSE best END, CASE WHEN up OR better THEN 0 ELSE since + 1 END FROM (
SELECT e.run, e.epoch, e.k, r.phase, e.loss, r.best, r.since, r.best IS NULL OR e.loss < r.best - 1e-6 AS better,
(r.phase = 1 AND CASE WHEN r.best IS NULL OR e.loss < r.best - 1e-6 THEN 0 ELSE r.since + 1 END >= 3 AND grad < 0.1) OR (r.phase = 2 AND gv > 0.15) AS up FROM r JOIN e ON e.run = r.run AND e.k = r.k + 1))
SELECT run, epoch, phase::INT AS phase FROM r""")
def phase_transitions(t: Tables):
    e = t.events.select((F.col("user_id") % 8).alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("loss"), (F.col("event_id") % 10 / 50.0).alias("grad"), (F.col("event_id") % 100 / 400.0).alias("gate_variance"))
    return rollout.phases(e)


@query("""WITH RECURSIVE e AS (SELECT (user_id % 4)::VARCHAR AS track, event_id AS seq, event_id % 3 = 0 AS is_model, event_id::VARCHAR AS version, (event_id % 5)::VARCHAR AS gnn, [(event_id % 5)::VARCHAR, ((event_id + 1) % 5)::VARCHAR] AS allowed, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS k FROM events),
n AS (SELECT *, [max(CASE WHEN NOT is_model AND gnn = '0' THEN seq END) OVER w, max(CASE WHEN NOT is_model AND gnn = '1' THEN seq END) OVER w, max(CASE WHEN NOT is_model AND gnn = '2' THEN seq END) OVER w, max(CASE WHEN NOT is_model AND gnn = '3' THEN seq END) OVER w, max(CASE WHEN NOT is_model AND gnn = '4' THEN seq END) OVER w] AS newest FROM e WINDOW w AS (PARTITION BY track ORDER BY seq)),
r AS (SELECT track, 0::BIGINT AS k, 0::BIGINT AS seq, NULL::VARCHAR AS model, NULL::VARCHAR[] AS allowed, NULL::VARCHAR AS context, []::VARCHAR[] AS parked, []::VARCHAR[] AS pruned FROM (SELECT DISTINCT track FROM n)
UNION ALL SELECT n.track, n.k, n.seq, CASE WHEN is_model THEN n.version ELSE r.model END, CASE WHEN is_model THEN n.allowed ELSE r.allowed END,
CASE WHEN is_model THEN greatest(newest[n.allowed[1]::INT + 1], newest[n.allowed[2]::INT + 1])::VARCHAR WHEN r.model IS NOT NULL AND list_contains(r.allowed, n.gnn) THEN n.version ELSE r.context END,
CASE WHEN is_model THEN list_filter(r.parked, lambda g: list_contains(n.allowed, g)) ELSE list_distinct(list_append(r.parked, n.gnn)) END,
CASE WHEN is_model THEN list_filter(r.parked, lambda g: NOT list_contains(n.allowed, g)) ELSE [] END FROM r JOIN n ON n.track = r.track AND n.k = r.k + 1)
SELECT track, seq, model, context, CASE WHEN model IS NULL THEN 'none' WHEN context IS NULL THEN 'parked' ELSE 'deployed' END AS status, coalesce(array_to_string(list_sort(pruned), ','), '') AS pruned FROM r WHERE k > 0""")
def track_sync(t: Tables):
    k = F.col("event_id")
    e = t.events.select((F.col("user_id") % 4).cast("string").alias("track"), k.alias("seq"), F.when(k % 3 == 0, "model").otherwise("context").alias("kind"), k.cast("string").alias("version"), (k % 5).cast("string").alias("gnn"), F.array((k % 5).cast("string"), ((k + 1) % 5).cast("string")).alias("allowed"))
    return rollout.track_sync(e)
