"""Rollout, retraining and curriculum rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Promotion path and least hours in a state.
PATH = {"shadow": "canary_5", "canary_5": "canary_25", "canary_25": "canary_50", "canary_50": "production"}
DWELL_HOURS = {"shadow": 6, "canary_5": 24, "canary_25": 12, "canary_50": 12}


def gate(rows: DataFrame) -> DataFrame:
    """Adds action, reason and next state to rows (state, hours_in_state, drift, override, calibration)."""
    drift, over, cal = (F.coalesce(c, F.lit(0.0)) for c in ("drift", "override", "calibration"))
    path = F.create_map(*[F.lit(x) for kv in PATH.items() for x in kv])
    dwell = F.create_map(*[F.lit(x) for kv in DWELL_HOURS.items() for x in kv])
    nxt = F.try_element_at(path, F.col("state"))

    def verdict(action: str, reason: str) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))

    v = (
        F.when(F.col("state") == "rolled_back", verdict("hold", "rolled back"))
        .when(drift > 0.75, verdict("rollback", "drift")).when(over > 0.12, verdict("rollback", "overrides")).when(cal > 0.15, verdict("rollback", "calibration"))
        .when(nxt.isNull(), verdict("hold", "end of path"))
        .when(F.col("hours_in_state") < F.try_element_at(dwell, F.col("state")), verdict("hold", "dwell"))
        .when(drift >= 0.5, verdict("hold", "drift warning"))
        .otherwise(verdict("promote", "ready"))
    )
    out = rows.select(*rows.columns, v.alias("verdict")).select(*rows.columns, "verdict.*")
    return out.withColumn("next_state", F.when(F.col("action") == "promote", nxt).when(F.col("action") == "rollback", "rolled_back").otherwise(F.col("state")))


def agreement(a_label: Column, b_label: Column, a_score: Column, b_score: Column) -> Column:
    return F.when(a_label.isNotNull() & b_label.isNotNull(), a_label == b_label).when(a_score.isNotNull() & b_score.isNotNull(), F.abs(a_score - b_score) < 0.1).otherwise(True)


def readiness(rows: DataFrame) -> DataFrame:
    """One row of comparisons (agree: boolean, drift): promote, hold or block."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("agree").cast("double")).alias("agreement"), F.avg(F.when(F.col("drift") >= 0.5, (~F.col("agree")).cast("double"))).alias("high_drift_disagreement"))
    action = F.when(F.col("n") == 0, "hold").when(F.col("high_drift_disagreement") > 0.25, "block").when(F.col("agreement") < 0.95, "hold").otherwise("promote")
    return r.withColumn("action", action)


def retrain(rows: DataFrame, base_override: float) -> DataFrame:
    """Adds action and priority to rows (architecture_changed, drift_status, override, age_days)."""
    over = F.coalesce("override", F.lit(0.0))
    a = (
        F.when(F.coalesce("architecture_changed", F.lit(False)), F.struct(F.lit("full_retrain").alias("action"), F.lit("critical").alias("priority")))
        .when(F.col("drift_status") == "critical", F.struct(F.lit("phase3_finetune").alias("action"), F.lit("high").alias("priority")))
        .when((over >= 2 * base_override) & (over > 0), F.struct(F.lit("targeted_finetune").alias("action"), F.lit("medium").alias("priority")))
        .when(F.coalesce("age_days", F.lit(0)) > 21, F.struct(F.lit("scheduled_retrain").alias("action"), F.lit("low").alias("priority")))
        .otherwise(F.struct(F.lit("none").alias("action"), F.lit("low").alias("priority")))
    )
    return rows.withColumn("_a", a).select(*rows.columns, "_a.*")


def transitions(events: DataFrame) -> DataFrame:
    """Dwell of each state: events (version, seq, state, ts) get entered, left and hours."""
    from pyspark.sql import Window

    w = Window.partitionBy("version").orderBy("seq")
    left = F.lead("ts").over(w)
    return events.withColumn("left_at", left).withColumn("hours", (F.unix_timestamp(left) - F.unix_timestamp("ts")) / 3600.0)


def transition_log(steps: DataFrame) -> DataFrame:
    """(version, state, entered_at, pending): each deployment as its log tells. steps: (version, seq, ts, target, status: begin or complete).

    A transition is written before it is made: the state is the target of the last completed one (shadow if there is none), and one that
    was begun since is pending.
    """
    last = lambda status: F.max(F.when(F.col("status") == status, F.struct("seq", "ts", "target")))
    s = steps.groupBy("version").agg(last("begin").alias("b"), last("complete").alias("c"))
    open_ = F.col("b").isNotNull() & (F.col("c").isNull() | (F.col("b.seq") > F.col("c.seq")))
    return s.select("version", F.coalesce("c.target", F.lit("shadow")).alias("state"), F.col("c.ts").alias("entered_at"), F.when(open_, F.col("b.target")).alias("pending"))


CRITICAL, WARNING = 0.75, 0.5


def compatibility(pairs: DataFrame, models: DataFrame, contexts: DataFrame) -> DataFrame:
    """(model, context, compatible, severity, reason) of pairs (model, context). An unknown version is an error.

    models: (model, allowed); contexts: (context, gnn, score): the drift between the model's training and the context. The allow-list comes first.
    """
    known = lambda c, found: F.when(found.isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {c} "), F.coalesce(F.col(c).cast("string"), F.lit("null")))))
    j = pairs.select("model", "context").join(models.select("model", "allowed"), "model", "left").join(contexts.select("context", "gnn", "score"), "context", "left")
    fits = F.array_contains("allowed", F.col("gnn"))
    severity = F.when(~fits | (F.col("score") >= CRITICAL), "critical").when(F.col("score") >= WARNING, "warning").otherwise("healthy")
    reason = F.when(~fits, F.concat(F.lit("architecture "), F.col("gnn").cast("string"), F.lit(" isn't allowed"))).otherwise(F.concat(F.lit("drift "), F.format_string("%.3f", F.col("score"))))
    return j.select(known("model", F.col("allowed")).alias("model"), known("context", F.col("gnn")).alias("context"), (severity != "critical").alias("compatible"), severity.alias("severity"), reason.alias("reason"))


# Modules that a phase trains, and its learning rate.
OPTIMIZERS = ((1, ("projections",), 1e-3), (2, ("projections", "cross_attention", "reasoning", "modality_dropout"), 5e-4), (3, ("all",), 1e-4))


def optimizer_configs(phases_: DataFrame) -> DataFrame:
    """Adds the modules that are trained and the learning rate to rows (phase)."""
    table = phases_.sparkSession.createDataFrame([(p, list(m), r) for p, m, r in OPTIMIZERS], "phase int, unfrozen_modules array<string>, learning_rate double")
    return phases_.join(F.broadcast(table), "phase")


def compatible(models: DataFrame, contexts: DataFrame) -> DataFrame:
    """(model, context, status): allowed architectures, then drift. models: (model, allowed); contexts: (context, gnn, score, seq)."""
    j = models.join(contexts, F.array_contains("allowed", F.col("gnn")), "left")
    status = F.when(F.col("context").isNull(), "incompatible").when(F.col("score") >= 0.75, "incompatible").when(F.col("score") >= 0.5, "warning").otherwise("healthy")
    return j.withColumn("status", status)


def latest_compatible(models: DataFrame, contexts: DataFrame) -> DataFrame:
    """(model, context): the most recently registered context that passes; a context registered again counts anew."""
    last = contexts.groupBy("context").agg(F.max_by(F.struct("gnn", "score", "seq"), "seq").alias("c")).select("context", "c.*")
    ok = compatible(models, last).where("status <> 'incompatible'")
    return models.select("model").join(ok.groupBy("model").agg(F.max_by("context", "seq").alias("context")), "model", "left")


def curriculum(epochs: DataFrame) -> DataFrame:
    """Tier weights of rows (epoch)."""
    s = lambda x: 1 / (1 + F.exp(-x))
    e = F.col("epoch").cast("double")
    t = {"tier1": s(0.5 * (5 - e)), "tier2": F.greatest(F.lit(0.0), s(0.5 * (e - 5)) - s(0.5 * (e - 16))), "tier3": s(0.5 * (e - 14))}
    whole = t["tier1"] + t["tier2"] + t["tier3"]
    return epochs.select("epoch", *[(v / whole).alias(k) for k, v in t.items()])


def tier_counts(weights: DataFrame, batch: int) -> DataFrame:
    """Half-even counts; what is missing or over goes to the heaviest tier (the first of equals)."""
    tiers = ("tier1", "tier2", "tier3")
    n = {t: F.rint(F.col(t) * batch).cast("int") for t in tiers}
    rest = F.lit(batch) - (n["tier1"] + n["tier2"] + n["tier3"])
    top = F.greatest(*tiers)
    heaviest = F.when(F.col("tier1") == top, "tier1").when(F.col("tier2") == top, "tier2").otherwise("tier3")
    return weights.select("epoch", *[(n[t] + F.when(heaviest == t, rest).otherwise(0)).alias(f"n_{t}") for t in tiers])


def sample_with_replacement(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of (seq: 0..size-1, ...) drawn by a hash, the same for the same seed."""
    size = rows.count()
    if not size and n:
        raise ValueError("an empty tier can't be sampled")
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(size, 1))).alias("seq"))
    return draws.join(rows, "seq")


def phases(epochs: DataFrame, patience: int = 3, margin: float = 1e-6) -> DataFrame:
    """(run, epoch, phase) by an ordered fold per run over (run, epoch, loss, grad, gate_variance)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        phase, best, since, out = 1, None, 0, []
        for r in pdf.sort_values("epoch").itertuples():
            if best is None or r.loss < best - margin:
                best, since = r.loss, 0
            else:
                since += 1
            if (phase == 1 and since >= patience and r.grad < 0.1) or (phase == 2 and r.gate_variance > 0.15):
                phase, best, since = phase + 1, None, 0
            out.append((r.run, r.epoch, phase))
        return pd.DataFrame(out, columns=["run", "epoch", "phase"])

    return epochs.groupBy("run").applyInPandas(fold, "run long, epoch long, phase int")


def track_sync(events: DataFrame) -> DataFrame:
    """Per line of events (track, seq, kind, version, gnn, allowed), in order: the active model and context, and the architectures pruned.

    A context replaces the one parked for its architecture, and is deployed if the active model allows it. A promoted model takes the newest
    registered context that it allows, or none, and the parked ones it doesn't allow go. A worker holds one entry per architecture.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, allowed, context = None, [], None
        newest: dict[str, tuple[int, str]] = {}
        parked: set[str] = set()
        for pdf in batches:
            out = []
            for r in zip(*(pdf[c] for c in ("seq", "kind", "version", "gnn", "allowed")), strict=True):
                seq, kind, version, gnn, own = r
                pruned: list[str] = []
                if kind == "context":
                    newest[gnn] = (seq, version)
                    parked.add(gnn)
                    if model is not None and gnn in allowed:
                        context = version
                else:
                    model, allowed = version, list(own if own is not None else [])
                    context = max((newest[g] for g in allowed if g in newest), default=(0, None))[1]
                    pruned = sorted(parked - set(allowed))
                    parked &= set(allowed)
                out.append((key[0], seq, model, context, "none" if model is None else "parked" if context is None else "deployed", ",".join(pruned)))
            yield pd.DataFrame(out, columns=["track", "seq", "model", "context", "status", "pruned"])

    return events.groupBy("track").applyInPandas(_sorted(fold, "seq"), "track string, seq long, model string, context string, status string, pruned string")


def _sorted(fold, order: str):
    """A fold over one key's rows in order, in pieces."""

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.concat(list(fold(key, (pdf.iloc[i : i + 10_000] for i in range(0, len(pdf), 10_000)))), ignore_index=True)

    return work


def pruned_tracks(tracks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Tracks (gnn, context) whose architecture isn't allowed (gnn)."""
    return tracks.join(allowed.select("gnn").distinct(), "gnn", "left_anti")
