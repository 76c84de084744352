"""Evaluation and loss metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import vectors as V
from siltstone.ranks import running_sum


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(0.0))


def per_class(rows: DataFrame, classes: int) -> DataFrame:
    """(cls, tp, fp, fn, support, precision, recall, f1) of rows (target, predicted), for every class."""
    pairs = rows.groupBy("target", "predicted").agg(F.count(F.lit(1)).alias("n"))
    c = pairs.withColumn("cls", F.explode(F.array(*[F.lit(i) for i in range(classes)])))
    t, p = F.col("target") == F.col("cls"), F.col("predicted") == F.col("cls")
    s = lambda x: F.sum(F.when(x, F.col("n")).otherwise(0))
    c = c.groupBy("cls").agg(s(t & p).alias("tp"), s(~t & p).alias("fp"), s(t & ~p).alias("fn"), s(t).alias("support"))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(rows: DataFrame, classes: int) -> DataFrame:
    c = per_class(rows, classes)
    return c.agg(ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.sum("support").alias("n"))


def auroc(rows: DataFrame) -> DataFrame:
    """Of rows (score, positive: boolean): Mann-Whitney by average ranks; 0.5 if a class is absent. Ranks run over distinct scores."""
    s = rows.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    u = running_sum(s, "score", "n", "below").withColumn("w", F.col("p") * (F.col("below") + F.col("n") / 2))
    return u.agg(F.when((F.sum("p") > 0) & (F.sum("n") > 0), F.try_divide(F.sum("w"), F.sum("p") * F.sum("n"))).otherwise(0.5).alias("auroc"))


def ece(rows: DataFrame, bins: int = 15) -> DataFrame:
    """Expected calibration error of rows (confidence, correct: boolean) in equal bins; 1.0 falls in the last."""
    b = F.least(F.lit(bins), F.width_bucket("confidence", F.lit(0.0), F.lit(1.0), F.lit(bins)))
    g = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("correct").cast("double")).alias("a"))
    return g.agg(ratio(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))), F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def calibration_gap(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.abs(F.col("confidence") - F.col("correct").cast("double"))).alias("calibration_error"))


def gate_stats(rows: DataFrame) -> DataFrame:
    """Per class of rows (target, gate: array): mean and population variance of all elements, and their number."""
    e = rows.select("target", F.explode("gate").alias("g"))
    return e.groupBy("target").agg(F.avg("g").alias("mean"), F.var_pop("g").alias("variance"), F.count(F.lit(1)).alias("n"))


def gate_overall(rows: DataFrame) -> DataFrame:
    """Of all rows (gate: array): the mean of all elements, and the population variance of the rows' means (0 for one row or none)."""
    r = rows.where(F.size("gate") > 0).select(V.total(F.transform("gate", lambda x: x.cast("double"))).alias("s"), F.size("gate").alias("k"))
    mean = ratio(F.sum("s"), F.sum("k").cast("double"))
    return r.agg(mean.alias("mean"), F.when(F.count(F.lit(1)) > 1, F.var_pop(F.col("s") / F.col("k"))).otherwise(0.0).alias("variance"), F.count(F.lit(1)).alias("n"))


def attention_entropy(rows: DataFrame) -> DataFrame:
    """Of rows (p: array): mean, least and most entropy, mean normalised entropy, part below 0.3."""
    k = F.size("p")
    h = rows.select(V.entropy(F.col("p")).alias("h"), F.when(k > 1, V.entropy(F.col("p")) / F.log(F.greatest(k, F.lit(2)).cast("double"))).otherwise(1.0).alias("u"))
    return h.agg(F.avg("h").alias("mean"), F.min("h").alias("least"), F.max("h").alias("most"), F.avg("u").alias("normalized"), F.avg((F.col("u") < 0.3).cast("double")).alias("collapsed"))


def focal(p_true: Column, weight: Column, gamma: float = 2.0) -> Column:
    """Mean of (1 - p)**gamma * -ln p * weight."""
    return F.avg(F.pow(1 - p_true, F.lit(gamma)) * -F.log(p_true) * weight)


def gate_bce(gate: Column, target: Column) -> Column:
    g = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), gate))
    return F.avg(-(target * F.log(g) + (1 - target) * F.log(1 - g)))


def symmetric_kl(p: Column, q: Column, scale: float = 0.1) -> Column:
    """Row mean of KL(p, q) + KL(q, p), scaled."""
    terms = F.zip_with(p, q, lambda a, b: (a - b) * (F.log(F.greatest(a, F.lit(1e-12))) - F.log(F.greatest(b, F.lit(1e-12)))))
    return F.avg(V.total(terms)) * F.lit(scale)


def two_gates(t_gate: Column, v_gate: Column) -> Column:
    """Half the sum of the two gates' means per row."""
    mean = lambda g: V.total(F.transform(g, lambda x: x.cast("double"))) / F.size(g)
    return 0.5 * (mean(t_gate) + mean(v_gate))


def phased_loss(rows: DataFrame, phase: int, class_weights: list[float], gate_targets: list[float], gamma: float = 2.0, scale: float = 0.1, gate_weight: float = 1.0) -> DataFrame:
    """One row (phase, loss) over rows (target, probs, and for later phases t_gate, v_gate; alt_probs).

    Phase 1 is cross-entropy weighted by class, 2 focal loss and the gates' loss, 3 that and consistency with another snapshot.
    """
    needed = {1: (), 2: ("t_gate", "v_gate"), 3: ("t_gate", "v_gate", "alt_probs")}
    if phase not in needed:
        raise ValueError(f"unknown phase {phase}")
    missing = [c for c in needed[phase] if c not in rows.columns]
    if missing:
        raise ValueError(f"phase {phase} needs {', '.join(missing)}")
    of_class = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("target") + 1)
    p, w = F.element_at("probs", F.col("target") + 1), of_class(class_weights)
    if phase == 1:
        loss = F.sum(-F.log(p) * w) / F.sum(w)
    else:
        loss = focal(p, w, gamma) + gate_weight * gate_bce(two_gates(F.col("t_gate"), F.col("v_gate")), of_class(gate_targets))
        if phase == 3:
            loss = loss + symmetric_kl(F.col("probs"), F.col("alt_probs"), scale)
    return rows.agg(F.lit(phase).alias("phase"), loss.alias("loss"))
