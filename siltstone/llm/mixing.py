"""Operator 5, mixing sources to target weights, with DataFrame functions only.

A source's weight is its token share to the power of an exponent, normalised. The exponent, between 0 (all sources
alike) and 1 (as they are), is found by bisection so that the weights' entropy reaches a target or no source is
repeated more often than a limit. Without a budget the mixture is the smallest that takes every document at least
once: nothing is dropped, rare sources repeat. With a budget of tokens, each source gets its weight of it.

A source's documents are permuted by a hash, afresh for each pass over them, and drawn in that order until the source's
budget is met. Block b of the mixture holds what each source draws between b and b + 1 times its share of a block's tokens,
so every block has the target weights; inside a block, rows are ordered by another hash.

Running token sums inside a source are taken over slices of its hash range: sums per slice first, then inside slices,
so a source with a third of all rows is spread over ``slices`` tasks. Only single numbers reach the driver; the
tables of sources stay tables.

Defined cases: tokens are words, one at least per document, so null and empty texts are drawn too; very long texts count whole; ids that
aren't whole numbers count as null; a null source is a
source of its own; repeated rows are drawn apart in ``mixture`` but share one hash, and so one fate, in ``mix``; an empty
table gives no rows; a target that no exponent between 0 and 1 meets takes the nearest; an entropy target sets no limit to repetition; other
columns, of whatever names, are ignored by ``mixture`` and kept by ``mix``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.columns import numbered, pick, place, whole
from siltstone.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
MAX_PASSES, BLOCK_TOKENS, SEED = 2.0, 1_000_000, 17
#: Exponents tried at once in a round of bisection; four rounds are as sharp as 20 halvings.
SECTIONS, ROUNDS = 32, 4


@dataclass(frozen=True)
class Target:
    """Either ``max_passes`` over the rarest source, or ``entropy`` as a part of the largest possible, ln(sources)."""

    max_passes: float | None = MAX_PASSES
    entropy: float | None = None
    budget_tokens: int | None = None
    block_tokens: int = BLOCK_TOKENS
    seed: int = SEED


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))).cast("long")


def order_hash(source: Column, doc_id: Column, text_hash: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("long"), source, doc_id, text_hash)


def exponent(sources: DataFrame, target: Target) -> float:
    """Sections of [0, 1] are narrowed to the largest exponent that meets the target; sources: (tokens)."""
    total, n, least, most = sources.agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens"), F.max("tokens")).first()
    if not n or n < 2:
        return 1.0
    log_p = F.log(F.col("tokens") / F.lit(float(total)))
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        tries = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        if target.entropy is not None:
            row = sources.agg(*[x for a in tries for x in (F.sum(F.exp(log_p * a)), F.sum(F.exp(log_p * a) * log_p * a))]).first()
            met = [math.log(z) - s / z >= target.entropy * math.log(n) for z, s in zip(row[::2], row[1::2], strict=True)]
        elif target.budget_tokens is not None:
            row = sources.agg(*[F.sum(F.exp(log_p * a)) for a in tries]).first()
            # passes = budget * p**a / sum(p**a) / tokens are most for the rarest source, or for all alike at 1
            met = [target.budget_tokens * (least / total) ** a / z / least <= target.max_passes for a, z in zip(tries, row, strict=True)]
        else:
            met = [(most / least) ** (1 - a) <= target.max_passes for a in tries]
        if target.entropy is not None:  # flatter towards 0: the largest exponent that is flat enough
            k = max((i for i, ok in enumerate(met) if ok), default=0)
            low, high = tries[k], tries[min(k + 1, SECTIONS)]
        else:  # fewer repeats towards 1: the smallest exponent that keeps the limit
            k = min((i for i, ok in enumerate(met) if ok), default=SECTIONS)
            low, high = tries[max(k - 1, 0)], tries[k]
    return low if target.entropy is not None else high


def weights(narrow: DataFrame, target: Target, scratch: Scratch) -> DataFrame:
    """(source, tokens, weight, budget, passes) of each source."""
    sources = scratch.save(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    a = exponent(sources, target)
    total, most = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    power = F.exp(F.log(F.col("tokens") / F.lit(float(total or 1))) * a)
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    if target.budget_tokens is None:
        # the source with the largest share is taken just once
        passes = F.when(F.col("tokens") == F.lit(most or 0), F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.pow(F.lit(float(most or 1)) / F.col("tokens"), F.lit(1.0 - a))))
    else:
        passes = F.lit(float(target.budget_tokens)) * power / F.lit(z) / F.col("tokens")
    return sources.select("source", "tokens", (power / F.lit(z)).alias("weight"), (F.col("tokens") * passes).alias("budget"), passes.alias("passes"))


def _narrow(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    rows = pick(docs, doc_id=doc_id, text=text, source=source)
    return rows.select(whole(F.col("doc_id")).alias("doc_id"), F.col("source").cast("string").alias("source"), tokens(F.col("text")).alias("tokens"), F.xxhash64("text").alias("text_hash"))


def _draws(narrow: DataFrame, w: DataFrame, target: Target, slices: int, last_pass_only: bool = False) -> DataFrame:
    """Each (row, epoch) that begins inside its source's budget, with ``start``, the source's tokens drawn before it."""
    on = F.col("source").eqNullSafe(F.col("_source"))
    per = w.select(F.col("source").alias("_source"), F.col("tokens").alias("_all"), "budget", "passes", "weight")
    last = F.ceil("passes").cast("int")
    first = F.greatest(F.lit(1), last) if last_pass_only else F.lit(1)
    rows = narrow.join(per, on).where("budget > 0").withColumn("epoch", F.explode(F.sequence(first, F.greatest(F.lit(1), last))))
    rows = rows.withColumn("h", order_hash(F.col("source"), F.col("doc_id"), F.col("text_hash"), F.col("epoch"), target.seed))
    rows = rows.withColumn("slice", F.floor((F.shiftrightunsigned("h", 33).cast("double") / float(1 << 31)) * slices).cast("int"))
    unsigned = F.shiftrightunsigned("h", 1)
    sums = rows.groupBy("source", "epoch", "slice").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("epoch").alias("_e"), F.col("slice").alias("_k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "epoch", "slice").orderBy(unsigned, "h", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("slice") == F.col("_k")))
    return rows.withColumn("start", F.col("_before") + F.col("_in") + (F.col("epoch") - 1) * F.col("_all")).where(F.col("start") < F.col("budget"))


def _slices(spark: SparkSession) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixture(docs: DataFrame, target: Target | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per drawn document and pass: doc_id, source, tokens, epoch, block, place (order in the block), weight."""
    target, spark = target or Target(), docs.sparkSession
    scratch = Scratch(spark, "mixing")
    narrow = scratch.save(_narrow(docs, text, doc_id, source))
    w = scratch.save(weights(narrow, target, scratch))
    rows = _draws(narrow, w, target, _slices(spark))
    block = F.floor(F.col("start") / (F.col("weight") * F.lit(float(target.block_tokens)))).cast("long")
    return rows.select("doc_id", "source", "tokens", "epoch", block.alias("block"), F.xxhash64(F.lit(target.seed + 1), "h").alias("place"), "weight")


def mix(docs: DataFrame, target: Target | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source", epoch: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture draws it; ``epoch`` names a column to add that numbers a row's copies from 1.

    Whole passes need no order. Of a source's last, partial pass only the hash at which its budget ends is needed, so the texts
    themselves are read once more and never shuffled.
    """
    target, spark = target or Target(), docs.sparkSession
    scratch = Scratch(spark, "mixing")
    narrow = scratch.save(_narrow(docs, text, doc_id, source))
    w = scratch.save(weights(narrow, target, scratch))
    ends = _draws(narrow, w, target, _slices(spark), last_pass_only=True).groupBy("source", "epoch").agg(F.max(F.shiftrightunsigned("h", 1)).alias("_end"))
    per = w.where("budget > 0").join(ends.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_source"), F.col("epoch").alias("_last"), "_end")
    per = scratch.save(per)
    flat = numbered(docs)
    column = lambda c: F.col(f"_{place(docs, c)}")
    drawn = F.struct(*flat.columns).alias("_row")
    h = order_hash(F.col("_src"), F.col("_id"), F.col("_hash"), F.col("_last"), target.seed)
    rows = flat.select(drawn, column(source).cast("string").alias("_src"), whole(column(doc_id)).alias("_id"), F.xxhash64(column(text)).alias("_hash"))
    rows = rows.join(per, F.col("_src").eqNullSafe(F.col("_source")))
    copies = F.col("_last") - 1 + (F.shiftrightunsigned(h, 1) <= F.col("_end")).cast("int")
    rows = rows.where(copies > 0).select("_row", F.explode(F.sequence(F.lit(1), copies)).alias("_epoch"))
    out = rows.select("_row.*", *(["_epoch"] if epoch else []))
    return out.toDF(*docs.columns, *([epoch] if epoch else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("weight")
