"""Operator 6, sharding: vector bin packing of bytes, tokens and rows.

Law ``bytes``: the shards' sizes are near equal. Rows of equal text form a group, which goes whole to one shard unless it is
larger than ``SPLIT`` of a shard's fair share in some dimension and has ``SPLIT_ROWS`` rows at least; then it is dealt in parts.
Groups of ``HEAVY`` of a fair share or more are placed one by one: they are few, whatever the table's size. The other groups are
placed in bundles of whole groups, chosen by a hash of the text; (bytes, tokens, rows) are summed before any shuffle.
These units, a number bounded by parameters, are placed on the driver, the heaviest first, each on the shard where the dot
product of its demand with the residual capacity, both relative to a shard's fair share, is highest; a last pass
moves units from the fullest to the emptiest shard, or exchanges two, while that brings their bytes closer and neither tokens nor rows
beyond ``SLACK`` of the fair share or what they were. Slots are salted ranks.

Defined cases: a null text counts no bytes and no tokens and is the group of null texts; an empty table gives no rows; ids may
be null (as are those that aren't whole numbers) or repeat: rows equal in id and text are interchangeable; a text of more than a fair share has its shard nearly alone; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.columns import pick, whole
from siltstone.ranks import salted_rank
from siltstone.scratch import Scratch

SHARDS, OVERHEAD = 24, 8
BUNDLES = 1 << 14
#: Parts of a shard's fair share: groups placed alone, groups dealt in parts, and the parts' size.
HEAVY, SPLIT, PART = 1 / 256, 1 / 2, 1 / 16
SPLIT_ROWS, SLACK = 8, 0.01
#: Shards whose bytes differ by less than this part of a fair share are near equal.
CLOSE = 0.002
WORD = r"[^\x20\x09-\x0D]+"


def place(demand: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of ``demand`` (units x dimensions, bytes first)."""
    total = demand.sum(axis=0)
    d = demand / np.where(total > 0, total / shards, 1)
    left = np.ones((shards, demand.shape[1]))
    at = np.zeros(len(d), np.int64)
    for i in np.lexsort((np.arange(len(d)), -d.max(axis=1))):
        s = int(np.argmax(left @ d[i]))
        at[i] = s
        left[s] -= d[i]
    load = 1 - left
    for _ in range(40 * shards):
        a, b = int(load[:, 0].argmax()), int(load[:, 0].argmin())
        own = np.flatnonzero(at == a)
        gap = load[a, 0] - load[b, 0]
        limit = np.maximum(np.maximum(load[a], load[b]), 1 + SLACK)
        fit = own[(d[own, 0] > 0) & (d[own, 0] < gap) & (load[b] + d[own] <= limit)[:, 1:].all(axis=1)]
        if len(fit):
            i = fit[np.argmin(np.abs(d[fit, 0] - gap / 2))]
            moved = d[i]
            at[i] = b
        else:  # no unit is small enough: two are exchanged
            if gap < CLOSE or not len(own):
                break
            other = np.flatnonzero(at == b)
            less = d[own, 0][:, None] - d[other, 0][None, :]
            best = np.argsort(np.abs(less - gap / 2), axis=None)[:50]
            pairs = [(own[x], other[y]) for x, y in zip(*np.unravel_index(best, less.shape), strict=True)] if less.size else []
            pairs = [(i, j) for i, j in pairs if 0 < d[i, 0] - d[j, 0] < gap and (load[b] + d[i] - d[j] <= limit)[1:].all() and (load[a] - d[i] + d[j] <= limit)[1:].all()]
            if not pairs:
                break
            i, j = pairs[0]
            moved = d[i] - d[j]
            at[i], at[j] = b, a
        load[a] -= moved
        load[b] += moved
    return at


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    body = F.coalesce("text", F.lit(""))
    narrow = pick(docs, doc_id=doc_id, text=text).select(
        whole(F.col("doc_id")).alias("doc_id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("tokens"), F.xxhash64(F.col("text").isNull(), body).alias("group"), F.monotonically_increasing_id().alias("uid"),
    )
    narrow = scratch.save(narrow)
    dims = ("size", "tokens", "rows")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    fair = [float(x or 0) / shards for x in narrow.agg(*sums).first()]
    share = F.greatest(*[F.col(c) / F.lit(f or 1.0) for c, f in zip(dims, fair, strict=True)])
    # each holds HEAVY of a shard in some dimension, so there are at most 3 * shards / HEAVY
    heavy = [(r.group, r.rows, r.share) for r in narrow.groupBy("group").agg(*sums).withColumn("share", share).where(F.col("share") >= HEAVY).select("group", "rows", "share").collect()]
    parts = [(g, int(np.ceil(s / PART)) if s > SPLIT and n >= SPLIT_ROWS else 1) for g, n, s in heavy]
    alone = spark.createDataFrame(parts, "group long, parts int")
    unit = narrow.join(F.broadcast(alone), "group", "left")
    unit = unit.withColumn("unit", F.when(F.col("parts").isNull(), F.pmod("group", F.lit(BUNDLES))).otherwise(F.col("group")))
    unit = unit.withColumn("part", F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("uid"), F.col("parts"))).cast("int"))
    units = sorted(tuple(r) for r in unit.groupBy("unit", "part").agg(*sums).collect())  # bounded by bundles, heavy groups and their parts
    at = place(np.array([u[2:] for u in units], float).reshape(-1, 3), shards)
    plan = spark.createDataFrame([(u[0], u[1], int(s)) for u, s in zip(units, at, strict=True)], "_unit long, _part int, shard int")
    placed = unit.join(F.broadcast(plan), (F.col("unit") == F.col("_unit")) & (F.col("part") == F.col("_part"))).select("doc_id", "size", "text_crc32", "tokens", "uid", "shard")
    return salted_rank(placed, ["shard"], ["doc_id", "text_crc32", "uid"], "slot").drop("uid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
