"""Vector context: exact nearest neighbours, pooling, distribution statistics, drift, contradictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import vectors as V
from siltstone.scratch import Scratch, ready_workers

#: Rows of a block of vectors, and of queries that meet a block at once.
BLOCK, QUERY_BLOCK = 4096, 512
TASKS = 2
PACKED = "dim int, ids binary, vectors binary"


def usable(rows: DataFrame) -> DataFrame:
    """(id, embedding) of rows whose vector is there, of one number at least and without nulls."""
    return rows.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Vectors as blocks of rows of one length: ids and components as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            offsets = column.offsets.to_numpy()
            values, lengths = column.values.to_numpy(), np.diff(offsets)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                for i in range(0, len(at), size):
                    some = at[i : i + size]
                    v = values[offsets[some][:, None] + np.arange(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([ids[some].tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["dim", "ids", "vectors"])

    return usable(rows).mapInArrow(pack, PACKED)


def block_pairs(queries: DataFrame, base: DataFrame, scratch: Scratch) -> DataFrame:
    """Each block of queries with each block of the base of its length, on a grid of cells whose sides keep the copies few."""
    spark = base.sparkSession
    asked = scratch.save(packed(queries, QUERY_BLOCK))
    tasks, asking, blocks = TASKS * int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, asked.count()), 1 + base.count() // BLOCK
    high = min(tasks, blocks, max(1, round((tasks * blocks / asking) ** 0.5)))
    wide = min(asking, -(-tasks // high))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    right = asked.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), cell("ids", wide).alias("q_column"), every(high).alias("q_row"))
    left = packed(base, BLOCK).withColumn("row", cell("ids", high)).withColumn("column", every(wide))
    on = (F.col("row") == F.col("q_row")) & (F.col("column") == F.col("q_column")) & (F.col("dim") == F.col("q_dim"))
    return left.join(right, on).select("dim", "q_ids", "q", "ids", "vectors")


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for dim, q_ids, q, ids, v in zip(*batch.columns, strict=True):
        n = dim.as_py()
        yield np.frombuffer(q_ids.as_py(), np.int64), np.frombuffer(q.as_py()).reshape(-1, n), np.frombuffer(ids.as_py(), np.int64), np.frombuffer(v.as_py()).reshape(-1, n)


def nearest(queries: DataFrame, base: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, node_id, distance, rank): squared L2, ties to the smaller node. Both: (id: long, embedding).

    Blocks of queries meet blocks of the base of their length; each pair keeps its own best k per query. Vectors that are null, empty
    or hold nulls take no part. A product of matrices finds the rows that may be among the best, whose distances are then summed exactly.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, ids, v in _arrays(batch):
                rough = (v**2).sum(axis=1)[None, :] - 2 * (q @ v.T) + (q**2).sum(axis=1)[:, None]
                slack = 1e-9 * (1 + (v**2).sum(axis=1).max() + (q**2).sum(axis=1).max())
                limit = (np.partition(rough, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(q), np.inf)) + slack
                at, row = np.nonzero(rough <= limit[:, None])
                d = ((v[row] - q[at]) ** 2).sum(axis=1)
                order = np.lexsort((ids[row], d, at))
                at, row, d = at[order], row[order], d[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                best = place < k
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at[best]]), pa.array(ids[row[best]]), pa.array(d[best])], ["query_id", "node_id", "distance"])

    ready_workers(base.sparkSession)
    found = block_pairs(queries, base, Scratch(base.sparkSession, "nearest")).mapInArrow(local, "query_id long, node_id long, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "node_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def pool(rows: DataFrame, keys: list[str], embedding: str = "embedding", weight: Column | None = None) -> DataFrame:
    """Mean, or weighted mean, of the embeddings of each group, as an array in place order."""
    w = weight if weight is not None else F.lit(1.0)
    long = rows.select(*keys, w.alias("_w"), F.posexplode(embedding).alias("_pos", "_x"))
    per = long.groupBy(*keys, "_pos").agg((F.sum(F.col("_w") * F.col("_x").cast("double"))).alias("s"), F.sum("_w").alias("w"))
    value = F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(F.lit(0.0))
    return per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", value.alias("v")))).alias("p")).select(*keys, F.transform("p", lambda x: x["v"]).alias("pooled"))


def stats(rows: DataFrame, keys: list[str], embedding: str = "embedding") -> DataFrame:
    """Per group and place: mean and population deviation; and the norms' mean and deviation."""
    long = rows.select(*keys, F.posexplode(embedding).alias("pos", "x"))
    per = long.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))
    norms = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(V.norm(F.col(embedding))).alias("norm_mean"), F.stddev_pop(V.norm(F.col(embedding))).alias("norm_std"))
    return per.join(norms, keys)


def singular_values(rows: DataFrame, k: int = 10, embedding: str = "embedding") -> list[float]:
    """Largest singular values of the uncentred matrix, from Gram matrices summed over partitions (dim x dim each)."""
    ready_workers(rows.sparkSession)

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = None
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf.e.tolist(), np.float64)
                g = x.T @ x if g is None else g + x.T @ x
        if g is not None:
            yield pd.DataFrame({"i": range(len(g)), "row": list(g)})

    summed = rows.select(F.col(embedding).alias("e")).mapInPandas(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    if not summed:
        return []
    d = max(r.i for r in summed) + 1
    g = np.zeros((d, d))
    for r in summed:
        g[r.i, r.j] = r.x
    return np.sqrt(np.clip(np.linalg.eigvalsh(g)[::-1], 0, None))[:k].tolist()


def drift(train: DataFrame, live: DataFrame, embedding: str = "embedding", minimum: int = 100, zero_is_drift: bool = True) -> DataFrame:
    """One row: marginal, norm, structural, composite, status, dominant. Fewer than ``minimum`` live rows are healthy."""
    a, b = (stats(x.withColumn("_g", F.lit(1)), ["_g"], embedding) for x in (train, live))
    j = a.alias("a").join(b.alias("b"), F.col("a.pos") == F.col("b.pos"))
    both = j.agg(
        F.max(F.abs(F.col("b.mean") - F.col("a.mean")) / F.greatest(F.col("a.std"), F.lit(1e-8))).alias("m"),
        F.first(F.abs(F.col("b.norm_mean") - F.col("a.norm_mean")) / F.greatest(F.col("a.norm_mean"), F.lit(1e-8))).alias("nm"), F.first("b.n").alias("n"),
    )
    s0, s1 = singular_values(train, embedding=embedding), singular_values(live, embedding=embedding)
    n = min(len(s0), len(s1))
    size, gap = float(np.linalg.norm(s0[:n])), float(np.linalg.norm(np.subtract(s0[:n], s1[:n])))
    structural = min(1.0, gap / size) if size > 1e-8 else (1.0 if zero_is_drift and gap > 0 else 0.0)
    enough = F.coalesce(F.col("n"), F.lit(0)) >= minimum
    part = {"marginal": F.least(F.lit(1.0), F.col("m") / 5), "norm": F.least(F.lit(1.0), F.col("nm")), "structural": F.lit(structural)}
    weight = {"marginal": 0.30, "norm": 0.25, "structural": 0.45}
    out = both.select(F.coalesce("n", F.lit(0)).alias("n"), *[F.when(enough, c).otherwise(0.0).alias(k) for k, c in part.items()])
    out = out.withColumn("composite", sum(F.col(k) * w for k, w in weight.items()))
    status = F.when(F.col("composite") >= 0.75, "critical").when(F.col("composite") >= 0.5, "warning").otherwise("healthy")
    return out.withColumn("status", status).withColumn("dominant", F.array_max(F.array(*[F.struct((F.col(k) * w).alias("s"), F.lit(k).alias("k")) for k, w in weight.items()]))["k"])


def contradictions(rows: DataFrame, low: float = 0.4, high: float = 0.7, middle: float = 0.55) -> DataFrame:
    """(id, other, cosine): the other row whose cosine is in [low, high] and nearest to ``middle``; rows: (id: long, embedding).

    Blocks of rows meet blocks of rows; each pair gives one candidate per row at most.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, ids, v in _arrays(batch):
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], v[order]
                cosine = (q @ v.T) / ((np.linalg.norm(q, axis=1)[:, None] + 1e-8) * (np.linalg.norm(v, axis=1)[None, :] + 1e-8))
                gap = np.where((cosine >= low) & (cosine <= high) & (q_ids[:, None] != ids[None, :]), np.abs(cosine - middle), np.inf)
                at = gap.argmin(axis=1)  # the first of equals has the smallest id
                hit = np.flatnonzero(np.isfinite(gap[np.arange(len(q)), at]))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[hit]), pa.array(ids[at[hit]]), pa.array(cosine[hit, at[hit]])], ["id", "other", "cosine"])

    ready_workers(rows.sparkSession)
    found = block_pairs(rows, rows, Scratch(rows.sparkSession, "contradictions")).mapInArrow(local, "id long, other long, cosine double")
    return found.groupBy("id").agg(F.min_by(F.struct("other", "cosine"), F.struct(F.abs(F.col("cosine") - middle), "other")).alias("m")).select("id", "m.*")
