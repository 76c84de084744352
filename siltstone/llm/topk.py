"""Operator 4, exact top-k search by no-random-access aggregation (NRA).

Candidates are packed in blocks; a block keeps one list per dimension, its rows sorted by that component. For a query,
each list is read from the end that adds most to its inner product, all lists to the same depth. At a depth, a row's
lower bound is what was read of it plus the least that unread lists can add, its upper bound the same with each list's
value at that depth, and rows never met are bounded by the sum of those values. Reading stops for a query when no row that was
met in no list can reach the k-th lower bound; the scores of the met rows whose upper bound reaches it are then resolved. Bounds for all
queries of a block of queries are evaluated together, as products of masked matrices.

Blocks of queries meet blocks of candidates on a grid of about ``TASKS`` cells per shuffle partition: rows of the grid hold parts of the
candidates, columns parts of the queries, in numbers that keep the copies few. A hot vector or a common value is one row among a
block's. The best k of each pair of blocks are merged per query.

Scores are integer inner products of floor(scale * x), exact as long as sums stay below 2**53.

Defined cases: vectors that are null, hold null or non-finite components, or have no id take no part; only vectors of a query's
own length are its candidates; rows with the query's id are never its candidates, and equal rows of a query are asked once (of
different vectors under one query id the smallest is asked); repeated candidates each take a place; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.scratch import Scratch

K, SCALE = 10, 1024
BLOCK, QUERY_BLOCK = 4096, 1024
#: Parts of a list that are read before bounds are compared again.
DEPTHS = (0.25, 0.5, 0.625, 0.75, 0.875, 1.0)
#: Pairs resolved at once.
PAIRS = 1 << 15
TASKS = 2


def _integers(column: pa.Array, scale: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rows whose vector takes part, by length: row numbers and floor(scale * x) as doubles that hold integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    start = column.offsets.to_numpy()[:-1]
    values = column.values
    x = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    valid = np.asarray(column.is_valid())
    out = {}
    for n in np.unique(lengths[valid & (lengths > 0)]):
        rows = np.flatnonzero(valid & (lengths == n))
        m = x[start[rows][:, None] + np.arange(n)]
        fine = np.isfinite(m).all(axis=1)
        out[int(n)] = (rows[fine], np.floor(scale * m[fine]))
    return lengths, out


def _pack(size: int, scale: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy()
            for n, (rows, m) in _integers(batch.column(1), scale)[1].items():
                keep = known[rows]
                rows, m = rows[keep], m[keep]
                for i in range(0, len(rows), size):
                    blob = m[i : i + size].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([ids[rows[i : i + size]].tobytes()], pa.binary()), pa.array([blob], pa.binary())], ["dim", "ids", "vectors"])

    return pack


def nra(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """(query, rows, scores, depth) of each query's best k rows of a block, and others that could have been; ``depth`` is the part of the lists that was read."""
    n, dim = vectors.shape
    order = np.argsort(-vectors, axis=0, kind="stable")
    lists = np.take_along_axis(vectors, order, axis=0)  # each from largest to smallest
    place = np.empty((n, dim), np.int32)
    np.put_along_axis(place, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
    down, up = np.maximum(queries, 0), np.minimum(queries, 0)  # read from the top, from the bottom
    waiting = np.arange(len(queries))
    for part in DEPTHS:
        depth = max(1, int(np.ceil(part * n)))
        d, u = down[waiting], up[waiting]
        if depth >= n:
            low = high = vectors @ (d + u).T
            beyond = np.full(len(waiting), -np.inf)
        else:
            from_top, from_bottom = place < depth, place >= n - depth
            seen = np.where(from_top, vectors, 0.0) @ d.T + np.where(from_bottom, vectors, 0.0) @ u.T
            t_top, t_bottom = lists[depth - 1], lists[n - depth]
            not_top, not_bottom = (~from_top).astype(float), (~from_bottom).astype(float)
            low = seen + not_top @ (d * lists[-1]).T + not_bottom @ (u * lists[0]).T
            high = seen + not_top @ (d * t_top).T + not_bottom @ (u * t_bottom).T
            beyond = d @ t_top + u @ t_bottom  # what a row met in no list can reach
        own = ids[:, None] == q_ids[waiting][None, :]
        low, high = np.where(own, -np.inf, low), np.where(own, -np.inf, high)
        if n > k:
            kth = np.partition(low, n - k, axis=0)[n - k]
        else:
            kth = np.full(len(waiting), -np.inf)
        done = kth > beyond if depth < n else np.ones(len(waiting), bool)
        at = np.flatnonzero(done)
        which, rows = np.nonzero(((high >= kth[None, :]) & ~own)[:, at].T)
        scores = np.zeros(len(rows))
        for i in range(0, len(rows), PAIRS):
            scores[i : i + PAIRS] = np.einsum("ij,ij->i", vectors[rows[i : i + PAIRS]], queries[waiting[at[which[i : i + PAIRS]]]])
        cuts = np.searchsorted(which, np.arange(len(at) + 1))
        for q, i, j in zip(waiting[at].tolist(), cuts[:-1], cuts[1:], strict=True):
            yield q, rows[i:j], scores[i:j], part
        waiting = waiting[~done]
        if not len(waiting):
            return


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, q_ids, q, ids, v in zip(*batch.columns, strict=True):
                dim = dim.as_py()
                q_ids, ids = np.frombuffer(q_ids.as_py(), np.int64), np.frombuffer(ids.as_py(), np.int64)
                found = [[], [], []]
                for at, rows, scores, _ in nra(np.frombuffer(q.as_py()).reshape(-1, dim), q_ids, np.frombuffer(v.as_py()).reshape(-1, dim), ids, k):
                    best = np.lexsort((ids[rows], -scores))[:k]
                    found[0].append(np.full(len(best), q_ids[at]))
                    found[1].append(ids[rows[best]])
                    found[2].append(scores[best].astype(np.int64))
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], ["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates, ties to the smaller id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    kind = "dim int, ids binary, vectors binary"
    blocks = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(_pack(BLOCK, scale), kind)
    asked = queries.where(F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    asked = asked.groupBy(F.col(vec_id).cast("long").alias("id")).agg(F.min(F.col(embedding).cast("array<double>")).alias("v"))
    asked = scratch.save(asked.mapInArrow(_pack(QUERY_BLOCK, scale), kind))
    tasks, asking, blocks_n = TASKS * int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, asked.count()), 1 + vectors.count() // BLOCK
    high = min(tasks, blocks_n, max(1, round((tasks * blocks_n / asking) ** 0.5)))  # rows of the grid; the queries are copied so often
    wide = min(asking, -(-tasks // high))  # its columns; the candidates are copied so often
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    right = asked.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), cell("ids", wide).alias("q_column"), every(high).alias("q_row"))
    left = blocks.withColumn("row", cell("ids", high)).withColumn("column", every(wide))
    pairs = left.join(right, (F.col("row") == F.col("q_row")) & (F.col("column") == F.col("q_column")) & (F.col("dim") == F.col("q_dim"))).select("dim", "q_ids", "q", "ids", "vectors")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
