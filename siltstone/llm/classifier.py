"""Operator 9, quality classifier: supervised subword embeddings.

Words, pairs of words and runs of 3, 4 and 5 characters inside words are hashed to ``2**BITS`` rows of an embedding matrix. A
document is the average of its rows; a softmax layer over the average gives the class. Both are trained by stochastic
gradient descent in numpy on the driver, over at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of
their id (a bounded sample, cut again after the join, as ids may repeat; the features of a row are at most ``2**BITS`` numbers). As averaging is linear, the trained
model needs one number per bucket to score: (output weight of class 1 less that of class 0) times the embedding.
That table goes out by broadcast and every document is scored whole, in one pass without a shuffle.

Defined cases: a null or empty text has no features, its score is that of the bias; null labels are not learnt from;
an id that repeats gives one example per pair of document and label, within the same bound, and one result per row; ids that aren't whole
numbers count as null: not learnt from and not held out; without labelled rows every score is 0.5; an empty table gives no rows; very long
texts are scored whole; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.columns import pick, whole
from siltstone.llm import bytescan as bs
from siltstone.scratch import ready_workers

BITS, DIM = 17, 16
RUNS = (3, 4, 5)
TRAIN_ROWS, EPOCHS, RATE, SEED = 4000, 5, 0.2, 5
FOLDS, CUT = 5, 0.3


def held_out(doc_id: str | Column) -> Column:
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % FOLDS == 0


def features(s: bs.Scan, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of each word, each pair of words, and each run of characters inside a word (of more than the run, else it is the word).

    A pair is hashed by the difference of its words' hashes, so pairs of equal words share a bucket, which is learned like any other.
    """
    shift = bs.U(64 - bits)
    yield s.doc, (s.hash >> shift).astype(np.int64)
    first, _ = s.windows(2)
    yield s.doc[first], (bs.mix(s.hash[first + 1] - s.hash[first]) >> shift).astype(np.int64)
    at = np.flatnonzero(bs.FIRST_BYTE[s.data] & ~bs.SEPARATOR[s.data])  # characters of words; a word's are neighbours
    word = np.searchsorted(s.starts, at, side="right") - 1
    ends = np.append(at[1:], 0)
    last = np.flatnonzero(np.append(word[1:] != word[:-1], True)) if len(at) else np.zeros(0, np.int64)
    ends[last] = s.ends[word[last]]
    size = np.bincount(word, minlength=len(s.starts))
    for n in RUNS:
        i = np.flatnonzero(word[: len(at) - n + 1] == word[n - 1 :]) if len(at) >= n else np.zeros(0, np.int64)
        i = i[size[word[i]] > n]
        yield s.doc[word[i]], (bs.mix(s.span_hash(at[i], ends[i + n - 1]) ^ bs.PLACES[5]) >> shift).astype(np.int64)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Examples: buckets, counts, class. Returns each bucket's share of the log odds of class 1, and the bias.

    A step is scaled by the squared length of the averaging weights, so that it moves a long document's
    average as far as a short one's.
    """
    rng = np.random.default_rng(SEED)
    embed = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.5, (2, dim)).astype(np.float32), np.zeros(2, np.float32)
    total = epochs * len(examples)
    for step in range(total):
        if step % len(examples) == 0:
            order = rng.permutation(len(examples))
        buckets, n, y = examples[order[step % len(examples)]]
        lr = rate * (1 - step / total)
        if len(buckets):
            share = (n / n.sum()).astype(np.float32)
            x = share @ embed[buckets]
        else:
            share, x = None, np.zeros(dim, np.float32)
        z = out @ x + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        if share is not None:
            embed[buckets] -= np.outer(share * (lr / (share @ share)), p @ out)
        out -= lr * np.outer(p, x)
        bias -= 0.1 * lr * p
    return (embed @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def examples(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    known = pick(labels, id=doc_id, y=label).select(whole(F.col("id")).alias("id"), F.col("y").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    sample = known.where(~held_out("id")).orderBy(F.xxhash64("id"), "id", "y").limit(rows)  # bounded by rows, so it may be broadcast
    picked = pick(docs, doc=doc_id, text=text).select(whole(F.col("doc")).alias("id"), "text").join(F.broadcast(sample), "id").select("id", "y", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, d, o in bs.slices(*bs.text_bytes(batch.column(2))):
                found = list(features(bs.scan(d, o)))
                row = np.concatenate([f[0] for f in found])
                key, n = np.unique(row << 32 | np.concatenate([f[1] for f in found]), return_counts=True)
                cut = np.searchsorted(key, np.arange(1, j - i) << 32)
                blobs = [b.astype(np.uint32).tobytes() for b in np.split(key & 0xFFFFFFFF, cut)], [b.astype(np.uint32).tobytes() for b in np.split(n, cut)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], *[pa.array(b, pa.binary()) for b in blobs]], ["id", "y", "buckets", "n"])

    found = picked.mapInArrow(extract, "id long, y int, buckets binary, n binary")
    got = found.orderBy(F.xxhash64("id"), "id", "y", "buckets", "n").limit(rows).collect()
    got.sort(key=lambda r: (r.id, r.y, bytes(r.buckets), bytes(r.n)))
    return [(np.frombuffer(r.buckets, np.uint32), np.frombuffer(r.n, np.uint32), r.y) for r in got]


def quality_classifier(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS, cut: float = CUT) -> DataFrame:
    """One row per document: its id, whether it is held out from learning, ``score`` and ``predicted``."""
    ready_workers(docs.sparkSession)
    known = examples(docs, labels, text, doc_id, label, rows)
    weights, bias = train(known) if known else (np.zeros(1 << BITS, np.float32), 0.0)
    table = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for _, _, d, o in bs.slices(*bs.text_bytes(batch.column(2))):
                s = bs.scan(d, o)
                total, n = np.zeros(s.n), np.zeros(s.n)
                for row, bucket in features(s):
                    total += np.bincount(row, weights=table.value[bucket], minlength=s.n)
                    n += np.bincount(row, minlength=s.n)
                parts.append(1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -40, 40))))
            p = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    ids = whole(F.col("doc_id"))
    return pick(docs, doc_id=doc_id, text=text).select(ids.alias("doc_id"), F.coalesce(held_out(ids), F.lit(False)).alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
