"""Operator 2, quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Two multinomials over ``2**bits`` hashed word uni- and bigrams are counted over every document: one over the rows
whose id is trusted (target), one over all rows (raw corpus). The target is smoothed towards the raw corpus, with
``PRIOR`` occurrences in each bucket that agree with it: where the trusted rows would hold e occurrences of a bucket if
they were like the corpus and hold c, target / raw is (c + PRIOR) / (e + PRIOR). Too little text to tell (a small e)
thus scores about 0 whatever the sizes of the tables and the number of labels. A document's score is the
sum of log(target / raw) over its n-grams divided by their number, and it is kept if it passes the base rules and the
score is at least ``threshold``. Every document is thresholded alike; nothing is drawn at random.

Each task sends one array of counts per multinomial, in ``CHUNKS`` pieces that are added per piece; what reaches the
driver and goes out again is the finished table, ``2**bits`` numbers whatever the input's size. Only ids and flags are joined:
trusted ids are broadcast up to ``BROADCAST_IDS`` rows and joined by a shuffle beyond.

Defined cases: a null or empty text has no words, fails the base rules and scores 0; a very long text is scanned whole; a null id, or
one that isn't a whole number, is never trusted; an empty table gives no rows; an
id that repeats is judged row by row; trusted ids that repeat count once; without trusted rows (or without any rows)
the target is the raw corpus and every score is 0, so only the base rules decide; other columns of the input are
ignored by ``quality_scores`` and passed through by ``quality_filter``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.columns import numbered, pick, place, whole
from siltstone.llm import bytescan as bs
from siltstone.scratch import ready_workers

BITS = 18
CHUNKS = 16
#: Clean text scores about 0; text from shapes that the trusted rows lack scores far below.
THRESHOLD = -0.2
#: Occurrences. An n-gram met once in the corpus and in no trusted row scores log(5 / 6) at least, above the threshold, so that unknown words alone can't reject a text.
PRIOR = 5.0
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
BROADCAST_IDS = 2_000_000
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCORES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean"


def ngrams(s: bs.Scan, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of each word and of each pair of neighbouring words."""
    shift = bs.U(64 - bits)
    yield s.doc, (s.hash >> shift).astype(np.int64)
    first, h = s.windows(2)
    yield s.doc[first], (h >> shift).astype(np.int64)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_trusted_id")).distinct()


def counts(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = BITS) -> np.ndarray:
    """[target, raw] counts of the hashed n-grams over all documents."""
    ready_workers(docs.sparkSession)
    if trusted.count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    marked = pick(docs, id=doc_id, text=text).select(whole(F.col("id")).alias("id"), "text").join(trusted, F.col("id") == F.col("_trusted_id"), "left").select("text", F.col("_trusted_id").isNotNull().alias("is_trusted"))
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, size), np.int64)
        for batch in batches:
            data, offs = bs.text_bytes(batch.column(0))
            flag = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, d, o in bs.slices(data, offs):
                s = bs.scan(d, o)
                for doc, bucket in ngrams(s, bits):
                    found[1] += np.bincount(bucket, minlength=size)
                    found[0] += np.bincount(bucket[flag[i:j][doc]], minlength=size)
        if found[1].any():
            parts = np.split(found, CHUNKS, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([_packed(p) for p in parts], pa.binary())], ["chunk", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size // CHUNKS), np.int64)
        for batch in batches:
            for blob in batch.column("counts"):
                total += _unpacked(blob.as_py(), size // CHUNKS)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    rows = marked.mapInArrow(bs.trimmed(count), schema).groupBy("chunk").applyInArrow(add, schema).collect()
    out = np.zeros((2, size), np.int64)
    for row in rows:
        at = row.chunk * (size // CHUNKS)
        out[:, at : at + size // CHUNKS] = np.frombuffer(row.counts, np.int64).reshape(2, -1)
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Non-zero entries only: places as 32 bits, counts as 64."""
    flat = counts.ravel()
    at = np.flatnonzero(flat)
    return at.astype(np.uint32).tobytes() + flat[at].tobytes()


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    n = len(blob) // 12
    out = np.zeros(2 * width, np.int64)
    out[np.frombuffer(blob, np.uint32, n)] = np.frombuffer(blob, np.int64, n, 4 * n)
    return out.reshape(2, width)


def ratio_table(found: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log(target / raw) of each bucket, smoothed towards the raw corpus; zeros without trusted n-grams."""
    target, raw = found
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log((target + prior) / (expected + prior))


def verdicts(data: np.ndarray, offs: np.ndarray, table: np.ndarray, bits: int, threshold: float) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {k: [] for k in (*METRICS, "llr")}
    for _, _, d, o in bs.slices(data, offs):
        s = bs.scan(d, o)
        for k, v in bs.base_metrics(s, WINDOW).items():
            parts[k].append(v)
        total, n = np.zeros(s.n), np.zeros(s.n)
        for doc, bucket in ngrams(s, bits):
            total += np.bincount(doc, weights=table[bucket], minlength=s.n)
            n += np.bincount(doc, minlength=s.n)
        parts["llr"].append(total / np.maximum(n, 1))
    out = {k: np.concatenate(v) if v else np.zeros(0, np.float64 if k == "llr" else np.int64) for k, v in parts.items()}
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["llr"] >= threshold)
    return out


def quality_scores(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its id, the base counts, the score ``llr``, ``base_failed`` and ``kept``."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(ratio_table(counts(docs, trusted, text, doc_id, bits)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = verdicts(*bs.text_bytes(batch.column(1)), table.value, bits, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v[k]) for k in (*METRICS, "llr", "base_failed", "kept")]], ["doc_id", *METRICS, "llr", "base_failed", "kept"])

    return pick(docs, doc_id=doc_id, text=text).select(whole(F.col("doc_id")).alias("doc_id"), "text").mapInArrow(bs.trimmed(score), SCORES)


def quality_filter(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they had."""
    table = docs.sparkSession.sparkContext.broadcast(ratio_table(counts(docs, trusted, text, doc_id, bits)))
    at = place(docs, text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdicts(*bs.text_bytes(batch.column(at)), table.value, bits, threshold)["kept"]))

    flat = numbered(docs)
    return flat.mapInArrow(bs.trimmed(keep), flat.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_scores(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
