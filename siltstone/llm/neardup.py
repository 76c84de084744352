"""Operator 1, near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Shingles are runs of five words, weighted (1 + ln tf) * idf with idf = 1 + ln(N / df) / ln N, between 1 and 2: common
passages count less. A large group of near copies lowers its members' similarity somewhat, as their shingles are common
just because of the group (figures in the README). Two texts are linked if their weighted Jaccard similarity, sum of
minima over sum of maxima, is at least 0.8; classes are the components of the links.

1. Every slice of texts sends its shingle hashes, packed, to buckets of the hash space. A bucket knows all texts of its shingles,
   so document frequencies are exact over all documents. Shingles of two or more texts go back to the texts' slice. A shingle of
   ``GROUP`` texts of a slice or more is counted there and sent once, with the count; which texts these are goes to the slice directly.
   So a line that all documents share costs its bucket one entry per slice.
2. A shingle of one text adds nothing to a sum of minima, so a text whose shared weight is below 0.8 of its whole
   weight has no partner and is done, with class and result of its own. This bound is exact.
3. Texts of equal words share a digest; one stands for all of them from here on.
4. The others get ICWS signatures (``BANDS`` bands of ``ROWS`` samples). Unshared shingles are left out of the sampling,
   which can only raise the chance that partners meet; similarity is computed with the whole weights.
5. Members of a band are compared with its first member, linked, and joined to components. The members of a leader are dealt to
   blocks of ``MEMBER_BYTES``, each of which gets the leader once. Bands that still hold two
   components are searched whole: their texts are dealt to blocks of ``BLOCK_BYTES``, each pair of blocks computes all its
   similarities as products of matrices, some texts at a time, and sends a spanning forest of the links it finds. So every candidate
   pair is either verified or already in one class, and no pairs are emitted but links that join texts.

6. Classes and their sizes are found per digest and given to the rows by joins whose hot keys are broadcast.

Nothing but counts reaches the driver.

Defined cases: a text without words (null, empty, blank) is alone in its class; a text of one to four words is one
shingle, so it equals only texts of the same words; a very long text is one slice by itself and handled whole; an id may be null or
repeat, and counts as null if it isn't a whole number: rows are told apart, and class ids are the smallest ids in the class (null if it has
none); repeated rows are copies; an empty table gives no rows; other columns, of whatever names, are ignored by ``near_duplicates``
and kept by ``keep_one_of_each``.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.columns import numbered, pick, place, whole
from siltstone.llm import bytescan as bs
from siltstone.operators.components import components
from siltstone.scratch import Scratch
from siltstone.skew import PARTS, join_by_count

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
SLICE = 1 << 21
BROADCAST_ROWS = 2_000_000
BLOCK_BYTES = 1 << 22
#: Numbers of a matrix of similarities at a time. A pair of blocks may hold many short texts.
CELLS = 1 << 20
#: Bytes of a leader's members that are compared with one copy of it.
MEMBER_BYTES = 1 << 18
#: Texts of a slice from which on a shingle is counted in the slice; buckets per shuffle partition, so that their hashes fill tasks evenly, and bytes of text
#: per bucket at most, on average.
GROUP, BUCKETS, BUCKET_BYTES = 4, 8, 1 << 27
U = bs.U
ENTRY = np.dtype([("lo", "<u4"), ("hi", "<u2"), ("row", "<u2")])
SHARED = np.dtype([("lo", "<u4"), ("hi", "<u2"), ("row", "<u2"), ("df", "<u2"), ("tf", "<u4")])
TERM = np.dtype([("lo", "<u4"), ("hi", "<u2"), ("df", "<u2"), ("tf", "<u4")])
ROW = np.dtype([("doc", "<i8"), ("known", "<i8"), ("text", "<i8"), ("d0", "<i8"), ("d1", "<i8"), ("n", "<i8")])
#: A shingle of several texts of a slice, which the slice keeps: its hash and how many places in ``rows`` it has.
LOCAL = np.dtype([("lo", "<u4"), ("hi", "<u2"), ("n", "<u4")])
#: In place of a row: all texts of a slice that hold the shingle. Slices have fewer rows.
MANY = 0xFFFF
DF_STEP = 2048.0
VECTOR = "uid long, doc_id long, text_hash long, d0 long, d1 long, weight double, terms binary"


def _digest(s: bs.Scan) -> np.ndarray:
    """128 bits of each text's sequence of words."""
    out = np.zeros((2, s.n), U)
    first = np.searchsorted(s.doc, np.arange(s.n + 1))
    place = (np.arange(len(s.doc)) - first[s.doc]).astype(U) if len(s.doc) else np.zeros(0, U)
    for k in range(2):
        sums = np.zeros(len(s.doc) + 1, U)
        np.cumsum(bs.mix(s.hash * bs.PLACES[10 + k] + place * bs.PLACES[12 + k]), out=sums[1:])
        out[k] = sums[first[1:]] - sums[first[:-1]]
    return out.view(np.int64)


def _send(buckets: int):
    """Packs the shingles of each slice of texts by bucket; the slice's rows go along as one more message."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId() << 31, 0
        for batch in batches:
            ids = batch.column(0)
            doc_ids, known = ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid())
            hashes = batch.column(2).to_numpy()
            for i, j, d, o in _short_slices(*bs.text_bytes(batch.column(1))):
                slice_id, count = part | count, count + 1
                s = bs.scan(d, o)
                row, h = bs.shingles(s, WORDS)
                table = np.zeros(s.n, ROW)
                table["doc"], table["known"], table["text"] = doc_ids[i:j], known[i:j], hashes[i:j]
                table["d0"], table["d1"] = _digest(s)
                table["n"] = np.bincount(row, minlength=s.n)
                order = np.argsort(h, kind="stable")
                h, row = h[order], row[order]
                new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.r_[new, len(h)])
                other_row = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
                rows = np.add.reduceat(other_row, new, dtype=np.int64) if len(h) else new
                many = rows >= GROUP
                single = ~np.repeat(many, times)
                local = np.empty(int(many.sum()), LOCAL)
                local["lo"], local["hi"], local["n"] = h[new[many]] & U(0xFFFFFFFF), (h[new[many]] >> U(32)) & U(0xFFFF), times[many]
                kept = len(local).to_bytes(8, "little") + local.tobytes() + row[~single].astype("<u2").tobytes()
                # the bucket comes from the hash's high bits, the rest of it from the low 48
                blobs = [_packed(h[single], row[single], buckets), _packed(h[new[many]], rows[many], buckets)]
                full = sorted(set(blobs[0]) | set(blobs[1]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([*full, -1 - slice_id % buckets], pa.int64()), pa.array([slice_id] * (len(full) + 1), pa.int64()),
                    pa.array([*[blobs[0].get(b) for b in full], table.tobytes()], pa.binary()), pa.array([*[blobs[1].get(b) for b in full], kept], pa.binary()),
                ], ["bucket", "slice", "blob", "many"])

    return send


def _packed(h: np.ndarray, row: np.ndarray, buckets: int) -> dict[int, bytes]:
    """Entries of sorted hashes by bucket."""
    entries = np.empty(len(h), ENTRY)
    entries["lo"], entries["hi"], entries["row"] = h & U(0xFFFFFFFF), (h >> U(32)) & U(0xFFFF), row
    cuts = np.searchsorted(((h >> U(40)) * U(buckets) >> U(24)).astype(np.int64), np.arange(buckets + 1))
    return {int(b): entries[cuts[b] : cuts[b + 1]].tobytes() for b in np.flatnonzero(cuts[1:] > cuts[:-1])}


def _short_slices(data: np.ndarray, offs: np.ndarray):
    """Slices of under 65,536 rows."""
    for i, j, d, o in bs.slices(data, offs, SLICE):
        for a in range(0, j - i, 65_535):
            b = min(j - i, a + 65_535)
            yield i + a, i + b, d[o[a] : o[b]], o[a : b + 1] - o[a]


def _count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket: (row, hash, df, tf) of the shingles that two rows or more hold, or one row twice, by slice."""
    names = ["is_row", "slice", "blob", "many"]
    slices, parts, groups = [], [], []
    for batch in batches:
        if key[0].as_py() < 0:
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(batch)), *batch.columns[1:]], names)
            continue
        slices += batch.column(1).to_pylist()
        parts += [np.frombuffer(b.as_py() or b"", ENTRY) for b in batch.column(2)]
        groups += [np.frombuffer(b.as_py() or b"", ENTRY) for b in batch.column(3)]
    if not parts:
        return
    e = np.concatenate([*parts, *groups])
    is_group = np.arange(len(e)) >= sum(map(len, parts))
    where = np.repeat(np.r_[np.arange(len(parts)), np.arange(len(parts))], [*map(len, parts), *map(len, groups)]) << 16 | np.where(is_group, MANY, e["row"])
    rows = np.where(is_group, e["row"], 1)
    h = e["lo"].astype(U) | e["hi"].astype(U) << U(32)
    del e, is_group
    order = np.argsort(h, kind="stable")
    h, where, rows = h[order], where[order], rows[order]
    if np.any((h[1:] == h[:-1]) & (where[1:] < where[:-1])):
        order = np.lexsort((where, h))
        h, where, rows = h[order], where[order], rows[order]
    new_hash = np.r_[True, h[1:] != h[:-1]]
    new = np.flatnonzero(new_hash | np.r_[True, where[1:] != where[:-1]])
    tf = np.diff(np.r_[new, len(h)])
    group = np.cumsum(new_hash[new]) - 1
    df = np.bincount(group, weights=rows[new]).astype(np.int64)[group]
    new = new[(keep := (df > 1) | (tf > 1))]
    out = np.empty(len(new), SHARED)
    out["lo"], out["hi"], out["row"] = h[new] & U(0xFFFFFFFF), h[new] >> U(32), where[new] & 0xFFFF
    out["df"], out["tf"] = np.rint(np.log(df[keep]) * DF_STEP), tf[keep]
    part = where[new] >> 16
    order = np.argsort(part, kind="stable")
    out, cuts = out[order], np.searchsorted(part[order], np.arange(len(parts) + 1))
    full = np.flatnonzero(cuts[1:] > cuts[:-1])
    if len(full):
        yield pa.RecordBatch.from_arrays([pa.array([False] * len(full)), pa.array([slices[k] for k in full], pa.int64()), pa.array([out[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()), pa.nulls(len(full), pa.binary())], names)


def _spread(markers: np.ndarray, kept: bytes) -> np.ndarray:
    """(row, hash, df, tf) of the shingles that the slice counted itself. ``markers`` bring their document frequencies."""
    n = int.from_bytes(kept[:8], "little")
    local = np.frombuffer(kept, LOCAL, n, 8)
    rows = np.frombuffer(kept, "<u2", offset=8 + n * LOCAL.itemsize).astype(np.int64)
    pair, tf = np.unique(np.repeat(np.arange(n), local["n"]) << 16 | rows, return_counts=True)
    group = pair >> 16
    h = lambda x: x["lo"].astype(U) | x["hi"].astype(U) << U(32)
    order = np.argsort(h(markers))
    df = markers["df"][order][np.searchsorted(h(markers)[order], h(local))] if n else np.zeros(0, np.uint16)
    out = np.empty(len(pair), SHARED)
    out["lo"], out["hi"], out["row"], out["df"], out["tf"] = local["lo"][group], local["hi"][group], pair & 0xFFFF, df[group], tf
    return out


def weights(df_code: np.ndarray, tf: np.ndarray, log_n: float) -> np.ndarray:
    return (1 + np.log(tf)) * (1 + np.maximum(0.0, log_n - df_code / DF_STEP) / log_n)


def _gather(log_n: float, similarity: float):
    """Of one slice: a row per text; terms (of shared shingles, sorted) where the text can have a partner."""

    def gather(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, table, kept = [np.zeros(0, SHARED)], np.zeros(0, ROW), bytes(8)
        for batch in batches:
            for is_row, blob, many in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if is_row:
                    table, kept = np.frombuffer(blob.as_py(), ROW), many.as_py()
                else:
                    parts.append(np.frombuffer(blob.as_py(), SHARED))
        e = np.concatenate(parts)
        e = np.concatenate([e[e["row"] != MANY], _spread(e[e["row"] == MANY], kept)])
        h = e["lo"].astype(U) | e["hi"].astype(U) << U(32)
        e = e[np.lexsort((h, e["row"]))]
        w = weights(e["df"], e["tf"].astype(float), log_n)
        n = len(table)
        rest = table["n"] - np.bincount(e["row"], weights=e["tf"], minlength=n)  # shingles of one text, found once
        whole = np.bincount(e["row"], weights=w, minlength=n) + rest * weights(np.zeros(1), np.ones(1), log_n)
        shared = e["df"] > 0
        e, w = e[shared], w[shared]
        may = (table["n"] > 0) & (np.bincount(e["row"], weights=w, minlength=n) >= similarity * whole - 1e-9)
        terms = np.empty(len(e), TERM)
        for name in TERM.names:
            terms[name] = e[name]
        cuts = np.searchsorted(e["row"], np.arange(n + 1))
        first: set[tuple[int, int]] = set()
        blobs: list[bytes | None] = []
        for k in range(n):
            digest = (int(table["d0"][k]), int(table["d1"][k]))
            blobs.append(terms[cuts[k] : cuts[k + 1]].tobytes() if may[k] and digest not in first else None)
            first.add(digest)
        slice_id = key[0].as_py()
        no = ~may
        yield pa.RecordBatch.from_arrays([
            pa.array((slice_id << 16) + np.arange(n)), pa.array(table["doc"], mask=table["known"] == 0), pa.array(table["text"]),
            pa.array(table["d0"], mask=no), pa.array(table["d1"], mask=no), pa.array(whole), pa.array(blobs, pa.binary()),
        ], ["uid", "doc_id", "text_hash", "d0", "d1", "weight", "terms"])

    return gather


def icws(h: np.ndarray, log_w: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """[sample, text] identities of the sampled (shingle, level); ``starts`` are the texts' first terms.

    For sample k, shingle s and weight w, with r and c from Gamma(2, 1) and b uniform, all drawn by a hash of (k, s):
    t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y exp(r)); the shingle of least a is sampled, with its t.
    """
    out = np.empty((samples, len(starts)), U)
    lengths = np.diff(np.r_[starts, len(h)])
    for k in range(samples):
        x = bs.mix(h + U((2 * k + 1) * int(bs.PLACES[14]) % 2**64))
        z = bs.mix(x + bs.PLACES[15])
        u1 = ((x & U(0x1FFFFF)).astype(float) + 0.5) * 2.0**-21
        u2 = ((x >> U(21) & U(0x1FFFFF)).astype(float) + 0.5) * 2.0**-21
        b = ((x >> U(42)).astype(float) + 0.5) * 2.0**-22
        u3 = ((z & U(0xFFFFFFFF)).astype(float) + 0.5) * 2.0**-32
        u4 = ((z >> U(32)).astype(float) + 0.5) * 2.0**-32
        r = -np.log(u1 * u2)
        t = np.floor(log_w / r + b)
        log_a = np.log(-np.log(u3 * u4)) - r * (t - b + 1)
        least = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, starts), lengths))
        at = least[np.searchsorted(least, starts)]
        out[k] = bs.mix(h[at] * bs.PLACES[13] + t[at].astype(np.int64).astype(U))
    return out


def _bands(log_n: float):
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(b.as_py(), TERM) for b in batch.column(1)]
            for i, j in _runs([len(p) for p in parts], 1 << 16):
                e = np.concatenate(parts[i:j])
                lengths = np.array([len(p) for p in parts[i:j]])
                h = bs.mix(e["lo"].astype(U) | e["hi"].astype(U) << U(32))
                got = icws(h, np.log(weights(e["df"], e["tf"].astype(float), log_n)), np.r_[0, np.cumsum(lengths)[:-1]], BANDS * ROWS)
                for b in range(BANDS):
                    key = np.full(j - i, b, U)
                    for k in range(ROWS):
                        key = bs.mix(key + got[b * ROWS + k] * bs.PLACES[k])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)[i:j]], ["band", "uid"])

    return bands


def _runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    i, total = 0, 0
    for j, n in enumerate(sizes):
        if j > i and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


def weighted_jaccard(a: np.ndarray, b: np.ndarray, whole_a: float, whole_b: float, log_n: float) -> float:
    """Of two texts' terms, each sorted by hash, and their whole weights."""
    ha, hb = (x["lo"].astype(U) | x["hi"].astype(U) << U(32) for x in (a, b))
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    both = np.flatnonzero(hb[at] == ha) if len(hb) else np.zeros(0, np.int64)
    least = float(np.minimum(weights(a["df"][both], a["tf"][both].astype(float), log_n), weights(b["df"][at[both]], b["tf"][at[both]].astype(float), log_n)).sum())
    return least / max(whole_a + whole_b - least, 1e-12)


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, log_n: float, similarity: float) -> DataFrame:
    """The pairs (a: leader, b: member) that are similar enough. ``pairs`` has no repeats.

    The members of a leader are dealt to blocks by their bytes, so a leader of many costs a copy per block, and blocks to cells.
    """
    pairs = scratch.save(pairs.join(texts.select(F.col("uid").alias("b"), F.octet_length("terms").alias("bytes")), "b"))
    leaders = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("bytes") / MEMBER_BYTES).cast("int").alias("blocks"))
    leaders = scratch.save(leaders.select("a", "n", F.greatest("blocks", F.lit(1)).alias("blocks")))
    n, size = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    cells = 1 + size // BLOCK_BYTES + 2 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = join_by_count(pairs.select("a", "b"), leaders, ["a"], "n", n).select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.col("b").alias("uid"))
    members = dealt.join(texts, "uid").select("a", "block", "uid", "weight", "terms")
    copies = leaders.select("a", "blocks").join(texts.withColumnRenamed("uid", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("uid"), "weight", "terms")

    def verify(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for a, block, uid, weight, terms in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "uid", "weight", "terms")), strict=True):
                held.setdefault((a, block), []).append((uid != a, uid, weight, np.frombuffer(terms, TERM)))
        found = []
        for (a, _), rows in held.items():
            (_, _, whole, own), *others = sorted(rows, key=lambda r: r[:2])
            found += [(a, uid) for _, uid, weight, terms in others if weighted_jaccard(own, terms, whole, weight, log_n) >= similarity - 1e-9]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["a", "b"])

    return members.unionByName(copies).groupBy(F.pmod(F.xxhash64("a", "block"), F.lit(cells)).alias("cell")).applyInArrow(verify, "a long, b long")


def strips(weights_of: np.ndarray, parts: list[np.ndarray], log_n: float, columns: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """Weighted Jaccard similarities of all pairs of texts, exactly: some texts' with all, and the first text's number, again and again.

    A term found t times becomes features for each count up to t that occurs here, weighted by what that count adds, so
    a sum of minima is the sum over common features: a product of matrices, none of which has many more than ``CELLS`` numbers.
    """
    e = np.concatenate(parts)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    h = e["lo"].astype(U) | e["hi"].astype(U) << U(32)
    levels = np.unique(e["tf"])
    features = []
    for k, level in enumerate(levels):
        has = e["tf"] >= level
        tf = np.full(int(has.sum()), float(level))
        w = weights(e["df"][has], tf, log_n)
        if k:
            w = w - weights(e["df"][has], tf * 0 + float(levels[k - 1]), log_n)
        features.append((row[has], bs.mix(bs.mix(h[has]) + U(k)), w))
    row, h, w = (np.concatenate([f[i] for f in features]) for i in range(3))
    _, column, n = np.unique(h, return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column, w = row[keep], number[column[keep]], np.sqrt(w[keep])
    order = np.argsort(column, kind="stable")
    row, column, w = row[order], column[order], w[order]
    rows = max(1, CELLS // len(parts))
    columns = min(columns, max(rows, 64))
    for top in range(0, len(parts), rows):
        own = weights_of[top : top + rows]
        least = np.zeros((len(own), len(parts)))
        for first in range(0, int(shared.sum()), columns):
            i, j = np.searchsorted(column, [first, first + columns])
            x = np.zeros((len(parts), columns))
            x[row[i:j], column[i:j] - first] = w[i:j]
            least += x[top : top + rows] @ x.T
        yield top, least / np.maximum(own[:, None] + weights_of[None, :] - least, 1e-12)


def similarities(weights_of: np.ndarray, parts: list[np.ndarray], log_n: float, columns: int = 4096) -> np.ndarray:
    """All strips at once."""
    return np.concatenate([s for _, s in strips(weights_of, parts, log_n, columns)])


def _search(log_n: float, similarity: float):
    """Of the texts of a pair of blocks of a band: a spanning forest of their links."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, weight, parts = [], [], []
        for batch in batches:
            uid += batch.column("uid").to_pylist()
            weight += batch.column("weight").to_pylist()
            parts += [np.frombuffer(t.as_py(), TERM) for t in batch.column("terms")]
        label = np.arange(len(uid))
        for top, s in strips(np.array(weight), parts, log_n):
            for k, link in enumerate(s >= similarity - 1e-9, top):
                met = np.append(label[link], label[k])
                if (met != met[0]).any():
                    label[np.isin(label, met)] = met.min()
        at = np.flatnonzero(label != np.arange(len(uid)))
        ids = np.array(uid, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[label[at]]), pa.array(ids[at])], ["a", "b"])

    return search


def _free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver collects its garbage; those of the first steps are large."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, n_in_class, kept (true for one row of each class), text_hash."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    source = pick(docs, doc_id=doc_id, text=text).select(whole(F.col("doc_id")).alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    n_docs, n_bytes = source.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    log_n = math.log(max(n_docs, 3))
    buckets = max(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES)
    sent = source.mapInArrow(bs.trimmed(_send(buckets)), "bucket long, slice long, blob binary, many binary")
    counted = sent.groupBy("bucket").applyInArrow(_count, "is_row boolean, slice long, blob binary, many binary")
    gathered = scratch.save(counted.groupBy("slice").applyInArrow(_gather(log_n, similarity), VECTOR))
    del sent, counted
    _free_shuffles(spark)

    rows = scratch.save(gathered.select("uid", "doc_id", "text_hash", "d0", "d1"))
    stands = scratch.save(gathered.where("terms is not null").groupBy("d0", "d1").agg(F.min("uid").alias("rep")))
    texts = scratch.save(gathered.where("terms is not null").join(stands.select(F.col("rep").alias("uid")), "uid", "left_semi").select("uid", "weight", "terms"))
    scratch.drop(gathered)
    _free_shuffles(spark)
    members = scratch.save(texts.select("uid", "terms").mapInArrow(bs.trimmed(_bands(log_n)), "band long, uid long").distinct())

    lead = members.groupBy("band").agg(F.min("uid").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lead = scratch.save(lead)
    n_members = members.count()
    pairs = join_by_count(members, lead, ["band"], "n", n_members).where("uid <> a").select("a", F.col("uid").alias("b")).distinct()
    edges = scratch.save(_verified(pairs, texts, scratch, log_n, similarity))
    _free_shuffles(spark)
    names = components(edges, scratch)
    named = members.join(names.select(F.col("node").alias("uid"), "root"), "uid", "left").select("band", "uid", F.coalesce("root", "uid").alias("root"))
    sizes = texts.select("uid", F.octet_length("terms").alias("bytes"))
    mixed = named.join(sizes, "uid").groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    mixed = scratch.save(mixed.where("low <> high").select("band", "blocks", "n"))
    if not mixed.isEmpty():
        block = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
        dealt = join_by_count(members, mixed, ["band"], "n", n_members).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("band", "uid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        search = _search(log_n, similarity)
        found = dealt.join(texts, "uid").groupBy("band", "i", "j").applyInArrow(search, "a long, b long")
        edges = scratch.save(edges.unionByName(found).distinct())
        names = components(edges, scratch)

    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    copies = rows.where("d0 is not null").groupBy("d0", "d1").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    roots = stands.join(names.select(F.col("node").alias("rep"), "root"), "rep", "left").select("d0", "d1", F.coalesce("root", "rep").alias("root"))
    copies = scratch.save(copies.join(roots, ["d0", "d1"]))
    classes = scratch.save(copies.groupBy("root").agg(F.min("first").alias("class_first"), F.sum("n").alias("n_in_class"), F.count(F.lit(1)).alias("texts")))
    classed = scratch.save(join_by_count(copies.select("d0", "d1", "n", "root"), classes, ["root"], "texts", copies.count()).select("d0", "d1", "n", "class_first", "n_in_class"))
    marked = join_by_count(rows.where("d0 is not null"), classed, ["d0", "d1"], "n", n_docs)
    marked = marked.select("doc_id", F.col("class_first.doc_id").alias("class_id"), "n_in_class", (F.col("class_first.uid") == F.col("uid")).alias("kept"), "text_hash")
    alone = rows.where("d0 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_in_class"), F.lit(True).alias("kept"), "text_hash")
    out = scratch.save(marked.unionByName(alone))
    scratch.drop_all_but(out)
    return out


def keep_one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without all but one row of each class."""
    scratch = Scratch(docs.sparkSession, "neardup")
    found = near_duplicates(docs, text, doc_id, similarity)
    gone = found.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("long")).alias("k")).where("n > k")
    gone = scratch.save(gone.select("n", "k", F.xxhash64(F.col("id").isNull(), "id", "hash").alias("key")))
    n, again = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("k"), F.lit(0))).first()
    flat = numbered(docs)
    id_ = whole(F.col(f"_{place(docs, doc_id)}"))
    keyed = flat.withColumn("key", F.xxhash64(id_.isNull(), id_, F.xxhash64(f"_{place(docs, text)}")))
    # rows repeated with id and text are hot keys; there are fewer than PARTS of those that are
    hot = gone.where(F.col("n") > found.count() / PARTS).select("key")
    small = F.broadcast if n <= BROADCAST_ROWS else lambda t: t
    rest = keyed.join(F.broadcast(hot), "key", "left_anti")
    out = rest.join(small(gone.select("key")), "key", "left_anti")
    if again:  # rows repeated with id and text, of which one stays
        one = gone.where("k > 0").select("key")
        out = out.unionByName(keyed.join(F.broadcast(hot.join(one, "key")), "key", "left_semi").unionByName(rest.join(small(one), "key", "left_semi")).dropDuplicates(["key"]))
    return out.drop("key").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
