"""Vectorised scanning of UTF-8 text columns.

Words are maximal runs of bytes other than space and \\x09-\\x0D. All of those are single bytes in UTF-8, so a
column's byte buffer can be scanned as one array: no Python object is made per text or per word. Hashes are
64-bit polynomial sums over random byte values, finished by a mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: First bytes of code points: all but 10xxxxxx.
FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15 | 1)
#: Powers are kept for places below this, and multiplied with those of its multiples beyond.
STRIDE = 1 << 16
PLACES = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)
SLICE_BYTES = 1 << 20


def _power(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[0] = 1
    return np.multiply.accumulate(p)


LOW, LOW_INVERSE = (_power(pow(int(BASE), k, 2**64), STRIDE) for k in (1, -1))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_kept: list = []


def begin(keeps=None) -> None:
    """A task begins; ``keeps`` is the lru_cache that its kind fills for the next one. What tasks of another kind filled goes."""
    for cache in _kept:
        if cache is not keeps:
            cache.cache_clear()
    _kept[:] = [keeps] if keeps else []


def trim() -> None:
    """Gives freed memory back to the system; else a worker holds it through later stages."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if give:
        give(0)


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` of a task, with as little memory as may be held when it begins and when it has ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(keeps)
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first row, end row, bytes, offsets. A longer text comes alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


@dataclass
class Scan:
    """Words of a slice of texts. ``hash`` tells words apart; ``doc`` is the row of each word."""

    data: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high = _power(pow(int(BASE), -STRIDE, 2**64), len(self.data) // STRIDE + 1)
        return mix((self.sums[ends] - self.sums[starts]) * (LOW_INVERSE[starts % STRIDE] * high[starts // STRIDE]) + (ends - starts).astype(U))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each run of ``size`` words inside one text."""
        m = len(self.hash) - size + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        first = np.flatnonzero(self.doc[:m] == self.doc[size - 1 :])
        h = np.zeros(len(first), U)
        for k in range(size):
            h += self.hash[first + k] * PLACES[k]
        return first, mix(h)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Number of True bytes of each text."""
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.offs[1:]] - c[self.offs[:-1]]


def scan(data: np.ndarray, offs: np.ndarray) -> Scan:
    n = len(data)
    inside = ~SEPARATOR[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = offs[1:] > offs[:-1]
        before[offs[:-1][full]] = False
        after[offs[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offs, starts, side="right") - 1
    sums = np.zeros(n + 1, U)
    high = _power(pow(int(BASE), STRIDE, 2**64), n // STRIDE + 1)
    for k in range(0, n, STRIDE):
        part = BYTE_VALUE[data[k : k + STRIDE]]
        np.multiply(part * LOW[: len(part)], high[k // STRIDE], out=sums[k + 1 : k + 1 + len(part)])
    np.cumsum(sums[1:], out=sums[1:])
    out = Scan(data, offs, starts, ends, doc, np.zeros(0, U), sums, np.bincount(doc, minlength=len(offs) - 1).astype(np.int64))
    out.hash = out.span_hash(starts, ends)
    return out


def shingles(s: Scan, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle of ``size`` words; a text of fewer words (one at least) is one shingle."""
    first, h = s.windows(size)
    doc = s.doc[first]
    for k in range(1, size):
        short = np.flatnonzero(s.counts == k)
        if len(short):
            at = np.searchsorted(s.doc, short)
            g = np.full(len(short), k, U)
            for i in range(k):
                g += s.hash[at + i] * PLACES[i]
            doc, h = np.concatenate([doc, short]), np.concatenate([h, mix(g)])
    return doc, h


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def base_metrics(s: Scan, window: int = 5) -> dict[str, np.ndarray]:
    """Counts per text: words, their code points, symbols, repeated lines, words in repeated windows."""
    n = s.n
    out = {"n_words": s.counts, "word_chars": s.per_doc(FIRST_BYTE[s.data] & ~SEPARATOR[s.data]), "n_symbols": s.per_doc(SYMBOL[s.data])}
    # lines: cut at each \n and at each end of a text
    cuts = np.flatnonzero(s.data == 0x0A)
    full = s.offs[1:] > s.offs[:-1]
    starts = np.concatenate([s.offs[:-1][full], cuts + 1])
    ends = np.concatenate([s.offs[1:][full], cuts])
    starts.sort()
    ends.sort()
    keep = np.searchsorted(s.starts, ends) > np.searchsorted(s.starts, starts)
    starts, ends = starts[keep], ends[keep]
    doc = np.searchsorted(s.offs, starts, side="right") - 1
    h = mix(s.span_hash(starts, ends) + doc.astype(U) * PLACES[8])
    order = np.argsort(h, kind="stable")
    again = order[1:][h[order[1:]] == h[order[:-1]]]
    out["n_dup_lines"] = np.bincount(doc[again], minlength=n).astype(np.int64)
    first, h = s.windows(window)
    hit = first[repeated(mix(h + s.doc[first].astype(U) * PLACES[8]))]
    m = len(s.hash) + 1
    open_ = np.cumsum(np.bincount(hit, minlength=m)[:m] - np.bincount(hit + window, minlength=m)[:m])[:-1] > 0
    out["n_repeat_words"] = np.bincount(s.doc[open_], minlength=n).astype(np.int64)
    return out
