"""What workers hold, while they work and afterwards."""

import functools
import tracemalloc

import numpy as np
import pyarrow as pa

from siltstone.llm import bytescan as bs
from siltstone.llm import neardup


def peak_mb(f):
    tracemalloc.start()
    out = f()
    top = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, top


def test_many_short_texts_in_a_pair_of_blocks():
    """3,000 texts of 12 terms: groups of 30 that are chained by links between neighbours, and one link to the group after next."""
    parts, n = [], 3000
    for i in range(n):
        t = np.zeros(12, neardup.TERM)
        t["lo"] = 100 * (i // 30) + 1 + i % 30 + np.arange(12)
        t["df"], t["tf"] = 1000, 1
        parts.append(t)
    weights = [float(neardup.weights(t["df"], t["tf"].astype(float), 9.0).sum()) for t in parts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(weights), pa.array([t.tobytes() for t in parts])], ["uid", "weight", "terms"])
    out, top = peak_mb(lambda: list(neardup._search(9.0, 0.8)(iter([batch]))))
    assert [(a, b) for o in out for a, b in zip(*o.to_pydict().values(), strict=True)] == [(i // 30 * 30, i) for i in range(n) if i % 30]
    assert top < 80  # a matrix of all pairs has 72 MB


def test_strips_are_the_whole_matrix(monkeypatch):
    rng = np.random.default_rng(2)
    parts = []
    for _ in range(23):
        t = np.zeros(int(rng.integers(1, 30)), neardup.TERM)
        t["lo"] = np.sort(rng.choice(50, len(t), replace=False))
        t["df"], t["tf"] = t["lo"] * 9 + 1, rng.integers(1, 4, len(t))
        parts.append(t)
    whole = np.array([neardup.weights(t["df"], t["tf"].astype(float), 9.0).sum() for t in parts])
    want = neardup.similarities(whole, parts, 9.0)
    monkeypatch.setattr(neardup, "CELLS", 100)
    assert [k for k, _ in neardup.strips(whole, parts, 9.0)] == [0, 4, 8, 12, 16, 20]
    assert np.allclose(neardup.similarities(whole, parts, 9.0), want, atol=1e-12)


def test_scans_hold_few_numbers_a_byte():
    data = np.frombuffer(b"some words and others " * 100_000, np.uint8)
    s, top = peak_mb(lambda: bs.scan(data, np.array([0, len(data)])))
    assert top < 60 and len(s.hash) == 400_000  # 8 bytes for each byte of text, and the words
    power = pow(int(bs.BASE), 70_000, 2**64)
    assert int(s.sums[70_001] - s.sums[70_000]) == int(bs.BYTE_VALUE[data[70_000]]) * power % 2**64
    assert len(np.unique(s.hash)) == 4


def test_tasks_of_another_kind_free_what_was_kept():
    @functools.lru_cache(1)
    def cache(x):
        return [x]

    def work(batches):
        yield from (cache(b) for b in batches)

    for _ in range(2):
        assert list(bs.trimmed(work, cache)([1])) == [[1]]
    assert cache.cache_info().currsize == 1
    assert list(bs.trimmed(iter)([2])) == [2] and cache.cache_info().currsize == 0
