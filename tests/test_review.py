"""Review clusters and image duplicates against brute force, and on tables where all pairs would take too long."""

import random
import threading
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from siltstone.operators import review


@contextmanager
def seconds(spark, most):
    """Cancels Spark's jobs, which is an error, after so many seconds."""
    stop = threading.Timer(most, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        yield
    finally:
        stop.cancel()


def components(sets, jaccard):
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and len(x & y) > 0 and len(x & y) >= jaccard * len(x | y):
                root[max(top(a), top(b))] = min(top(a), top(b))
    found = {}
    for k in sets:
        found.setdefault(top(k), []).append(k)
    return sorted(map(sorted, found.values()))


@pytest.mark.parametrize("jaccard", [0.05, 0.3, 0.6, 0.75, 1.0])
def test_clusters_equal_brute_force_for_sets_of_all_sizes(spark, jaccard):
    rng = random.Random(int(jaccard * 100))
    sets = {}
    for k in range(260):
        n = rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 9, 11, 14, 63, 66, 80])
        if k % 3 and n:  # another set, changed in some words
            words = sorted(sets[rng.randrange(k)])
            words = rng.sample(words, max(0, len(words) - rng.randrange(1 + len(words) // 3 + 1))) + [f"x{k}.{i}" for i in range(rng.randrange(1 + len(words) // 3 + 1))]
        else:
            words = [f"w{int(400 * rng.random() ** 2)}" for _ in range(n)]
        sets[k] = set(words)
    rows = [(k, " ".join(w), None, 0.5) for k, w in sets.items()]
    got = review.clusters(spark.createDataFrame(rows, "id long, mention string, top long, priority double"), jaccard)
    assert sorted(sorted(r.members) for r in got.select("members").collect()) == components(sets, jaccard)


def test_clusters_do_not_compare_all_sets_with_a_common_word(spark):
    """40,000 mentions of three words, one of these being one of two, and 100 with a fourth word of their own."""
    mention = F.concat(F.lit("name"), F.col("id").cast("string"), F.lit(" of "), (F.col("id") % 2).cast("string"))
    items = spark.range(40_000).select("id", mention.alias("mention"), F.lit(None).cast("long").alias("top"), F.lit(0.5).alias("priority"))
    late = items.where("id < 100").withColumn("mention", F.concat("mention", F.lit(" late"), F.col("id").cast("string"))).withColumn("id", F.col("id") + 100_000)
    with seconds(spark, 60):
        got = review.clusters(items.unionByName(late)).where("size(members) > 1").select("members").collect()
    assert sorted(sorted(r.members) for r in got) == [[k, k + 100_000] for k in range(100)]


def sequential(rows, threshold):
    first = {}
    for k, h in rows:
        if h is not None and k is not None:
            first[h] = min(k, first.get(h, k))
    kept = []
    for k, h in sorted((k, h) for h, k in first.items()):
        if all(((h ^ g) % 2**64).bit_count() > threshold for _, g in kept):
            kept.append((k, h))
    return [k for k, _ in kept]


@pytest.mark.parametrize("threshold", [-1, 0, 3, 5, 16, 40, 64])
@pytest.mark.parametrize("few", [60, 10_000])
def test_phash_dedup_equals_the_sequential_rule(spark, monkeypatch, threshold, few):
    """In one round and in several: copies, near copies, a chain of partners, signs, and rows without an id or a hash."""
    monkeypatch.setattr(review, "FEW", few)
    monkeypatch.setattr(review, "BUCKET", 16)
    rng = random.Random(threshold)
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(64), n))
    hashes = [0, 2**64 - 1]
    for _ in range(60):
        hashes.append(flip(hashes[-1], min(max(threshold, 0), 64)))
    for _ in range(300):
        hashes.append(rng.choice([rng.getrandbits(64), rng.choice(hashes), flip(rng.choice(hashes), rng.randrange(9))]))
    ids = rng.sample(range(-(10**12), 10**12), len(hashes))
    ids[2:62] = sorted(ids[2:62])
    rows = [(k, h - 2**64 if h >= 2**63 else h) for k, h in zip(ids, hashes, strict=True)]
    odd = [(None, 12345), (7, None), (None, None)]
    got = review.phash_dedup(spark.createDataFrame(rows + odd, "id long, h long"), threshold)
    assert sorted(r.id for r in got.collect()) == sequential(rows, threshold)


def test_phash_dedup_of_nothing(spark):
    assert review.phash_dedup(spark.createDataFrame([], "id long, h long")).columns == ["id"]
    assert review.phash_dedup(spark.createDataFrame([(1, None)], "id long, h long")).count() == 0


def test_phash_dedup_does_not_list_all_pairs(spark):
    """60,000 random hashes, each of which shares a band of 3 or 4 bits with most others."""
    with seconds(spark, 60):
        got = review.phash_dedup(spark.range(60_000).select("id", F.xxhash64("id").alias("h")), 16)
        assert 25_000 < got.count() < 35_000
