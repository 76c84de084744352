"""Near-duplicates against brute force over all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import neardup
from siltstone.operators.components import components
from siltstone.scratch import Scratch

SCHEMA = "doc_id long, text string, uid string"


def brute(rows):
    """doc_id sets of the classes: weighted Jaccard over all pairs."""
    bags = []
    for _, text in rows:
        w = [x for x in (text or "").replace("\n", " ").split(" ") if x]
        bags.append(Counter([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []))
    log_n = math.log(max(len(rows), 3))
    df = Counter(t for b in bags for t in b)
    vectors = [{t: (1 + math.log(n)) * (1 + (log_n - math.log(df[t])) / log_n) for t, n in b.items()} for b in bags]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if a and b:
                least = sum(min(x, b[t]) for t, x in a.items() if t in b)
                if least / (sum(a.values()) + sum(b.values()) - least) >= 0.8:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([60, 120]))]
        for _ in range(rng.choice([1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += ["a a a a a a a a a a", "a a a a a a a a a a a", "", None, "  ", "two words", "two  words", "word", rows[0], rows[0]]
    return [(i, t) for i, t in enumerate(rows)]


def test_matches_brute_force(spark):
    rows = corpus()
    got = neardup.near_duplicates(spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == {i: want[i] for i in range(len(rows))}
    assert Counter(r.class_id for r in got if r.kept) == Counter({c: 1 for c in want})


def test_repeated_and_null_ids(spark):
    text = "one two three four five six seven eight"
    rows = [(None, text, ""), (7, text, ""), (7, text, ""), (7, "something else altogether that stands alone here", ""), (9, None, ""), (9, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or -1, r.class_id, r.n_in_class) for r in neardup.near_duplicates(df).collect())
    assert got == [(-1, 7, 3), (7, 7, 1), (7, 7, 3), (7, 7, 3), (9, 9, 1), (9, 9, 1)]
    kept = sorted((r.doc_id, r.text or "", r.uid) for r in neardup.keep_one_of_each(df).collect())
    assert kept == [(7, "one two three four five six seven eight", ""), (7, "something else altogether that stands alone here", ""), (9, "", ""), (9, "", "")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(df).count() == 0
    assert neardup.keep_one_of_each(df).columns == df.columns


@pytest.mark.parametrize("names", ["doc_id long, text string, _id string, _hash string", "doc_id long, text string, _h string, key string", "doc_id long, text string, _0 string, Text string"])
def test_columns_of_any_name(spark, names):
    text = "one two three four five six seven eight"
    rows = [(1, text, "a", "b"), (1, text, "a", "b"), (2, text, "a", "b"), (3, "other words that stand alone in this table", "a", "b"), (4, None, None, None)]
    df = spark.createDataFrame(rows, names)
    assert sorted((r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4)]
    kept = neardup.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r[0] for r in kept.collect()) == [1, 3, 4]


def test_ids_that_are_no_numbers_count_as_null(spark):
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([("a", text), ("b", text), ("7", text + " nine"), ("c", "something else")], "doc_id string, text string")
    assert neardup.near_duplicates(df).count() == 4
    assert neardup.keep_one_of_each(df).where("text like 'one%'").count() in (1, 2)


def test_shared_lines_and_hot_groups(spark, monkeypatch):
    """A passage in all texts, a large group of exact and one of near copies, texts over several slices, and hot keys joined by broadcast."""
    from siltstone import skew

    monkeypatch.setattr(neardup, "SLICE", 3000)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(neardup, "MEMBER_BYTES", 2000)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    line = " ".join(word() for _ in range(12))
    near = [word() for _ in range(150)]
    texts = [line + " " + " ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(60)] + [line] * 40
    for _ in range(40):
        copy = list(near)
        copy[rng.randrange(150)] = word()
        texts.append(" ".join(copy) + " " + line)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want = brute(rows)
    monkeypatch.setattr(skew, "PARTS", 8)
    got = neardup.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA).repartition(3)).collect()
    first = {}
    for (i, _), c in zip(rows, want, strict=True):
        first[c] = min(i, first.get(c, i))
    assert {r.doc_id: r.class_id for r in got} == {i: first[c] for (i, _), c in zip(rows, want, strict=True)}
    sizes = Counter(r.class_id for r in got)
    assert all(r.n_in_class == sizes[r.class_id] for r in got) and sum(r.kept for r in got) == len(sizes)


def test_similarities_equal_the_pairwise_function():
    rng = np.random.default_rng(0)
    parts = []
    for _ in range(9):
        n = int(rng.integers(5, 40))
        t = np.zeros(n, neardup.TERM)
        t["lo"] = np.sort(rng.choice(60, n, replace=False))
        t["df"] = t["lo"] * 7 % 5000 + 1
        t["tf"] = rng.integers(1, 4, n)
        parts.append(t)
    whole = np.array([neardup.weights(p["df"], p["tf"].astype(float), 9.0).sum() + 1 for p in parts])
    s = neardup.similarities(whole, parts, 9.0, columns=16)
    for i in range(9):
        for j in range(9):
            assert i == j or s[i, j] == pytest.approx(neardup.weighted_jaccard(parts[i], parts[j], whole[i], whole[j], 9.0))


def test_sampling_estimates_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = rng.uniform(1, 2, 300), rng.uniform(1, 2, 300)
    wa[200:], wb[:100] = 1e-12, 1e-12
    a = neardup.icws(h, np.log(wa), np.array([0]), 1500)
    b = neardup.icws(h, np.log(wb), np.array([0]), 1500)
    assert (a == b).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.05)


@pytest.mark.parametrize("few", [0, 2000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr("siltstone.operators.components.FEW", few)
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {r.node: r.root for r in got} == {x: root(x) for a, b in edges for x in (a, b) if a != b}
