"""The pipeline against plain Python, stage by stage, on a small table."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from siltstone.llm import packing, pii, rules
from tests.llm.test_neardup import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]
    clean = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts = [clean(rng.randint(40, 300)) for _ in range(50)]
    texts += [texts[0], texts[1], texts[1] + " end"]
    texts += ["Call 555-123-4567 or write to jo@mail.example.com on 2024-02-29. " + clean(50), "again again again again again " * 30, "short", None, "", clean(4000)]
    rows = [(i, t, "en", f"s{min(i % 7, 2)}", len(t or "")) for i, t in enumerate(texts)]
    return rows, [(i, 1, 0) for i in range(30)] + [(54, 0, 0)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    folder = tmp_path_factory.mktemp("corpus")
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [[tuple(r) for r in docs.collect()]]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        out.append([tuple(r) for r in docs.collect()] if i < 4 else docs.collect())
    whole = corpus_pipeline.run(spark, str(folder)).collect()
    assert sorted(map(str, whole)) != [] and Counter((r.doc_id, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.ids_crc32) for r in out[5])
    return out


def test_quality_rules_keep_clean_documents(stages):
    kept = {r[0] for r in stages[1]}
    assert {r[0] for r in stages[0]} - kept == {54, 55, 56, 57}
    assert all(r in stages[0] for r in stages[1])
    counts = [rules.THRESHOLD, rules.MIN_WORDS]
    assert counts == [-0.2, 10]


def test_one_of_each_class_stays(stages):
    rows = sorted((r[0], r[1]) for r in stages[1])
    names = brute(rows)
    first = {}
    for (i, _), c in zip(rows, names, strict=True):
        first[c] = min(i, first.get(c, i))
    assert {r[0] for r in stages[2]} == set(first.values()) and set(stages[2]) <= set(stages[1])
    assert not {50, 51, 52} & {r[0] for r in stages[2]}


def test_personal_data_are_replaced(stages, spark):
    key = pii.key_of(spark)
    want = {(i, pii.rewrite(t, key)[0], lang, source, len(pii.rewrite(t, key)[0])) for i, t, lang, source, _ in stages[2]}
    assert set(stages[3]) == want and all("555-123-4567" not in r[1] for r in stages[3])


def test_every_document_is_mixed_in(stages):
    n = Counter(stages[4])
    assert set(n) == set(stages[3]) and max(n.values()) == 2 and n.total() > len(n)
    tokens = lambda rows, s: sum(max(1, len(r[1].split())) for r in rows if r[3] == s)
    for s in ("s0", "s1", "s2"):
        assert tokens(stages[4], s) <= 2.0 * tokens(stages[3], s) + 4000


def test_pieces_hold_the_tokens_of_their_documents(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text, *_ in stages[4]:
        ids = [*encoder.encode(text, add_special_tokens=False).ids, 2]
        for k, start, n in zip(*(x.tolist() for x in packing.cut(np.array([len(ids)]), 1024)[1:]), strict=True):
            want[i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), tuple(ids[start : start + n])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in stages[5]) == want
    places = defaultdict(list)
    for r in stages[5]:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == np.cumsum([0, *[n for _, n in sorted(p)][:-1]]).tolist() and sum(n for _, n in p) <= 1024
