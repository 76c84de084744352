"""Functions without a query of their own, against plain Python."""

import json
import random
import struct
import time
import zlib
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import ranks, skew
from siltstone.functions import text as T
from siltstone.operators import batching, context, corrections, credibility, graph, knn, metrics, review, rollout
from siltstone.scratch import Scratch
from siltstone.sources import feeds, images, store
from siltstone.streaming import streams


def png(grey, colour=0, filters=0):
    grey = np.asarray(grey, np.uint8)
    height, width = grey.shape[:2]
    channels = {0: 1, 2: 3}[colour]
    flat = grey.reshape(height, width * channels).astype(int)
    lines, before = [], np.zeros(width * channels, int)
    for y, line in enumerate(flat):
        kind = (y % 5) if filters else 0
        left, corner = (np.concatenate([np.zeros(channels, int), x[:-channels]]) for x in (line, before))
        p = left + before - corner
        far = np.stack([abs(p - left), abs(p - before), abs(p - corner)])
        guess = (0, left, before, (left + before) // 2, np.choose(far.argmin(axis=0), [left, before, corner]))[kind]
        lines.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        before = line
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")


JPEG = b"\xff\xd8\xff\xe0\x00\x10" + b"JFIF" + bytes(10) + b"\xff\xff\xc2\x00\x11\x08" + struct.pack(">HH", 300, 400) + bytes(10)
WEBP = {
    "VP8X": b"RIFF____WEBPVP8X\x0a\0\0\0" + bytes(4) + (399).to_bytes(3, "little") + (299).to_bytes(3, "little"),
    "VP8L": b"RIFF____WEBPVP8L\x0a\0\0\0\x2f" + (399 | 299 << 14).to_bytes(4, "little"),
    "VP8": b"RIFF____WEBPVP8 \x0a\0\0\0" + bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", 400, 300),
}


def test_image_headers():
    assert images.header(JPEG) == ("JPEG", 400, 300) and {images.header(w) for w in WEBP.values()} == {("WEBP", 400, 300)}
    for bad in (b"", b"GIF89a" + bytes(20), JPEG[:8], WEBP["VP8L"][:21], b"\xff\xd8\xff\xda"):
        assert images.header(bad) is None


@pytest.mark.parametrize("filters", [0, 1])
def test_png_pixels_and_hash(filters):
    rng = np.random.default_rng(4)
    grey = rng.integers(0, 256, (40, 50))
    assert (images.png_grey(png(grey, 0, filters)) == grey).all()
    rgb = rng.integers(0, 256, (12, 9, 3))
    assert np.allclose(images.png_grey(png(rgb, 2, filters)), rgb @ [0.299, 0.587, 0.114])
    assert images.png_grey(png(grey)[:60]) is None
    smooth = np.kron(rng.integers(0, 250, (8, 8)), np.ones((8, 8)))
    a, b = images.phash(smooth), images.phash(np.repeat(np.repeat(smooth, 3, 0), 3, 1) + 4)
    assert len(a) == 16 and bin(int(a, 16) ^ int(b, 16)).count("1") <= 2 and bin(int(a, 16)).count("1") == 32


def test_valid_images_and_their_store(spark, tmp_path):
    big = png(np.add.outer(np.arange(220), np.arange(240)) % 256)
    rows = [(1, big), (2, png(np.zeros((40, 300)))), (3, JPEG), (4, b"junk"), (5, None), (6, big)]
    files = spark.createDataFrame(rows, "id long, content binary")
    got = {r.id: (r.format, r.width, r.height, r.phash) for r in images.valid_images(files).collect()}
    assert set(got) == {1, 3, 6} and got[3] == ("JPEG", 400, 300, None) and got[1] == got[6] and len(got[1][3]) == 16
    for _ in range(2):
        store.store_files(files.where("content is not null").withColumn("ext", F.lit("png")), str(tmp_path / "files"))
    assert spark.read.parquet(str(tmp_path / "files")).count() == 4


def test_versions_and_logs(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    for k, day in (("old", "2026-01-01"), ("new", "2026-02-01")):
        store.save_version(v, str(tmp_path / "e"), k, F.lit(day).cast("timestamp"))
    listed = store.list_versions(spark, str(tmp_path / "e"), F.lit("2026-02-10").cast("timestamp")).collect()
    assert [r.version_id for r in listed] == ["new"]
    root = str(tmp_path / "log")
    assert store.read_log(spark, root, "k string, seq long", "k").count() == 0
    store.append_log(spark.createDataFrame([("a", 1), ("b", 1)], "k string, seq long"), root)
    store.append_log(spark.createDataFrame([("a", 2)], "k string, seq long"), root)
    assert sorted(map(tuple, store.read_log(spark, root, "k string, seq long", "k").collect())) == [("a", 2), ("b", 1)]
    index = str(tmp_path / "index")
    with pytest.raises(ValueError):
        store.open_index(spark, index, 2)
    store.publish_index(v, index, "v1", 1)
    store.merge_segment(store.open_index(spark, index, 2), spark.createDataFrame([(2, [0.0, 1.0])], v.schema), index, "v2", 2)
    assert store.open_index(spark, index, 2).count() == 2
    with pytest.raises(ValueError):
        store.open_index(spark, index, 3)
    nodes = spark.createDataFrame([("a", "entity"), ("b", "entity")], "id string, kind string")
    edges = spark.createDataFrame([("a", "b", "mentions")] * 2, "src string, dst string, type string")
    store.save_graph(nodes, edges, str(tmp_path / "g"), "s1")
    assert store.load_graph(spark, str(tmp_path / "g"), "s1")[1].count() == 1
    store.save_graph(nodes.limit(0), edges, str(tmp_path / "g"), "s2")
    with pytest.raises(ValueError, match="unknown endpoint"):
        store.load_graph(spark, str(tmp_path / "g"), "s2")
    store.save_report(nodes, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_settings():
    d = {"top_k": 5, "timeout": 0.08, "debug": False, "name": "x"}
    got = store.settings(d, "APP_", {"APP_TOP_K": "7", "APP_DEBUG": "true", "OTHER": "1", "app_unknown": "2"}, '{"timeout": "0.5"}')
    assert got == {"top_k": 7, "timeout": 0.5, "debug": True, "name": "x"}
    with pytest.raises(KeyError):
        store.settings(d, "APP_", {}, '{"nope": 1}')


def test_fetch_tries_again_and_gives_up():
    def run(*answers, kind=""):
        left, slept = list(answers), []

        def get(url):
            a = left.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

        body = feeds.fetch(get, "u", kind, slept.append, random.Random(1))
        return body, len(answers) - len(left), slept

    ok = (200, "image/png", b"x")
    assert run(ok)[:2] == (b"x", 1) and run((503, "", b""), OSError(), ok)[:2] == (b"x", 3)
    assert run((404, "", b""), ok)[:2] == (None, 1) and run(*[(500, "", b"")] * 4, ok)[:2] == (None, 4)
    assert run(ok, kind="image/")[0] == b"x" and run((200, "text/html", b"x"), kind="image/")[0] is None
    slept = run(*[(429, "", b"")] * 4)[2]
    assert len(slept) == 3 and all(0.5 * 2**i <= s <= 0.625 * 2**i for i, s in enumerate(slept))
    assert 8 <= feeds.backoff_seconds(9) <= 10


def test_pace_keeps_the_gap():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = feeds.Pace(600, lambda: now[0], sleep)
    for _ in range(3):
        pace.wait()
    assert len(slept) == 2 and abs(now[0] - 0.2) < 1e-9
    now[0] += 5
    pace.wait()
    assert len(slept) == 2


def test_bodies_are_fetched_in_workers(spark):
    def getter():
        return lambda url: (200 if "good" in url else 404, "text/html", url.encode())

    rows = feeds.fetch_bodies(spark.createDataFrame([("http://good/1",), ("http://bad/2",)], "url string"), getter, per_minute=60_000).collect()
    assert [(r.url, bytes(r.body)) for r in rows] == [("http://good/1", b"http://good/1")]


def test_paging_back():
    stamp = lambda i: f"202605{28 - i // 20:02d}T{19 - i % 20:02d}0000Z"
    all_ = [{"url": f"u{i}", "title": "t", "seendate": stamp(i)} for i in range(40)]
    calls = []

    def read(end, size):
        calls.append((end, size))
        at = len(calls) - 1
        return json.dumps({"articles": all_[at * 3 : at * 3 + size]})

    feeds.PAGE, kept = 4, feeds.PAGE
    try:
        bodies = feeds.pages_back("q", read, 10, "20270101000000")
        assert sum(len(json.loads(b)["articles"]) for b in bodies) == 10 and [s for _, s in calls] == [4, 4, 3, 1]
        assert feeds.pages_back("q", lambda e, s: json.dumps({"articles": all_[:2]}), 10, "20270101000000")[1:] == []
        same = json.dumps({"articles": all_[:4]})
        assert len(feeds.pages_back("q", lambda e, s: same, 100, "20270101000000")) == 1
        assert feeds.pages_back("q", lambda e, s: None, 10, "x") == feeds.pages_back("q", lambda e, s: "{broken", 10, "x") == feeds.pages_back("q", read, 0, "x") == []
    finally:
        feeds.PAGE = kept
    with pytest.raises(ValueError):
        feeds.pages_back("", read, 10, "x")
    assert (feeds.query_budget(100, 40, 7), feeds.query_budget(3, 3, 5), feeds.query_budget(5, 0, 0)) == (8, 1, 0)
    assert "startdatetime=1" in feeds.page_url("http://a", "q", "2", oldest="1") and "maxrecords=250" in feeds.page_url("http://a", "q", "2", 900)


def test_a_failing_source_is_left_out(spark):
    def bad():
        raise RuntimeError("down")

    got = feeds.collect_sources([lambda: spark.range(3).toDF("i"), bad, lambda: spark.range(10, 20).toDF("i")], 5)
    assert got.count() == 5 and feeds.collect_sources([bad], 5) is None


def test_robots(spark):
    urls = spark.createDataFrame([("http://a.example/x",), ("http://a.example/private/y",), ("http://b.example/private",)], "url string")
    rules = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /private")], "host string, rules string")
    assert {r.url for r in feeds.allowed(urls, rules).collect()} == {"http://a.example/x", "http://b.example/private"}


def test_text_functions(spark):
    row = spark.createDataFrame([("00000000000000ff", "000000000000000f", "zz", "A b a", "a c", {"k": "1", "text": "2"})], "a string, b string, c string, x string, y string, m map<string,string>")
    got = row.select(T.hamming(F.col("a"), F.col("b")), T.hamming(F.col("a"), F.col("c")), T.token_jaccard(F.col("x"), F.col("y")), T.extra(F.col("m"), "text", "label"), T.utc_compact(F.lit("2026-05-04 10:02:03").cast("timestamp")), T.source_id(F.lit("d.org"), F.lit("me"))).first()
    assert tuple(got) == (4, None, 1 / 3, {"k": "1"}, "20260504100203", "source:d.org:me")


def test_credibility_history_grows(spark):
    items = spark.createDataFrame([("http://www.A.org/x", " Satire "), ("a.org", "REAL"), ("", "satire"), (None, "news"), ("a.org", None)], "domain string, label string")
    once = credibility.history(items)
    assert [tuple(r) for r in credibility.merge_history(once, once).collect()] == [("a.org", 2, 2, 2)]
    odd = spark.createDataFrame([("", 1.0, "x", "y")], "domain string, age_days double, row string, d string")
    assert tuple(credibility.classify(odd, spark.createDataFrame([("", 20, 0, 0)], "domain string, satire long, news long, other long")).first()) == ("", 1.0, "x", "y", "UNKNOWN", 0.0, "no domain")


def test_graph_entities_merge(spark):
    e = spark.createDataFrame([("a", "Ann", ["A", "Ann B"]), ("b", "Ann B", ["x", "A", ""]), ("c", "Cy", [])], "id string, canonical_name string, aliases array<string>")
    got = {r.id: (r.canonical_name, r.aliases) for r in graph.merge_entities(e, spark.createDataFrame([("a", "b"), ("c", "c")], "source string, target string")).collect()}
    assert got == {"b": ("Ann B", ["x", "A", "Ann"]), "c": ("Cy", [])}
    edges = spark.createDataFrame([("b", "a", "m"), ("a", "b", "m"), ("a", "b", "m")], "src string, dst string, type string")
    assert [tuple(r) for r in graph.snapshot_edges(edges).collect()] == [("a", "b", "m"), ("b", "a", "m")]


def test_unknown_actions_versions_and_phases_are_errors(spark):
    c = spark.createDataFrame([("k1", [1, 2])], "cluster_id string, members array<long>")
    for decisions in ([("k1", "burn")], [("k9", "merge")], [("k1", None)]):
        with pytest.raises(Exception, match="unknown"):
            review.resolve_clusters(c, spark.createDataFrame(decisions, "cluster_id string, action string")).collect()
    with pytest.raises(Exception, match="unknown action"):
        corrections.checked(spark.createDataFrame([("burn",)], "action string")).collect()
    models = spark.createDataFrame([("m", ["g"])], "model string, allowed array<string>")
    contexts = spark.createDataFrame([("c", "g", 0.6)], "context string, gnn string, score double")
    ok = rollout.compatibility(spark.createDataFrame([("m", "c")], "model string, context string"), models, contexts).first()
    assert (ok.compatible, ok.severity) == (True, "warning")
    for pair in (("x", "c"), ("m", "x")):
        with pytest.raises(Exception, match="unknown"):
            rollout.compatibility(spark.createDataFrame([pair], "model string, context string"), models, contexts).collect()
    rows = spark.createDataFrame([(0, [1.0])], "target int, probs array<double>")
    for phase in (0, 2, 3):
        with pytest.raises(ValueError):
            metrics.phased_loss(rows, phase, [1.0], [0.5])
    with pytest.raises(ValueError):
        rollout.sample_with_replacement(spark.range(0).toDF("seq"), 3)
    draws = rollout.sample_with_replacement(spark.range(4).toDF("seq"), 50)
    assert draws.count() == 50 and {r.seq for r in draws.collect()} == {0, 1, 2, 3}


def test_lookup_keeps_order_and_gaps(spark):
    ids = spark.createDataFrame([("k", ["b", "x", "a", "b"])], "key string, ids array<string>")
    e = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, embedding array<double>")
    assert [r.embedding for r in context.lookup(ids, e).orderBy("place").collect()] == [[2.0], None, [1.0], [2.0]]


def test_context_of_texts(spark):
    aliases = context.register_aliases(spark.createDataFrame([("jonathan smith", "e1", 1), ("acme", "e2", 2), ("acme", "e3", 3)], "alias string, entity_id string, seq int"), spark.createDataFrame([(" ACME corp ", "e2", 4), ("  ", "e9", 5)], "alias string, entity_id string, seq int"))
    texts = spark.createDataFrame([(1, "Jonathon Smith met ACME."), (2, "nothing"), (3, ""), (4, None), (5, "acme acme corp")], "id long, text string")
    e = spark.createDataFrame([("e1", [1.0, 0.0]), ("e3", [0.0, 1.0])], "id string, embedding array<double>")
    got = {r.id: (r.n_entities, round(r.confidence, 6), [round(x, 6) for x in r.pooled]) for r in context.graph_context(texts, aliases, e, dim=2).collect()}
    score = 1 - 1 / 14
    assert got[1] == (2, round((1 + score) / 2, 6), [round(0.85 / 1.85, 6), round(1 / 1.85, 6)])
    assert got[2] == got[3] == got[4] == (0, 0.0, [0.0, 0.0]) and got[5] == (1, 1.0, [0.0, 1.0])


def test_lru_against_a_simulation(spark):
    rng = random.Random(2)
    rows = [(c, i, rng.choice("abcdefgh")) for c in (1, 2) for i in range(200)]
    got = {(r.cache, r.seq): r.hit for r in batching.lru_hits(spark.createDataFrame(rows, "cache long, seq long, key string"), 4).collect()}
    for c in (1, 2):
        held: OrderedDict = OrderedDict()
        for cc, i, k in rows:
            if cc == c:
                assert got[c, i] == (k in held)
                held[k] = True
                held.move_to_end(k)
                if len(held) > 4:
                    held.popitem(last=False)


def test_drift_against_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, (150, 6)), rng.normal(0.3, 1.5, (150, 6))
    df = lambda x: spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>")
    sv = lambda x: np.linalg.svd(x, compute_uv=False)
    norms = [np.linalg.norm(x, axis=1).mean() for x in (a, b)]
    want = (
        min(1, np.max(np.abs(b.mean(0) - a.mean(0)) / a.std(0)) / 5), min(1, abs(norms[1] - norms[0]) / norms[0]), min(1, np.linalg.norm(sv(a) - sv(b)) / np.linalg.norm(sv(a))),
    )
    r = knn.drift(df(a), df(b)).first()
    assert np.allclose((r.marginal, r.norm, r.structural), want) and abs(r.composite - np.dot(want, (0.3, 0.25, 0.45))) < 1e-9
    assert r.dominant == max(zip(np.multiply(want, (0.3, 0.25, 0.45)), ("marginal", "norm", "structural"), strict=True))[1]
    few = knn.drift(df(a), df(b[:50])).first()
    assert (few.status, few.composite) == ("healthy", 0.0)
    zero = np.zeros((150, 6))
    assert knn.drift(df(zero), df(b)).first().structural == 1.0 and knn.drift(df(zero), df(b), zero_is_drift=False).first().structural == 0.0


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, 3).tolist()) for i in range(60)] + [(70, None), (71, []), (72, [1.0, None, 2.0]), (73, [1.0, 2.0]), (74, [0.5, 0.5])]
    rows += [(80, rows[4][1]), (81, rows[4][1])]
    t = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {}
    for r in knn.nearest(t.where("id < 10 or id > 69"), t, 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.node_id))
    fine = [(i, np.array(v)) for i, v in rows if v and None not in v]
    for i, v in fine:
        if i < 10 or i > 69:
            best = sorted((((v - w) ** 2).sum(), j) for j, w in fine if len(w) == len(v))[:3]
            assert sorted(got[i]) == [(k + 1, j) for k, (_, j) in enumerate(best)]
    assert set(got) == {i for i, v in fine if i < 10 or i > 69}


def test_running_sums_over_parts(spark):
    rng = random.Random(1)
    rows = [(float(x), rng.randint(0, 9)) for x in rng.sample(range(1000), 300)]
    got = {r.x: r.s for r in ranks.running_sum(spark.createDataFrame(rows, "x double, n long"), "x", "n", "s", parts=7).collect()}
    assert got == {x: sum(m for y, m in rows if y < x) for x, _ in rows}
    tied = spark.createDataFrame([(0.5, True), (0.5, False), (0.9, True), (0.1, False)], "score double, positive boolean")
    assert metrics.auroc(tied).first().auroc == 0.875 and metrics.auroc(tied.where("positive")).first().auroc == 0.5


def test_hot_keys_meet_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "PARTS", 4)
    left = spark.createDataFrame([(i % 3 if i < 50 else i, i) for i in range(80)], "k long, v long")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = skew.join_by_count(left, right, ["k"], "n", 80)
    assert got.count() == 80 and {(r.k, r.top) for r in got.collect()} == {(r.k, r.top) for r in right.collect()}


def test_streams(spark, tmp_path):
    Scratch(spark, "test")
    base = str(tmp_path / "in")
    rows = [(i, f"2026-01-01 00:{i:02d}:00", i % 4 == 0) for i in range(50)]
    spark.createDataFrame(rows, "id long, t string, done boolean").select("id", F.col("t").cast("timestamp").alias("created_at"), F.col("t").cast("timestamp").alias("ts"), "done").repartition(1).write.parquet(base)
    stream = spark.readStream.schema(spark.read.parquet(base).schema).parquet(base)
    late = streams.drain(streams.timers(stream.select("id", "created_at", "done"), 10), "append")
    assert {r.id for r in late.collect()} <= {i for i, _, d in rows if not d}
    w = streams.drain(streams.windows(stream.withColumn("k", F.lit("x")), "k"), "append")
    assert w.where("n > 5").count() == 0 and w.count() > 0
    buffer = streams.RollingBuffer(spark, str(tmp_path / "buffer"), 10)
    for n in (0, 1, 1, 2):
        buffer.keep(spark.range(n * 6, n * 6 + 6).toDF("seq"), n)
    assert sorted(r.seq for r in buffer.rows(2).collect()) == list(range(8, 18))
    q = streams.every(stream, 15, lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out{n}")), str(tmp_path / "ck"))
    for _ in range(600):
        if q.lastProgress:
            break
        time.sleep(0.1)
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out0")).count() == 50
