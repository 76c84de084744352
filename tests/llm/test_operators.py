"""Packing, pseudonyms, rules, archives, mixing, sharding, search and chats against brute force and round trips."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import bytescan as bs
from siltstone.llm import chat, classifier, mixing, packing, pii, rules, sharding, topk, warc
from siltstone.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEY = b"a key for tests"
TEXTS = ["", None, "a", "a b c d e f a b c d e f", "x\ny\n x\nx\n\n", "# * | <b> &", "é à ü é à ü é à ü é à ü", "w " * 3000, "one two  three\tfour"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, f"s{i % 3}", "clash") for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words string")


def test_base_metrics_equal_brute_force(spark):
    trusted = spark.createDataFrame([(3,)], "_trusted_id long")
    for r in rules.quality_scores(docs(spark), trusted).collect():
        text = TEXTS[r.doc_id] or ""
        w = WORD.findall(text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_ratio_counts_equal_brute_force(spark):
    found = rules.counts(docs(spark), spark.createDataFrame([(3,), (6,)], "_trusted_id long"), bits=10)
    words = [len(WORD.findall(t or "")) for t in TEXTS]
    grams = [n + max(n - 1, 0) for n in words]
    assert found.sum(axis=1).tolist() == [grams[3] + grams[6], sum(grams)]


def test_few_labels_reject_junk_but_no_clean_text(spark):
    rng = random.Random(5)
    clean = [" ".join(f"w{int(rng.paretovariate(0.5)) % 3000}x{rng.randrange(3)}" for _ in range(80)) for _ in range(60)]
    junk = [" ".join(rng.choices([f"click{i}" for i in range(12)], k=80)) for _ in range(20)]
    texts = [*clean, *junk]
    trusted = spark.createDataFrame([(i,) for i in range(20)], "_trusted_id long")
    got = {r.doc_id: r for r in rules.quality_scores(docs(spark, texts), trusted).collect()}
    grams = [[b for _, bucket in rules.ngrams(bs.scan(*bs.text_bytes(pa.array([t]))), rules.BITS) for b in bucket.tolist()] for t in texts]
    raw, target = Counter(g for d in grams for g in d), Counter(g for d in grams[:20] for g in d)
    share = target.total() / raw.total()
    for i, d in enumerate(grams):
        llr = sum(np.log((target[g] + 5) / (share * raw[g] + 5)) for g in d) / len(d)
        assert len(d) == 159 and abs(got[i].llr - llr) < 1e-9
        assert got[i].base_failed or got[i].kept == (i < 60)
    assert sum(not got[i].base_failed for i in range(20, 60)) > 30 and sum(not got[i].base_failed for i in range(60, 80)) > 10


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    out = [pii.feistel(i, size, b"t", KEY) for i in range(size)]
    assert sorted(out) == list(range(size))
    assert [pii.feistel(v, size, b"t", KEY, undo=True) for v in out] == list(range(size))
    assert size < 97 or out != [pii.feistel(i, size, b"t", b"other") for i in range(size)]


def test_pseudonyms_keep_format_and_links(spark):
    text = 'Mail joe.12@mail3.example.com, card 4111 1111 1111 1111, not 4111111111111112, call +1 (555) 555-1234 from 10.20.30.40 on 2024-02-29, token = "0123456789abcdef0123456789abcdef01234567".'
    rows = pii.pseudonyms(docs(spark, [text, text, None, "", "clean 1234 text"]), KEY).orderBy("doc_id").collect()
    assert rows[0].text == rows[1].text and rows[0].n_found == 6
    assert rows[2].text is None and rows[3].text == "" and rows[4].text == "clean 1234 text"
    for value in ("joe.12@", "4111 1111 1111 1111", "555-1234", "10.20.30.40", "2024-02-29", "0123456789abcdef0123456789abcdef01234567"):
        assert value not in rows[0].text
    assert "4111111111111112" in rows[0].text
    new = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", rows[0].text)[1]
    assert pii.card(new, KEY, undo=True) == "4111 1111 1111 1111"
    assert pii.date(pii.date("2024-02-29", KEY), KEY, undo=True) == "2024-02-29"
    assert pii.ssn(pii.ssn("123-45-6789", KEY), KEY, undo=True) == "123-45-6789"
    assert pii.iban("DE89370400440532013000", KEY) != "DE89370400440532013000"
    (a, b, kind, new), = pii.find("pay to DE89 3704 0044 0532 0130 00 BY FRIDAY", KEY)
    assert (a, b, kind) == (7, 34, "iban") and new != "DE89 3704 0044 0532 0130 00"
    assert len(pii.find("mail a.b@mail.example.com or 10.1.2.3, " * 5000, KEY)) == 10000


@pytest.mark.parametrize("text", ["C 12/27", "C 123", "C-123", "order 7 C", "7 C 12/27 123", "2024-02-29 C", "123-45-6789 C 9", "1 2 3 4 5 6 7 8 9 C", "C 12 C", "12.99 C 5", "C and C"])
@pytest.mark.parametrize("number", ["4111 1111 1111 1111", "4111111111111111", "3782 822463 10005", "4111-1111-1111-1111"])
def test_cards_beside_other_numbers(text, number):
    text = text.replace("C", number)
    new, spans = pii.rewrite(text, KEY)
    covered = {i for a, b, _, _ in spans for i in range(a, b)}
    for m in re.finditer(re.escape(number), text):
        assert covered >= set(range(m.start(), m.end())) and new[m.start() : m.end()] != number
    assert len(new) == len(text)


def test_cards_are_taken_whole_and_other_runs_stay():
    for text in ("4111 1111 1111 1111 12/27", "order 7 4111 1111 1111 1111"):
        (a, b, kind, new), = pii.find(text, KEY)
        assert (text[a:b], kind, new) == ("4111 1111 1111 1111", "card", pii.card("4111 1111 1111 1111", KEY))
    assert pii.find("4111 1111 1111 1112 12/27", KEY) == [] and pii.find("x4111 1111 1111 1111", KEY) == [] and pii.find("4111 1111 1111 1111x", KEY) == []
    assert pii.find("4" * 100_000, KEY) == [] and len(pii.find("4111 1111 1111 1111 " * 5000, KEY)) == 5000


VALUES = {
    "email": (pii.email, ["jo.doe@mail.example.com", "büro.größe9@alice.co.uk", "ひらがな@host.jp", "Ω1@a-b.org"]),
    "phone": (pii.phone, ["+1 (555) 123-4567", "555-123-4567", "(555) 123-4567", "+49 30 1234567", "+44.20.7946.0958"]),
    "ssn": (pii.ssn, ["123-45-6789", "899 99 9999", "665-01-0001", "667-01-0001"]),
    "date": (pii.date, ["2024-02-29", "1999/12/31", "31.12.1999", "01/02/2003", "12/31/1999", "4.5.1990", "4.12.1990", "24.5.1990", "1/31/1999", "2099-12-31"]),
    "ipv4": (pii.ipv4, ["10.0.0.1", "255.255.255.255"]),
    "ipv6": (pii.ipv6, ["2001:db8::ff00:42:8329", "::1", "FE80:0:0:0:1:2:3:4"]),
    "iban": (pii.iban, ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]),
    "card": (pii.card, ["4111-1111-1111-1111", "378282246310005"]),
    "secret": (pii.secret, ["0123456789abcdef0123", "AKIA_x9/Z+q=" * 5]),
}


@pytest.mark.parametrize("kind", VALUES)
def test_pseudonyms_keep_the_form_and_can_be_undone(kind):
    f, values = VALUES[kind]
    news = [f(v, KEY) for v in values]
    for v, new in zip(values, news, strict=True):
        assert new != v and f(new, KEY, undo=True) == v and f(new, KEY) is not None
        form = lambda x: [c.isalnum() if kind in ("ipv6", "secret") else c.isdigit() + 2 * c.isalpha() for c in x]  # noqa: E731, B023
        assert kind == "ipv4" or form(new) == form(v)
    assert len(set(news)) == len(values)


def test_every_date_of_a_notation_stays_one_to_one():
    for form in ("{m}/{d}/{y}", "{d}.{m}.{y}", "{d:02d}/{m:02d}/{y}"):
        own = {form.format(y=y, m=m, d=d) for y in (1999, 2000) for m in range(1, 13) for d in range(1, 29)}
        new = {pii.date(v, KEY) for v in own}
        assert len(new) == len(own) and {pii.date(v, KEY, undo=True) for v in new} == own


def test_values_stay_linked_between_notations():
    digits = lambda s: re.sub(r"\D", "", s)
    one = lambda f, *v: {digits(f(x, KEY)) for x in v}
    assert len(one(pii.phone, "555-123-4567", "(555) 123-4567", "555.123.4567") | {digits(pii.phone("+1 555 123 4567", KEY))[1:]}) == 1
    assert len(one(pii.ssn, "123-45-6789", "123 45 6789")) == 1
    a, b = pii.date("2024-02-29", KEY), pii.date("29.02.2024", KEY)
    assert a.split("-") == b.split(".")[::-1]


def test_what_is_found_and_what_is_left():
    kinds = lambda t: [(k, t[a:b]) for a, b, k, _ in pii.find(t, KEY)]
    assert kinds("at 2024-02-29T10:00:00 or 4.5.1990, 12/31/1999") == [("date", "2024-02-29"), ("date", "4.5.1990"), ("date", "12/31/1999")]
    assert kinds("123 45 6789 and 2001:db8::1 end") == [("ssn", "123 45 6789"), ("ipv6", "2001:db8::1")]
    assert kinds("password = hunter2xyz and token: abc") == [("bare secret", "hunter2xyz")]
    for clean in ("5551234567", "at 10:20:30 and 1:2", "a::b std::vector", "version 1.2.3", "ratio 3/4/5", "31/31/1999 2024-13-01", "password = forgotten", "the key: somewhere1 else"):
        assert kinds(clean) == []


def test_pseudonyms_of_unusual_tables(spark):
    rows = [(None, "call 555-123-4567", "x"), (None, "call 555-123-4567", "x"), ("seven", None, "y"), ("7", "", "z")]
    t = spark.createDataFrame(rows, "doc_id string, text string, found string")
    got = pii.pseudonyms(t, KEY).collect()
    assert sorted((r.doc_id or 0, r.n_found) for r in got) == [(0, 0), (0, 1), (0, 1), (7, 0)] and len({r.text for r in got if r.n_found}) == 1
    assert pii.pseudonymize(t.limit(0), KEY).columns == t.columns and pii.pseudonyms(t.limit(0), KEY).count() == 0


def test_packing_is_gapless_and_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*TEXTS, " lead and trail ", "tab\t tab \n\n  x", "it's 's  don't"]
    rows = packing.pack(docs(spark, texts)).collect()
    own = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(own[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert k == 0 or r.length == 1024
            at += r.length
        assert at == len(ids)
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024


SPACES = ["a", "bc", " ", "  ", "\n", "\t", " \n", "\u00a0", "é", "ß", "'s", "'", "it's", "12", "!", "。", "\u3000", "\u2003", "<|endoftext|>", "\x85", "\u180e", "\r\n", "\x1c", "\x0b", "x y", "日本"]


@pytest.mark.parametrize("most", [0, 50, 10_000])
def test_ids_of_parts_are_the_tokenizers(most):
    import public_tokenizers

    rng = random.Random(most)
    texts = ["one <|endoftext|> two", "", " x", "y " * 50, "z" * 300 + " z", *("".join(rng.choices(SPACES, k=rng.randrange(14))) for _ in range(4000))]
    memo = packing.WordMemo(public_tokenizers.path("byte_bpe_50k.json"), most)
    want = [e.ids for e in memo.encoder.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [505, 220, 50256, 734]
    for i in range(0, len(texts), 500):
        ids, first = memo.ids(*bs.text_bytes(pa.array(texts[i : i + 500])))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want[i : i + 500]


def best_fit_decreasing(lengths, capacity):
    gaps: list[int] = []
    for size in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= size]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - size)
    return len(gaps)


def test_one_task_packs_as_sequential_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(10):
        counts = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(20)}
        assert packing.decreasing(counts, 64)["sequences"] == best_fit_decreasing([s for s, n in counts.items() for _ in range(n)], 64)


def test_a_sweep_gives_each_piece_the_smallest_free_gap():
    rng = np.random.default_rng(3)
    for _ in range(50):
        rows = sorted([(-int(s), 0) for s in rng.integers(1, 40, 15)] + [(-int(s), 1) for s in rng.integers(1, 40, 20)])
        size, piece = np.array([-s for s, _ in rows]), np.array([k == 1 for _, k in rows])
        cuts = [0, *sorted(rng.integers(0, len(rows), 3).tolist()), len(rows)]
        want, free = {}, []
        for i in range(len(rows)):
            if not piece[i]:
                free.append(i)
            elif free:
                want[i] = size[free.pop()]
        got, left, over, counts = {}, {}, {}, []
        for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            p, g, rest, slots = packing.sweep(size[a:b], piece[a:b], np.ones(b - a, np.int64))
            got |= {a + int(i): size[a + int(j)] for i, j in zip(p, g, strict=True)}
            left[part], over[part] = a + rest, a + slots
            counts.append((part, len(rest), len(slots)))
        for part, rank, other, end, n, _ in packing.meet(counts).tolist():
            got |= {int(left[part][rank + k]): size[over[other][end - 1 - k]] for k in range(n)}
        assert got == want


@pytest.mark.parametrize("lengths", ["mixed", "ones", "none"])
def test_rounds_over_many_ranges_pack_like_one(spark, monkeypatch, lengths):
    monkeypatch.setattr(packing, "ROWS", 400)
    rng = random.Random(8)
    own = {"mixed": [rng.choice([1, 3, rng.randint(1, 600), rng.randint(1, 1024)]) for _ in range(1500)], "ones": [1] * 900, "none": []}[lengths]
    scratch = Scratch(spark, "test")
    pieces = scratch.save(spark.createDataFrame(list(enumerate(own)), "uid long, length long"))
    rows = packing.best_fit(pieces, scratch).collect()
    assert sorted((r.uid, r.length) for r in rows) == list(enumerate(own))
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == np.cumsum([0, *[n for _, n in sorted(p)][:-1]]).tolist() and sum(n for _, n in p) <= 1024
    assert len(places) <= best_fit_decreasing(own, 1024) + 3


def test_packed_pieces_carry_their_ids(spark):
    rows = packing.pack(docs(spark, [*TEXTS, "many words " * 900]), with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(docs(spark).limit(0)).count() == 0
    again = spark.createDataFrame([(None, "x y"), (None, "x y"), (5, None), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.length) for r in packing.pack(again).collect()) == [(-1, 3), (-1, 3), (5, 1), (5, 1)]


def test_archives_round_trip_and_damage(spark):
    pages = spark.createDataFrame([(1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c", None), (4, "http://d", ""), (None, None, "ü")], "page_id long, url string, html string")
    archives = warc.write_archives(pages, Scratch(spark, "test"))
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert (got[1].record_type, got[2].record_type, got[2].refers_to, got[2].payload_bytes) == ("response", "revisit", 1, 4)
    assert (got[3].record_type, got[4].refers_to, got[None].payload) == ("response", 3, bytearray("ü".encode()))
    good = [warc.record(i, "u", b"x" * 500, warc.digest32(b"x" * 500), None, False) for i in range(3)]
    bad = good[0] + good[1][:40] + b"\x00" * 40 + good[1][80:] + good[2]
    for step in (1, 2, 7, 100, 10_000):
        seen = [warc.parse(d) if e is None else {"error": e} for d, e in warc.members([bad[i : i + step] for i in range(0, len(bad), step)])]
        assert (seen[0]["error"], seen[0]["page_id"], seen[-1]["error"], seen[-1]["page_id"]) == (None, 0, None, 2) and any(s["error"] for s in seen)


def test_revisits_name_their_original(spark):
    pages = spark.createDataFrame([(3, "http://b\n", "same"), (2, "http://a", "same"), (2, "http://a", "same"), (7, None, "long " * 100_000)], "page_id long, url string, html string")
    blob = b"".join(bytes(r.content) for r in warc.write_archives(pages, Scratch(spark, "test")).collect())
    heads = [dict(x.split(": ", 1) for x in d.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for d, _ in warc.members([blob])]
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert heads[0]["WARC-Type"] == "warcinfo" and Counter(h["WARC-Type"] for h in heads)["response"] == 3
    (again,) = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert ids[again["WARC-Refers-To"]]["X-Page-ID"] == "2" and again["WARC-Refers-To-Target-URI"] == "http://a" and again["WARC-Target-URI"] == "http://b%0A"
    assert warc.read_archives(warc.write_archives(pages.limit(0), Scratch(spark, "test"))).count() == 0


def test_archives_are_alike_by_join_and_broadcast(spark, monkeypatch):
    rows = [(i, "u", f"text {i % 30}" if i % 3 else "") for i in range(200)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, _sha string")
    read = lambda: sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages, Scratch(spark, "test"))).collect())
    first = {}
    for i, _, t in rows:
        first.setdefault(t, i)
    want = [(i, "response" if first[t] == i else "revisit", None if first[t] == i else first[t]) for i, _, t in rows]
    assert read() == want
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert read() == want


def brute_mixture(rows, target, exponent, hashes):
    """(id, epoch, block) of each draw: whole and last, partial passes over each source in the order of hashes."""
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    power = {s: (n / total.total()) ** exponent for s, n in total.items()}
    weight = {s: x / sum(power.values()) for s, x in power.items()}
    most = max(total.values())
    out = []
    for s, n in total.items():
        budget = target.budget_tokens * weight[s] if target.budget_tokens else n * max(1.0, (most / n) ** (1 - exponent))
        at, epoch = 0, 0
        while at < budget - 1e-6:
            epoch += 1
            for _, i, size in sorted((hashes[i, epoch] % 2**64 >> 1, i, size) for i, t, size in rows if t == s):
                if at < budget - 1e-6:
                    out.append((i, epoch, int(at / (weight[s] * target.block_tokens))))
                at += size
    return sorted(out), weight


@pytest.mark.parametrize("target", [mixing.Target(block_tokens=50), mixing.Target(entropy=0.97, block_tokens=40), mixing.Target(budget_tokens=500, block_tokens=70), mixing.Target(budget_tokens=2000, max_passes=3.0), mixing.Target(entropy=0.9, budget_tokens=300)])
def test_mixture_equals_brute_force(spark, target):
    rng = random.Random(4)
    own = [(i, rng.choice(["a", "a", "a", "a", "b", "b", None]), rng.randint(0, 9)) for i in range(120)]
    t = spark.createDataFrame([(i, s, "w " * n if n else None, "x") for i, s, n in own], "doc_id long, source string, text string, Source2 string")
    rows = [(i, s, max(n, 1)) for i, s, n in own]
    hashed = t.select("doc_id", *[mixing.order_hash(F.col("source"), F.col("doc_id"), F.xxhash64("text"), F.lit(e), target.seed).alias(f"h{e}") for e in range(1, 60)]).collect()
    hashes = {(r.doc_id, e): r[f"h{e}"] for r in hashed for e in range(1, 60)}
    scratch = Scratch(spark, "test")
    a = mixing.exponent(scratch.save(t.groupBy("source").agg(F.sum(mixing.tokens(F.col("text"))).alias("tokens"))), target)
    want, weight = brute_mixture(rows, target, a, hashes)
    got = mixing.mixture(t, target).collect()
    assert sorted((r.doc_id, r.epoch, r.block) for r in got) == want
    assert all(abs(r.weight - weight[r.source]) < 1e-9 for r in got)
    total = Counter()
    for _, s, n in rows:
        total[s] += n

    def met(a):
        w = {s: (n / total.total()) ** a for s, n in total.items()}
        w = {s: x / sum(w.values()) for s, x in w.items()}
        if target.entropy:
            return -sum(x * np.log(x) for x in w.values()) >= target.entropy * np.log(len(w))
        if target.budget_tokens:
            return max(target.budget_tokens * w[s] / n for s, n in total.items()) <= target.max_passes
        return (max(total.values()) / min(total.values())) ** (1 - a) <= target.max_passes

    step = -1e-5 if not target.entropy else 1e-5
    assert a in (0.0, 1.0) or (met(a - step / 2) and not met(a + step))
    copies = Counter(r._epoch for r in mixing.mix(t, target, epoch="_epoch").collect())
    assert copies == Counter(e for _, e, _ in want)


def test_mixing_takes_all_and_keeps_the_limit(spark):
    d = docs(spark, [f"{'word ' * (i % 7 + 1)}" for i in range(60)] + [None, ""])
    n = Counter(r.doc_id for r in mixing.mix(d).collect())
    m = Counter(r.doc_id for r in mixing.mixture(d).collect())
    assert n == m and set(n) == set(range(62)) and max(n.values()) <= 2
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.mixture(d.limit(0)).count() == 0


@pytest.mark.parametrize("n, hot", [(200, 0), (1000, 0), (4000, 1500)])
def test_groups_stay_whole_in_balanced_shards(spark, n, hot):
    rng = random.Random(n)
    texts = ["w " * rng.randint(1, 60) + str(i) for i in range(n - hot)]
    texts += [rng.choice(texts[:40]) for _ in range(n // 5)] + ["the hot text"] * hot + [None, None, "", ""]
    rows = sharding.shard(docs(spark, texts)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    loads, slots, homes = defaultdict(lambda: np.zeros(3)), defaultdict(list), defaultdict(set)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.tokens) == (len(text.encode()) + 8, zlib.crc32(text.encode()), len(WORD.findall(text)))
        loads[r.shard] += (r.size, r.tokens, 1)
        slots[r.shard].append(r.slot)
        homes[texts[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert all(len(s) == 1 for t, s in homes.items() if t != "the hot text") and len(homes["the hot text"]) != 1
    load = np.array(list(loads.values()))
    assert len(load) == 24 and (load[:, 0].max() / load[:, 0].min() < (1.5 if n == 200 else 1.02))
    assert n == 200 or (load.max(axis=0) / load.mean(axis=0)).max() < 1.1


def test_shards_of_unusual_tables(spark):
    assert sharding.shard(docs(spark).limit(0)).count() == 0
    same = spark.createDataFrame([(7, "one text", 1)] * 300 + [(None, "x " * 2000, 2)], "doc_id long, text string, shard int")
    rows = sharding.shard(same, shards=4).collect()
    assert len(rows) == 301 and len({(r.shard, r.slot) for r in rows}) == 301 and {r.shard for r in rows} == {0, 1, 2, 3}


def test_search_equals_brute_force():
    rng = np.random.default_rng(0)
    v = rng.integers(-40, 40, (300, 8)).astype(float)
    v[10:20] = v[3]
    ids = np.arange(300)
    depths = []
    for q, rows, scores, depth in topk.nra(v[:30], ids[:30], v, ids, 10):
        want = sorted((-(v[i] @ v[q]), i) for i in range(300) if i != q)[:10]
        got = sorted(zip(-scores, rows, strict=True))[:10]
        assert got == want
        depths.append(depth)
    assert len(depths) == 30 and sum(d < 1 for d in depths) > 15


def test_search_stops_early_on_random_vectors():
    rng = np.random.default_rng(1)
    v = np.floor(1024 * rng.normal(0, 0.125, (2000, 64)))
    assert sum(depth < 1 for *_, depth in topk.nra(v[:20], np.arange(20), v, np.arange(2000), 10)) > 10


def test_search_over_unusual_tables(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.999]) for _ in range(4)], "x") for i in range(40)]
    rows += [(100, None, "x"), (101, [0.1, None, 0.2, 0.3], "x"), (102, [float("nan")] * 4, "x"), (103, [float("inf"), 0.0, 0.0, 0.0], "x"), (104, [0.5, 0.5], "x"), (105, [0.5, 0.25], "x"), (106, [], "x"), (None, [0.5] * 4, "x"), (3, [0.999] * 4, "x"), (3, [0.999] * 4, "x")]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = defaultdict(list)
    for r in topk.top_k(t, t.where("vec_id in (0, 3, 5, 100, 101, 103, 104)"), k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    fine = [(i, [np.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q in (0, 3, 5, 104):
        own = min([float(np.float32(x)) for x in v] for i, v, _ in rows if i == q)
        own = [np.floor(1024 * x) for x in own]
        best = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in fine if i != q and len(v) == len(own))[:5]
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert dict(got) == want
    assert topk.top_k(t.limit(0), t.limit(0)).count() == 0 and topk.top_k(t, t.limit(0)).count() == 0


def test_chats_round_trip_natively(spark):
    texts = ["</s>[INST] ok [/INST]", "\\</s>\\\\[INST]", "<\\/s>", "", None, "plain"]
    rows = [(c, k, ("user", "assistant")[k % 2], texts[(c + k) % 6], 1) for c in range(6) for k in range(4)] + [(9, 0, "assistant", "bad order", 1)]
    f = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra int"))
    for r in f.select("conv_id", "valid", "error_turn", chat.parse_chats(f.formatted).alias("b"), chat.loss_text(f.segments).alias("l")).collect():
        own = sorted(x for x in rows if x[0] == r.conv_id)
        assert [(b.role, b.text) for b in r.b] == [(x[2], x[3] or "") for x in own]
        assert r.l == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.valid == (r.conv_id != 9)


def test_scan_of_slices_with_offsets():
    import pyarrow as pa

    data, offs = bs.text_bytes(pa.array(["x", "ab c", None, "d"]).slice(1))
    s = bs.scan(data, offs)
    assert s.counts.tolist() == [2, 0, 1]


def test_scores_equal_brute_force(spark):
    texts = [*TEXTS, "großes Ähre ab abc abcd abcdef ab abc"]
    weights = np.random.default_rng(3).normal(0, 1, 1 << classifier.BITS).astype(np.float32)
    bucket = lambda parts: [b for p in parts for b in p.tolist()]
    seen: dict[int, str] = {}
    for text in texts:
        s = bs.scan(*bs.text_bytes(pa.array([text], pa.string())))
        words = WORD.findall(text or "")
        want = [("w", w) for w in words] + [("p", *p) for p in zip(words[:-1], words[1:], strict=True)]
        want += [("c", w[i : i + n]) for n in classifier.RUNS for w in words for i in range(len(w) - n + 1) if len(w) > n]
        got = bucket(b for _, b in classifier.features(s))
        assert len(got) == len(want)
        # equal features share a bucket, and buckets tell features apart
        for name, b in zip(want[: len(words) * 2], got[: len(words) * 2], strict=True):
            name = ("equal",) if name[0] == "p" and name[1] == name[2] else name
            assert seen.setdefault(b, name) == name
        runs = Counter(n for n in want if n[0] == "c")
        assert sorted(Counter(got[len(want) - sum(runs.values()) :]).values()) == sorted(runs.values())
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    known = classifier.examples(docs(spark, texts), labels)
    table, bias = classifier.train(known)
    for r in classifier.quality_classifier(docs(spark, texts), labels).collect():
        b = bucket(b for _, b in classifier.features(bs.scan(*bs.text_bytes(pa.array([texts[r.doc_id]], pa.string())))))
        assert abs(r.score - 1 / (1 + np.exp(-(np.mean(table[b]) if b else 0) - bias))) < 1e-6
    assert weights.shape == table.shape


def test_examples_are_bounded_where_ids_repeat(spark):
    t = spark.createDataFrame([(1, f"text {i}") for i in range(30)] + [(None, "x"), (2, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert len(classifier.examples(t, labels, rows=5)) == 5
    assert classifier.quality_classifier(t, labels, rows=5).count() == 32


def test_verdicts_of_unusual_tables(spark):
    text = " ".join(f"w{i}" for i in range(40))
    t = spark.createDataFrame([("1", text, "x", 0), ("1", text, "x", 0), ("one", text, "x", 0), (None, None, None, None), ("2", "long " * 60_000, "x", 1)], "doc_id string, text string, Text string, kept int")
    trusted = spark.createDataFrame([(1,), (1,)], "_trusted_id long").distinct()
    got = rules.quality_scores(t, trusted).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == [(0, 0, False), (0, 40, True), (1, 40, True), (1, 40, True), (2, 60_000, False)]
    kept = rules.quality_filter(t, trusted)
    assert kept.columns == t.columns and kept.count() == 3
    assert rules.quality_scores(t.limit(0), trusted).count() == 0 and rules.quality_filter(t.limit(0), trusted).count() == 0


def test_chats_of_unusual_tables(spark):
    t = spark.createDataFrame([("x", 0, "user", "a " * 50_000, 1), (None, 1, "assistant", "b", 1), ("3", None, None, None, 1), ("3", None, None, None, 1)], "conv_id string, turn long, role string, text string, Text2 int")
    assert sorted((r.conv_id or 0, r.n_turns) for r in chat.format_chats(t).collect()) == [(0, 2), (3, 2)]
    assert chat.format_chats(t.limit(0)).count() == 0


def test_classifier_learns_held_out_labels(spark):
    rng = random.Random(7)
    good, bad = ["river", "stone", "bridge", "harvest", "lantern"], ["click", "buy", "win", "cash", "prize"]
    texts = [" ".join(rng.choices(good if i % 2 else bad, k=rng.choice([12, 200]))) for i in range(300)] + ["", None]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, quality int")
    rows = classifier.quality_classifier(docs(spark, texts), labels).collect()
    assert len(rows) == 302 and {r.doc_id for r in rows} == set(range(302))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.doc_id >= 300 or not r.held_out or r.predicted == r.doc_id % 2
    assert classifier.quality_classifier(docs(spark, texts).limit(0), labels).count() == 0
    assert {r.score for r in classifier.quality_classifier(docs(spark, texts), labels.limit(0)).collect()} == {0.5}
