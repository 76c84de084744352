"""Operator 10, personal data: format-preserving Feistel pseudonyms.

Found and validated: payment cards (Luhn), IBANs (mod 97), US social security numbers, phone numbers, IPv4 and IPv6 addresses,
calendar dates (also with a time behind them), e-mail addresses, and secrets given as ``token = "..."`` and the like. Each value is
permuted by a keyed Feistel network inside the set of values of its format and goes back in its place with its separators, its case
and its check digits valid again. The permutation depends on the key, the kind and the format alone, so equal
values get equal pseudonyms in all documents and on all executors, different values stay different, and who holds the
key can undo it. The key is an argument without a default. Each text is handled whole in one pass; nothing is shuffled.

Equal cards, IBANs, social security and phone numbers stay linked however they are grouped, and a phone number of ten digits with that behind +1;
dates stay linked between notations with the same range (a date such as 12/31/1999 can only be month first, and is permuted among
such dates; one with a single digit among those of its lengths). Unbroken runs of ten digits are not taken for phone numbers.

Defined cases: a null text stays null and has no findings; an empty table gives no rows; digit runs that fail validation stay as they are, but a
card is found beside other numbers one space or hyphen away; ids may repeat or be null (as are those that aren't whole numbers); repeated rows
are rewritten alike; other columns of documents, of whatever names, are ignored by ``pseudonyms`` and passed through by ``pseudonymize``.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import ipaddress
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.columns import numbered, pick, place, whole
from siltstone.scratch import ready_workers

ROUNDS = 8
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def feistel(value: int, size: int, tweak: bytes, key: bytes, undo: bool = False) -> int:
    """A keyed permutation of 0..size-1: alternating modular Feistel over a * b >= size, walked until it lands inside."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8 + 8

    def f(i: int, half: int, modulus: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d|%d|%d|" % (i, size, half) + tweak, key=key[:64], digest_size=min(64, width)).digest(), "big") % modulus

    while True:
        left, right = divmod(value, b)
        for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            sign = -1 if undo else 1
            if i % 2:
                right = (right + sign * f(i, left, b)) % b
            else:
                left = (left + sign * f(i, right, a)) % a
        value = left * b + right
        if value < size:
            return value


@functools.lru_cache(4096)
def alphabet(c: str) -> str:
    """Characters that ``c`` may become: a digit or letter of ASCII those of its class, others those of its general category among 256 neighbours; none if it is neither."""
    for known in (DIGITS, LOWER, UPPER):
        if c in known:
            return known
    if c.isascii() or not c.isalnum():
        return ""
    first = ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(first, first + 256)) if not x.isascii() and x.isalnum() and unicodedata.category(x) == unicodedata.category(c))


def permute_chars(s: str, tweak: bytes, key: bytes, undo: bool = False) -> str:
    """Permutes digits and letters inside their classes; all other characters stay where they are.

    Long values are permuted in blocks of 32 characters, each tweaked by its place.
    """
    return _permute(s, [alphabet(c) for c in s], tweak, key, undo)


def permute_hex(s: str, tweak: bytes, key: bytes, undo: bool = False) -> str:
    low = s.lower()
    out = _permute(low, [HEX if c in HEX else "" for c in low], tweak, key, undo)
    return out if low == s else out.upper()


def _permute(s: str, alphabets: list[str], tweak: bytes, key: bytes, undo: bool) -> str:
    out = list(s)
    at = [i for i, a in enumerate(alphabets) if a]
    shape = "".join("d" if a == DIGITS else "h" if a == HEX else "l" if a == LOWER else "u" if a == UPPER else a[0] if a else "-" for a in alphabets).encode()
    for k in range(0, len(at), 32):
        size, value = 1, 0
        for i in at[k : k + 32]:
            size *= len(alphabets[i])
            value = value * len(alphabets[i]) + alphabets[i].index(s[i])
        value = feistel(value, size, tweak + b"|" + shape + b"|%d" % k, key, undo)
        for i in reversed(at[k : k + 32]):
            value, r = divmod(value, len(alphabets[i]))
            out[i] = alphabets[i][r]
    return "".join(out)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """Puts digits in the places of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def card(s: str, key: bytes, undo: bool = False) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or luhn_digit(d[:-1]) != d[-1]:
        return None
    payload = permute_chars(d[:-1], b"card", key, undo)
    return _refill(s, payload + luhn_digit(payload))


#: 16 to 19 digits by four, or 14 and 15 as four, six and the rest, or unbroken.
CARD_GROUPS = re.compile(r"(?:dddd[ -]){3}dddd(?:[ -]?d{1,3})?|dddd[ -]d{6}[ -]d{4,5}|d+")


def cards(text: str, start: int, end: int, taken: bytearray, key: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of the cards in a run of digit groups, which may hold other numbers too, from group border to group border.

    Runs grouped as cards are written come first, then longer ones first, since one in ten other runs passes Luhn too. The caller marks each one in ``taken`` before it asks for the next.
    """
    groups = [(start + m.start(), start + m.end()) for m in re.finditer(r"\d+", text[start:end])]
    tried = []
    for i, (a, _) in enumerate(groups):
        n = 0
        for c, b in groups[i : i + 19]:
            n += b - c
            if n > 19 or taken.find(1, a, b) >= 0:
                break
            if n >= 13:
                tried.append((not CARD_GROUPS.fullmatch(re.sub(r"\d", "d", text[a:b])), -n, a, b))
    for *_, a, b in sorted(tried):
        if taken.find(1, a, b) < 0 and (new := card(text[a:b], key)) is not None:
            yield a, b, new


def iban(s: str, key: bytes, undo: bool = False) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34:
        return None
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = permute_chars(flat[4:], b"iban" + flat[:2].encode(), key, undo)
    new = iter(flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


def ssn(s: str, key: bytes, undo: bool = False) -> str | None:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (int(x) for x in re.split("[- ]", s))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    v = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    v, serial = divmod(feistel(v, 898 * 99 * 9999, b"ssn", key, undo), 9999)
    area, group = divmod(v, 99)
    return _refill(s, f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}")


def phone(s: str, key: bytes, undo: bool = False) -> str | None:
    """The country code that follows + stays; the other digits are permuted, however they are grouped. Ten digits without one count as +1's."""
    head = re.match(r"\+\d{1,3}(?=\D)", s)
    rest = s[head.end() :] if head else s
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 14:
        return None
    code = head[0] if head else "+1" if len(digits) == 10 and s[0] != "+" else ""
    return (head[0] if head else "") + _refill(rest, permute_chars(digits, b"phone" + code.encode(), key, undo))


def ipv4(s: str, key: bytes, undo: bool = False) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    v = feistel(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ipv4", key, undo)
    return ".".join(map(str, v.to_bytes(4, "big")))


def ipv6(s: str, key: bytes, undo: bool = False) -> str | None:
    """The hexadecimal digits are permuted; colons and the lengths of the groups stay."""
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return None
    return permute_hex(s, b"ipv6", key, undo)


#: Order and separators of a date's parts.
DATES = (("ymd", re.compile(r"(\d{4})([-/])(\d\d)\2(\d\d)")), ("dmy", re.compile(r"(\d\d?)([./])(\d\d?)\2(\d{4})")))


@functools.lru_cache
def _days(month_first: bool, day_digits: int, month_digits: int) -> list[int]:
    """The days that a notation with a range of its own can write."""
    days = map(datetime.date.fromordinal, range(FIRST_DAY, LAST_DAY + 1))
    fits = lambda x, n: n == 2 or x < 10
    own = lambda x, n, other: x >= 10 if n == 2 and other == 1 else fits(x, n)
    return [d.toordinal() for d in days if (d.day > 12 or not month_first) and own(d.day, day_digits, month_digits) and own(d.month, month_digits, day_digits)]


def date(s: str, key: bytes, undo: bool = False) -> str | None:
    """yyyy-mm-dd, yyyy/mm/dd, d.m.yyyy or d/m/yyyy, or m/d/yyyy where that is the only way to read it, from 1900 to 2099, permuted among the days of its notation."""
    for order, pattern in DATES:
        if m := pattern.fullmatch(s):
            break
    else:
        return None
    year, month, day = (m[1], m[3], m[4]) if order == "ymd" else (m[4], m[3], m[1])
    month_first = order == "dmy" and int(month) > 12
    if month_first:
        month, day = day, month
    try:
        v = datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= v <= LAST_DAY:
        return None
    n_day, n_month = len(day), len(month)
    if month_first or n_day + n_month < 4:
        days = _days(month_first, n_day, n_month)
        at = bisect.bisect_left(days, v)
        if at == len(days) or days[at] != v:
            return None
        v = days[feistel(at, len(days), b"date%d%d%d" % (month_first, n_day, n_month), key, undo)]
    else:
        v = feistel(v - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, b"date", key, undo) + FIRST_DAY
    d = datetime.date.fromordinal(v)
    if order == "ymd":
        return f"{d.year:04d}{m[2]}{d.month:02d}{m[2]}{d.day:02d}"
    first, second = f"{d.day:0{n_day}d}", f"{d.month:0{n_month}d}"
    if month_first:
        first, second = second, first
    return f"{first}{m[2]}{second}{m[2]}{d.year:04d}"


def email(s: str, key: bytes, undo: bool = False) -> str | None:
    """The local part and the domain's labels are permuted but for the last one, and the short one before a last one of two letters, as in co.uk."""
    local, _, domain = s.rpartition("@")
    labels = domain.split(".")
    if not local or len(labels) < 2 or not all(labels):
        return None
    kept = 2 if len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3 else 1
    host = ".".join(labels[:-kept])
    return permute_chars(local, b"local", key, undo) + "@" + ".".join([permute_chars(host, b"host", key, undo), *labels[-kept:]])


def secret(s: str, key: bytes, undo: bool = False) -> str | None:
    f = permute_hex if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) else permute_chars
    return f(s, b"secret", key, undo)


#: Tried in this order at each place; the first that matches and validates wins.
KINDS: dict[str, tuple[str, Callable[..., str | None]]] = {
    "email": (r"[\w.+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+", email),
    "secret": (r"""(?<=["'])[A-Za-z0-9_/+=-]{16,}(?=["'])""", secret),
    "bare secret": (r"(?<=[:=\s])[A-Za-z0-9_/+=!@#$%^&*.-]{8,}(?![\w])", secret),
    "ipv6": (r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{2,39}(?![\w:]|\.\d)", ipv6),
    "ipv4": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])(?!\.\d)", ipv4),
    "date": (r"(?<![\w./-])(?:\d{4}([-/])\d\d\1\d\d|\d\d?([./])\d\d?\2\d{4})(?:(?![\w/-])(?!\.\d)|(?=T\d\d:))", date),
    "ssn": (r"(?<![\w-])\d{3}([- ])\d\d\1\d{4}(?![\w-])", ssn),
    "iban": (r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]){11,30}(?!\w)", iban),
    "card": (r"(?<![\w])\d(?:[ -]?\d){12,}(?![\w])", card),
    "phone": (r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w+(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])", phone),
}
PATTERNS = {k: (re.compile(p), f) for k, (p, f) in KINDS.items()}
#: A quoted value is a secret only after a name like these; the name may stand up to 40 characters before it. A bare one, with a digit and a letter, after fewer names.
SECRET_NAME = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|key)\w*[\"']?\s*[:=]+\s*[\"']$")
BARE_NAME = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\s?[:=]\s?$")
HAS_NAME = re.compile(r"(?i)token|secret|passw|key")
HINT = re.compile(r"[0-9@]|[\"'][A-Za-z]|::")


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of what is found, left to right, without overlaps."""
    if not HINT.search(text):
        return []
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    has_digit = any(d in text for d in DIGITS)
    named = bool(HAS_NAME.search(text))
    may = {"email": "@" in text, "secret": named, "bare secret": named and has_digit, "ipv6": text.count(":") > 1}
    for kind, (pattern, f) in PATTERNS.items():
        if not may.get(kind, has_digit):
            continue
        for m in pattern.finditer(text):
            if kind == "secret" and not SECRET_NAME.search(text, max(0, m.start() - 48), m.start()):
                continue
            if kind == "ipv6" and not re.search(r"\d", m[0]):
                continue
            if kind == "bare secret" and not (BARE_NAME.search(text, max(0, m.start() - 48), m.start()) and re.search(r"\d", m[0]) and re.search(r"[A-Za-z]", m[0])):
                continue
            if kind == "card":
                for a, b, new in cards(text, m.start(), m.end(), taken, key):
                    found.append((a, b, kind, new))
                    taken[a:b] = b"\x01" * (b - a)
                continue
            if taken.find(1, m.start(), m.end()) >= 0:
                continue
            value = m[0]
            while (new := f(value, key)) is None and kind == "iban" and " " in value:
                value = value.rpartition(" ")[0]  # capitals that follow the number are no part of it
            if new is not None:
                end = m.start() + len(value)
                found.append((m.start(), end, kind, new))
                taken[m.start() : end] = b"\x01" * len(value)
    return sorted(found)


def rewrite(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    spans = find(text, key) if text else []
    if not spans:
        return text, spans
    out, at = [], 0
    for a, b, _, new in spans:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), spans


def pseudonyms(docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: id, rewritten text, number of findings, and the findings' kinds, places and pseudonyms."""
    ready_workers(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [rewrite(t, key) for t in batch.column(1).to_pylist()]
            spans = [[{"kind": k, "start": a, "end": b, "pseudonym": p} for a, b, k, p in s] for _, s in done]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, pa.list_(span))], ["doc_id", "text", "n_found", "found"])

    return pick(docs, doc_id=doc_id, text=text).select(whole(F.col("doc_id")).alias("doc_id"), "text").mapInArrow(work, "doc_id long, text string, n_found int, found array<struct<kind string, start int, end int, pseudonym string>>")


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``text`` rewritten; lengths in characters stay as they were, but for IPv4 addresses."""
    ready_workers(docs.sparkSession)
    at, flat = place(docs, text), numbered(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([rewrite(t, key)[0] for t in batch.column(at).to_pylist()], batch.column(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return flat.mapInArrow(work, flat.schema).toDF(*docs.columns)


def key_of(spark: SparkSession) -> bytes:
    """The session's key, from ``spark.siltstone.pseudonyms.key``; queries over the driver's invented tables fall back on a public one."""
    return spark.conf.get("spark.siltstone.pseudonyms.key", "public key for invented data").encode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(spark.read.parquet(f"{sf_dir}/documents.parquet"), key_of(spark))
