"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: tokens of mentions.
TOKEN = r"[A-Za-z][A-Za-z0-9'\-]*"


def strip(x: Column) -> Column:
    """Unicode white space goes from both ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def strip_html(x: Column) -> Column:
    return strip(F.regexp_replace(x, "<[^>]+>", ""))


def clean_mention(x: Column) -> Column:
    return F.lower(strip(x))


def first_token(x: Column) -> Column:
    return F.split(clean_mention(x), r"(?U)\s+")[0]


def normalize_domain(x: Column) -> Column:
    """Lower case, without one scheme, path, port and a leading www."""
    host = F.regexp_replace(F.lower(strip(x)), "^https?://", "")
    return F.regexp_replace(F.substring_index(F.substring_index(host, "/", 1), ":", 1), r"^www\.", "")


def url_authority(x: Column) -> Column:
    return F.lower(F.try_parse_url(x, F.lit("AUTHORITY")))


def content_id(url: Column) -> Column:
    return F.concat(F.lit("content:"), F.substring(F.sha1(url.cast("binary")), 1, 16))


def source_id(domain: Column, account: Column) -> Column:
    return F.concat_ws(":", F.lit("source"), F.coalesce(F.nullif(domain, F.lit("")), F.lit("unknown")), F.nullif(account, F.lit("")))


def cluster_id(ids: Column) -> Column:
    return F.concat(F.lit("cluster:"), F.substring(F.sha1(F.array_join(F.array_sort(ids), "|").cast("binary")), 1, 12))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))


def ngrams(toks: Column, most: int = 3) -> Column:
    """All runs of 1 to ``most`` tokens, by length, then place. ``toks`` should be a column, as it is read several times."""
    runs = [toks]
    for k in range(1, most):
        rest = F.slice(toks, k + 1, F.greatest(F.size(toks) - k, F.lit(0)))
        runs.append(F.filter(F.zip_with(runs[-1], rest, lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull()))
    return F.concat(*runs)


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 if equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def words(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), r"(?U)\s+"), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    both, all_ = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    return F.when((F.size(words(a)) > 0) & (F.size(words(b)) > 0), both / all_).otherwise(F.lit(0.0))


def percent(x: Column) -> Column:
    """Whole percent, half to even."""
    return F.concat(F.rint(x * 100).cast("int"), F.lit("%"))


def utc_compact(ts: Column) -> Column:
    """yyyyMMddHHmmss, in the session's time zone (UTC)."""
    return F.date_format(ts, "yyyyMMddHHmmss")


def extra(row: Column, *without: str) -> Column:
    """A map's entries but for some keys."""
    return F.map_filter(row, lambda k, v: ~k.isin(*without))


def compact_time(x: Column, now: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(x, F.lit("yyyyMMdd'T'HHmmss'Z'")), now)


def image_url(thumbs: Column, media: Column, enclosures: Column, content: Column, summary: Column) -> Column:
    """First thumbnail, media content, fitting enclosure, <img> in the content, <img> in the summary."""
    fits = F.filter(enclosures, lambda e: (F.coalesce(e["href"], F.lit("")) != "") & ((F.coalesce(e["type"], F.lit("")) == "") | e["type"].startswith("image/")))
    # fixed value: the address of an image tag
    img = r"""(?i)<img[^>]+src=["']([^"']+)["']"""
    return F.coalesce(F.get(thumbs, 0), F.get(media, 0), F.get(fits, 0)["href"], *[F.nullif(F.regexp_extract(x, img, 1), F.lit("")) for x in (content, summary)])


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes; null if either is malformed."""

    def bits(x: Column) -> Column:
        return F.when(x.rlike("^[0-9a-fA-F]{16}$"), F.conv(x, 16, -10).cast("bigint"))

    return F.bit_count(bits(a).bitwiseXOR(bits(b)))
