"""Source credibility: curated lists, then name heuristics, then content history; the first verdict wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

# Curated domains, satire needles and low-cost top-level domains.
KNOWN_SATIRE = (
    "theonion.com", "babylonbee.com", "reductress.com", "clickhole.com", "thebeaverton.com", "thehardtimes.net", "newsthump.com",
    "thedailymash.co.uk", "thespoof.com", "waterfordwhispersnews.com", "private-eye.co.uk", "thedailycurrant.com",
)
KNOWN_NEWS = (
    "reuters.com", "apnews.com", "bbc.com", "bbc.co.uk", "npr.org", "theguardian.com", "nytimes.com", "washingtonpost.com", "wsj.com",
    "economist.com", "ft.com", "bloomberg.com", "abcnews.go.com", "cbsnews.com", "nbcnews.com", "cnn.com", "aljazeera.com", "pbs.org",
)
SATIRE_NEEDLES = (
    "satire", "satirical", "satirically", "spoof", "parody", "comedy", "humor", "humour", "fakenews", "fake-news", "fake_news",
    "theonion", "babylonbee", "reductress",
)
SUSPICIOUS_TLDS = ("tk", "ml", "ga", "cf", "gq", "xyz", "top", "click", "info")
MIN_HISTORY, DOMINANT, MINOR, YOUNG_DAYS = 10, 0.8, 0.2, 180


def history(items: DataFrame) -> DataFrame:
    """(domain, satire, news, other) counts of items (domain, label); items without a domain don't count."""
    label = T.clean_mention(F.coalesce("label", F.lit("")))
    news = label.isin("news", "authentic", "real")
    n = lambda c: F.count_if(c)
    named = items.select(T.normalize_domain(F.col("domain")).alias("domain"), "label").where("domain <> ''")
    return named.groupBy("domain").agg(n(label == "satire").alias("satire"), n(news).alias("news"), n((label != "satire") & ~news).alias("other"))


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("domain").agg(*[F.sum(c).alias(c) for c in ("satire", "news", "other")])


def _verdict(category: str, confidence: float, reason: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), reason.alias("reasoning"))


def classify(domains: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Adds category, confidence and reasoning to rows (domain, age_days); without a domain they are unknown."""
    if set(KNOWN_SATIRE) & set(KNOWN_NEWS):
        raise ValueError("curated lists overlap")
    d, age = F.col("d"), F.col("row.age_days")
    rows = domains.select(F.struct(*domains.columns).alias("row"), F.coalesce(T.normalize_domain(F.col("domain")), F.lit("")).alias("d"))
    if counts is not None:
        rows = rows.join(counts.select(F.col("domain").alias("d"), "satire", "news", "other"), "d", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("long") for c in ("satire", "news", "other")})
    needle = F.get(F.filter(F.array(*[F.lit(x) for x in SATIRE_NEEDLES]), lambda x: F.contains(d, x)), 0)
    tld = F.when(F.contains(d, F.lit(".")), F.substring_index(d, ".", -1)).otherwise("")
    n = F.coalesce(F.col("satire") + F.col("news") + F.col("other"), F.lit(0))
    s, w = (F.when(n > 0, F.col(c) / n).otherwise(0.0) for c in ("satire", "news"))
    seen = n >= MIN_HISTORY
    out = (
        F.when(d == "", _verdict("UNKNOWN", 0.0, F.lit("no domain")))
        .when(d.isin(*KNOWN_SATIRE), _verdict("SATIRE", 1.0, F.lit("curated satire list")))
        .when(d.isin(*KNOWN_NEWS), _verdict("NEWS", 1.0, F.lit("curated news list")))
        .when(needle.isNotNull(), _verdict("SATIRE", 0.8, F.concat(F.lit("name contains "), needle)))
        .when(tld.isin(*SUSPICIOUS_TLDS) & (age < YOUNG_DAYS), _verdict("MIXED", 0.7, F.concat(F.lit("young domain under ."), tld)))
        .when(seen & (s >= DOMINANT), _verdict("SATIRE", 0.85, F.concat(T.percent(s), F.lit(" satire"))))
        .when(seen & (w >= DOMINANT), _verdict("NEWS", 0.85, F.concat(T.percent(w), F.lit(" news"))))
        .when(seen & (s >= MINOR) & (w >= MINOR), _verdict("MIXED", 0.6, F.concat(T.percent(s), F.lit(" satire, "), T.percent(w), F.lit(" news"))))
        .otherwise(_verdict("UNKNOWN", 0.0, F.lit("no match")))
    )
    return rows.select("row.*", out.alias("verdict")).select(*domains.columns, "verdict.*")
