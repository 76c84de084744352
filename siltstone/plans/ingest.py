"""Ingest queries: pages, domains, feeds, credibility, de-duplication, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vectors as V
from siltstone.operators import credibility, review
from siltstone.plans.tables import Tables, registry
from siltstone.sources import feeds
from siltstone.streaming import streams

QUERIES, ORACLES, query = registry()
DOMAIN = r"regexp_replace(split_part(split_part(regexp_replace(lower(trim({0})), '^https?://', ''), '/', 1), ':', 1), '^www\.', '')"
RSS = """<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel>
<item><title>One &amp; only</title><link>https://www.example.com/1</link><description><![CDATA[<p>Body <b>one</b></p>]]></description><pubDate>Mon, 04 May 2026 10:00:00 +0000</pubDate><media:thumbnail url="https://img.example.com/1.png"/></item>
<item><title>Two</title><link>https://example.org/2</link><description><![CDATA[<img src="https://img.example.org/2.jpg"> text two]]></description></item>
<item><description>neither title nor link</description></item>
<item><title>Three</title><link>https://example.net/3</link><enclosure url="https://img.example.net/3.webp" type="image/webp"/></item></channel></rss>"""
ARTICLES = """{"articles":[{"url":"https://a.example.com/1","title":"A","seendate":"20260504T100000Z","socialimage":"","domain":"a.example.com"},
{"url":"https://a.example.com/1","title":"A again","seendate":"20260504T110000Z","socialimage":"x","domain":"a.example.com"},{"url":"http://B.example.com:80/2","title":"B","seendate":"bad","socialimage":"i"},{"url":"","title":""}]}"""


@query("SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\\s+', ''), '\\s+$', '')) AS text_md5, length(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\\s+', ''), '\\s+$', '')) AS n FROM pages".replace("\\\\", "\\"))
def html_strip(t: Tables):
    x = T.strip_html(F.col("html"))
    return t.pages.select("page_id", F.md5(x.cast("binary")).alias("text_md5"), F.length(x).cast("long").alias("n"))


@query(f"SELECT page_id, {DOMAIN.format('url')} AS domain, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS authority FROM pages")
def domain_normalize(t: Tables):
    return t.pages.select("page_id", T.normalize_domain(F.col("url")).alias("domain"), T.url_authority(F.col("url")).alias("authority"))


@query(f"SELECT page_id, 'content:' || substr(sha1(url), 1, 16) AS content_id, 'source:' || {DOMAIN.format('url')} AS source_id FROM pages")
def content_ids(t: Tables):
    return t.pages.select("page_id", T.content_id(F.col("url")).alias("content_id"), T.source_id(T.normalize_domain(F.col("url")), F.lit("")).alias("source_id"))


@query(f"SELECT min(page_id) AS page_id, {DOMAIN.format('url')} AS domain FROM pages GROUP BY 2")
def url_dedup(t: Tables):
    rows = t.pages.select("page_id", T.normalize_domain(F.col("url")).alias("domain"))
    return review.url_dedup(rows, "domain", "page_id")


HISTORY = "h AS (SELECT source || '.example.com' AS domain, count(*) FILTER (quality = 0) AS satire, count(*) FILTER (quality = 1) AS news, count(*) FILTER (quality IS NULL OR quality NOT IN (0, 1)) AS other FROM documents JOIN labels USING (doc_id) GROUP BY 1)"


def _items(t: Tables):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id").select(F.concat("source", F.lit(".example.com")).alias("domain"), F.when(F.col("quality") == 1, "news").when(F.col("quality") == 0, "satire").alias("label"))


@query(f"WITH {HISTORY} SELECT * FROM h")
def content_history(t: Tables):
    return credibility.history(_items(t))


@query(f"""WITH {HISTORY}, q AS (SELECT * FROM h UNION ALL VALUES ('quiet.example.net', 12, 0, 0)),
d AS (SELECT domain FROM h UNION ALL SELECT unnest(['https://www.TheOnion.com/x', 'bbc.co.uk:80', 'dailysatire.com', 'cheap.xyz', 'old.xyz', 'plain.org', 'QUIET.example.net', '', ' https:///x', NULL])),
x AS (SELECT d.domain, lower(d.domain) AS n, satire, news, satire + news + other AS total FROM d LEFT JOIN q ON lower(d.domain) = q.domain),
y AS (SELECT *, total >= 10 AS seen, satire / total::DOUBLE AS s, news / total::DOUBLE AS w FROM x),
z AS (SELECT domain, CASE WHEN n IS NULL OR n = '' OR n LIKE ' http%' THEN ['UNKNOWN', '0.0', 'no domain'] WHEN n LIKE '%theonion%' THEN ['SATIRE', '1.0', 'curated satire list'] WHEN n LIKE 'bbc%' THEN ['NEWS', '1.0', 'curated news list']
WHEN n LIKE '%satire%' THEN ['SATIRE', '0.8', 'name contains satire'] WHEN n = 'cheap.xyz' THEN ['MIXED', '0.7', 'young domain under .xyz'] WHEN seen AND s >= 0.8 THEN ['SATIRE', '0.85', round_even(s * 100, 0)::INT || '% satire']
WHEN seen AND w >= 0.8 THEN ['NEWS', '0.85', round_even(w * 100, 0)::INT || '% news'] WHEN seen AND s >= 0.2 AND w >= 0.2 THEN ['MIXED', '0.6', round_even(s * 100, 0)::INT || '% satire, ' || round_even(w * 100, 0)::INT || '% news'] ELSE ['UNKNOWN', '0.0', 'no match'] END AS v FROM y)
SELECT domain, v[1] AS category, v[2]::DOUBLE AS confidence, v[3] AS reasoning FROM z""")
def source_credibility(t: Tables):
    """Sources by their history, and named domains; a label's white space and case don't matter, nor do items without a domain."""
    said = t.spark.createDataFrame([("quiet.example.net", " Satire ")] * 12 + [("", "satire")] * 20 + [(None, "satire")], "domain string, label string")
    counts = credibility.history(_items(t).unionByName(said))
    named = [("https://www.TheOnion.com/x", 9000.0), ("bbc.co.uk:80", None), ("dailysatire.com", None), ("cheap.xyz", 20.0), ("old.xyz", 2000.0), ("plain.org", None), ("QUIET.example.net", None), ("", None), (" https:///x", 5.0), (None, None)]
    rows = credibility.history(_items(t)).select("domain", F.lit(None).cast("double").alias("age_days")).unionByName(t.spark.createDataFrame(named, "domain string, age_days double"))
    return credibility.classify(rows, counts).drop("age_days")


@query("""SELECT * FROM (VALUES ('https://www.example.com/1', 'https://img.example.com/1.png', 'One & only', 'Body one', 'feed.example.com', TIMESTAMP '2026-05-04 10:00:00'),
('https://example.org/2', 'https://img.example.org/2.jpg', 'Two', 'text two', 'feed.example.com', TIMESTAMP '2026-01-01'), ('https://example.net/3', 'https://img.example.net/3.webp', 'Three', '', 'feed.example.com', TIMESTAMP '2026-01-01')) v(source_url, image_url, title, text, source_domain, ts)""")
def rss_items(t: Tables):
    body = t.spark.createDataFrame([("satire", "feed.example.com", RSS), ("broken", "x", "<rss><channel>")], "feed string, domain string, body string")
    return feeds.rss_items(body, "satire", F.lit("2026-01-01").cast("timestamp")).select("source_url", "image_url", "title", "text", "source_domain", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""SELECT * FROM (VALUES ('https://a.example.com/1', NULL, 'A', 'a.example.com', TIMESTAMP '2026-05-04 10:00:00'), ('http://B.example.com:80/2', 'i', 'B', 'b.example.com:80', TIMESTAMP '2026-01-01')) v(source_url, image_url, title, source_domain, ts)""")
def article_items(t: Tables):
    body = t.spark.createDataFrame([(0, ARTICLES), (1, '{"articles": []}')], "page long, body string")
    return feeds.article_items(body, F.lit("2026-01-01").cast("timestamp")).select("source_url", "image_url", "title", "source_domain", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT doc_id, source FROM d WHERE n <= 10")
def per_source_budget(t: Tables):
    return feeds.cap_per_source(t.documents.select("doc_id", "source"), "source", "doc_id", 10)


def _hashes(t: Tables):
    e = F.col("embedding")
    high = F.lit(0).cast("long")
    for i in range(64):
        high = high.bitwiseOR(F.when(F.get(e, i) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return t.embeddings.select(F.col("vec_id").alias("id"), high.alias("h"))


@query("""WITH RECURSIVE h AS (SELECT vec_id AS id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << i::INT) ELSE 0::HUGEINT END))::HUGEINT AS h FROM embeddings), f AS (SELECT h, min(id) AS id FROM h GROUP BY h),
o AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM f), r AS (SELECT 0::BIGINT AS k, []::HUGEINT[] AS kept, NULL::BIGINT AS id
UNION ALL SELECT o.k, CASE WHEN near THEN kept ELSE list_append(kept, o.h) END, CASE WHEN near THEN NULL ELSE o.id END FROM (SELECT o.k, o.h, o.id, r.kept, len(list_filter(r.kept, lambda x: bit_count(xor(x, o.h)) <= 16)) > 0 AS near FROM r JOIN o ON o.k = r.k + 1) o)
SELECT id FROM r WHERE id IS NOT NULL""")
def phash_dedup(t: Tables):
    return review.phash_dedup(_hashes(t), 16)


@query("SELECT event_type AS domain, count(*) FILTER (value < 50) AS satire, count(*) FILTER (value >= 50) AS news, 0::BIGINT AS other FROM events GROUP BY 1")
def stream_history(t: Tables):
    rows = streams.events(t.spark, f"{t._dir}/events.parquet").select(F.col("event_type").alias("domain"), F.when(F.col("value") < 50, "satire").when(F.col("value") >= 50, "news").alias("label"))
    return streams.drain(streams.history(rows), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t: Tables):
    rows = streams.events(t.spark, f"{t._dir}/events.parquet").select("user_id", "event_type", "ts")
    return streams.drain(streams.first_seen(rows, ["user_id", "event_type"]), "append").select("user_id", "event_type")


@query("SELECT count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT text, row_number() OVER (ORDER BY doc_id DESC) AS n FROM documents) WHERE n <= 10000")
def rolling_buffer(t: Tables):
    return t.documents.select("doc_id", F.length("text").alias("c")).orderBy(F.desc("doc_id")).limit(10_000).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("chars"))
