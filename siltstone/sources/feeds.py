"""Feeds and pages as tables of raw bodies: RSS, article JSON, robots rules; paging URLs and retry delays."""

from __future__ import annotations

import json
import logging
import random
import re
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.robotparser import RobotFileParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.scratch import ready_workers

log = logging.getLogger(__name__)
# Answers worth another try, tries after the first, and the default news feeds with their outlets and domains.
RETRY_STATUS = (408, 425, 429, 500, 502, 503, 504)
RETRIES = 3
FEEDS = (
    ("reuters_world", "https://feeds.reuters.com/reuters/worldNews", "Reuters", "reuters.com"),
    ("bbc_news", "http://feeds.bbci.co.uk/news/rss.xml", "BBC", "bbc.co.uk"),
    ("ap_top", "https://feeds.apnews.com/rss/apf-topnews", "Associated Press", "apnews.com"),
    ("npr_news", "https://feeds.npr.org/1001/rss.xml", "NPR", "npr.org"),
    ("guardian_world", "https://www.theguardian.com/world/rss", "The Guardian", "theguardian.com"),
)
PAGE = 250
ENTRY = "link string, title string, summary string, content string, published string, thumbs array<string>, media array<string>, enclosures array<struct<href string, type string>>"


def backoff_seconds(attempt: int, rng: random.Random | None = None) -> float:
    base = min(8.0, 0.5 * 2**attempt)
    return base + (rng or random.Random(0)).uniform(0, 0.25 * base)


def page_url(base: str, query: str, newest: str, most: int = PAGE, oldest: str | None = None) -> str:
    params = {"query": query, "mode": "ArtList", "format": "json", "maxrecords": min(most, PAGE), "sort": "DateDesc", "enddatetime": newest}
    return f"{base}?{urlencode(params | ({'startdatetime': oldest} if oldest else {}))}"


def fetch(get: Callable[[str], tuple[int, str, bytes]], url: str, kind: str = "", sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> bytes | None:
    """The body of ``url``: up to three more tries after transport errors and answers of RETRY_STATUS, none after other errors.

    ``get`` gives status, content type and body, or raises OSError. ``kind``: what the content type has to begin with, such as image/.
    """
    for attempt in range(RETRIES + 1):
        try:
            status, content_type, body = get(url)
        except OSError:
            status, content_type, body = RETRY_STATUS[0], "", b""
        if status < 400:
            return body if content_type.lower().startswith(kind) else None
        if status not in RETRY_STATUS or attempt == RETRIES:
            return None
        sleep(backoff_seconds(attempt, rng))


class Pace:
    """Least gap between calls, from a rate per minute."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.last = 60.0 / per_minute, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and now < self.last + self.gap:
            self.sleep(self.last + self.gap - now)
            now = self.last + self.gap
        self.last = now


def fetch_bodies(urls: DataFrame, getter: Callable[[], Callable[[str], tuple[int, str, bytes]]], per_minute: float = 30, kind: str = "") -> DataFrame:
    """(url, body) of rows (url), without those that fail. ``getter`` makes a function for ``fetch`` in each worker, which paces itself."""
    ready_workers(urls.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, pace = getter(), Pace(per_minute)
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                pace.wait()
                body = fetch(get, url, kind)
                if body is not None:
                    rows.append((url, body))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["url", "body"])

    return urls.select("url").mapInArrow(work, "url string, body binary")


def outlets(spark: SparkSession, extra: list[tuple[str, str, str, str]] = ()) -> DataFrame:
    """(feed, feed_url, outlet, domain) of the default feeds and others."""
    return spark.createDataFrame([*FEEDS, *extra], "feed string, feed_url string, outlet string, domain string")


def with_outlet(feeds: DataFrame, known: DataFrame) -> DataFrame:
    """Adds outlet and domain to rows (feed, feed_url, ...); unknown feeds have their key and their URL's host."""
    j = feeds.join(F.broadcast(known.select("feed", F.col("outlet").alias("_outlet"), F.col("domain").alias("_domain"))), "feed", "left")
    return j.select(*feeds.columns, F.coalesce("_outlet", "feed").alias("outlet"), F.coalesce("_domain", T.url_authority(F.col("feed_url"))).alias("domain"))


def query_budget(most: int, taken: int, queries: int) -> int:
    """What each of several queries may give after ``taken`` of ``most`` items came from feeds; one at least."""
    return max(1, (most - taken) // queries) if queries else 0


def pages_back(query: str, read: Callable[[str, int], str | None], most: int, now: str) -> list[str]:
    """Bodies of article pages back in time. ``read`` gives the page of a query that ends at a time, or None.

    It ends when enough items came, a page fails, isn't JSON, isn't full, or has nothing new, and when the oldest time doesn't move on.
    """
    if not query:
        raise ValueError("a query is needed")
    bodies, seen, taken, end = [], set(), 0, now
    while taken < most:
        size = min(most - taken, PAGE)
        body = read(end, size)
        try:
            articles = (json.loads(body).get("articles") or []) if body is not None else []
        except ValueError:
            articles = []
        new = []
        for a in articles:
            url = a.get("url") or ""
            if (url or a.get("title")) and url not in seen:
                seen |= {url} - {""}
                new.append(a)
        new = new[: most - taken]
        if not new:
            break
        bodies.append(json.dumps({"articles": new}))
        taken += len(new)
        stamp = lambda a: s if len(s := re.sub(r"\D", "", a.get("seendate") or "")) == 14 else now
        oldest = min(map(stamp, new))
        if len(articles) < size or oldest >= end:
            break
        end = oldest
    return bodies


def collect_sources(parts: list[Callable[[], DataFrame]], most: int) -> DataFrame | None:
    """Items of several sources, one after the other, ``most`` in all. A source that fails is left out; None if all do."""
    out, left = None, most
    for part in parts:
        if left <= 0:
            break
        try:
            rows = part().limit(left)
            left -= rows.count()
        except Exception as e:  # noqa: BLE001
            log.warning("a source failed: %s", e)
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def _entries(body: str, most: int) -> list[tuple]:
    """The first entries of an RSS or Atom body; of a malformed one, those before the damage."""
    parser, found, stack = ET.XMLPullParser(("start", "end")), [], []
    try:
        parser.feed(body)
        parser.close()
    except ET.ParseError:
        pass
    name = lambda e: e.tag.rpartition("}")[2].lower()
    try:
        for event, e in parser.read_events():
            if event == "start":
                stack.append(e)
            else:
                stack.pop()
                if name(e) in ("item", "entry"):
                    found.append(e)
    except ET.ParseError:
        pass
    rows = []
    for e in found[:most]:
        got: dict[str, list] = {}
        for c in e.iter():
            got.setdefault(name(c), []).append(c)
        one = lambda *ks: next((("".join(c.itertext())).strip() for k in ks for c in got.get(k, []) if "".join(c.itertext()).strip()), "")
        link = one("link") or next((c.get("href") or "" for c in got.get("link", [])), "")
        urls = lambda k: [c.get("url") for c in got.get(k, []) if c.get("url") and c.tag.startswith("{")]
        rows.append((link, one("title"), one("description", "summary"), one("encoded"), one("pubdate", "published", "updated", "created"), urls("thumbnail"), urls("content"), [(c.get("url") or c.get("href") or "", c.get("type") or "") for c in got.get("enclosure", [])]))
    return rows


def rss_entries(bodies: DataFrame, most: int = 50) -> DataFrame:
    """Entries of rows (feed, domain, body), the first ``most`` of each feed, with their place."""
    ready_workers(bodies.sparkSession)

    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 5, *[pa.list_(pa.string())] * 2, pa.list_(pa.struct([("href", pa.string()), ("type", pa.string())]))]
    names = ["feed", "domain", "place", "link", "title", "summary", "content", "published", "thumbs", "media", "enclosures"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["feed"], r["domain"], i, *e[:-1], [{"href": h, "type": k} for h, k in e[-1]]) for r in batch.to_pylist() for i, e in enumerate(_entries(r["body"] or "", most))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return bodies.select("feed", "domain", "body").mapInArrow(parse, "feed string, domain string, place int, " + ENTRY)


def rss_items(bodies: DataFrame, label: str, now: Column, most: int = 50) -> DataFrame:
    """Records of feed entries; entries without both URL and title go, after the cap."""
    e = rss_entries(bodies, most).where("not (link = '' and title = '')")
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace("published", r"^[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("published", F.lit("yyyy-MM-dd'T'HH:mm:ssX")), now)
    return e.select(
        F.col("link").alias("source_url"), T.image_url(F.col("thumbs"), F.col("media"), F.col("enclosures"), F.col("content"), F.col("summary")).alias("image_url"),
        T.strip_html(F.col("title")).alias("title"), T.strip_html(F.when(F.col("content") != "", F.col("content")).otherwise(F.col("summary"))).alias("text"),
        when.alias("ts"), F.coalesce(F.nullif(F.col("domain"), F.lit("")), T.url_authority(F.col("link")), F.lit("")).alias("source_domain"), F.create_map(F.lit("label"), F.lit(label)).alias("metadata"),
    )


ARTICLES = "articles array<struct<url string, title string, seendate string, socialimage string, domain string, language string, sourcecountry string>>"


def article_items(bodies: DataFrame, now: Column) -> DataFrame:
    """Records of article JSON pages (page, body): the first of each URL over all pages; empty URLs stay."""
    a = bodies.select("page", F.posexplode(F.from_json("body", ARTICLES)["articles"]).alias("place", "a")).select("page", "place", "a.*")
    a = a.where("not (coalesce(url, '') = '' and coalesce(title, '') = '')").withColumn("seq", F.col("page") * 1000 + F.col("place"))
    w = Window.partitionBy("url").orderBy("seq")
    a = a.withColumn("n", F.when(F.coalesce("url", F.lit("")) == "", 1).otherwise(F.row_number().over(w))).where("n = 1")
    return a.select(F.col("url").alias("source_url"), F.nullif("socialimage", F.lit("")).alias("image_url"), "title", T.compact_time(F.col("seendate"), now).alias("ts"), F.coalesce(F.nullif("domain", F.lit("")), T.url_authority(F.col("url")), F.lit("")).alias("source_domain"))


def cap_per_source(items: DataFrame, source: str, order: str, budget: int) -> DataFrame:
    w = Window.partitionBy(source).orderBy(order)
    rows = items.select(F.struct(*items.columns).alias("row"), F.row_number().over(w).alias("n"))
    return rows.where(F.col("n") <= budget).select("row.*")


def allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Rows (url, ...) that their host's robots rules (host, rules) allow; no rules allow all."""
    ready_workers(urls.sparkSession)

    @F.pandas_udf("boolean")
    def may(url: pd.Series, rules: pd.Series) -> pd.Series:
        known: dict[str, RobotFileParser] = {}
        out = []
        for u, r in zip(url, rules, strict=True):
            if not r:
                out.append(True)
                continue
            if r not in known:
                known[r] = RobotFileParser()
                known[r].parse(r.splitlines())
            out.append(known[r].can_fetch(agent, u))
        return pd.Series(out)

    j = urls.withColumn("_host", T.url_authority(F.col("url"))).join(robots.select(F.col("host").alias("_h"), "rules"), F.col("_host") == F.col("_h"), "left")
    return j.where(may("url", F.coalesce("rules", F.lit("")))).select(*urls.columns)
