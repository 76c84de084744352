"""Operator 7, WARC: archives are written record by record and read back sequentially.

Each record is a gzip member of its own. The reader takes chunks of bytes from any source, inflates one member after
another incrementally, reads the record's header, frames the block by its Content-Length, and verifies the block's and the
payload's SHA-1 digests. Of pages with equal payloads of a minimum length, that with the smallest id is stored as a
response; the others become revisits that name it.

Each archive begins with a warcinfo record. A revisit names its original by record id, URI and date, as WARC/1.1 has it.

Duplicates are found on digests: pages are grouped by SHA-1 with partial aggregation, and only digests that occur twice
or more are joined back: by broadcast up to ``BROADCAST_ROWS`` rows, beyond by a join whose hot digests are broadcast. Archives are rows (name, bytes) of Parquet tables in the shared folder, about ``ARCHIVE_BYTES`` each, so they can
be in any store that Spark reaches; ``read_archives`` also takes .warc.gz files through Spark's binaryFile source.

Defined cases: a null payload is empty; a null id is written without a record id for the page and comes back null; rows that repeat
the smallest id with an equal payload are responses each, and revisits name the one with the smallest URL; other ids that repeat are records each; an empty table gives no
archives and no rows; a damaged record (bad gzip, framing or digest) is returned with its error, and reading goes on at the next gzip
member where it can be found; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.scratch import Scratch
from siltstone.skew import join_by_count

ARCHIVE_BYTES, CHUNK_BYTES, MIN_REVISIT_BYTES = 1 << 24, 1 << 16, 0
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, payload_digest: str, revisit: bool = False) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{payload_digest}|{revisit}')}>"


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool, refers_to_url: str | None = None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, url, payload_digest, revisit)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, refers_to_url, payload_digest)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", str(refers_to))]
        if refers_to_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", _uri(refers_to_url)))
    return _member([*fields, ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Type", "application/http; msgtype=response")], block)


def info(name: str) -> bytes:
    """The record that describes an archive."""
    block = b"software: siltstone\r\nformat: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name, "warcinfo")), ("WARC-Date", DATE), ("WARC-Filename", name), ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Type", "application/warc-fields")], block)


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [*fields, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def members(chunks: Iterable[bytes]) -> Iterator[tuple[bytes, str | None]]:
    """Contents of each gzip member of a stream, inflated chunk by chunk; with an error for one that is damaged."""
    z, out, rest = zlib.decompressobj(31), [], b""
    started = lost = False
    for chunk in chunks:
        data = rest + chunk
        rest = b""
        while data:
            if lost:  # the next member begins with its magic bytes, which may lie across two chunks
                at = data.find(MAGIC)
                if at < 0:
                    rest, data = data[1 - len(MAGIC) :], b""
                    continue
                data, lost = data[at:], False
            try:
                out.append(z.decompress(data))
                started = True
                data = b""
                if z.eof:
                    data = z.unused_data
                    yield b"".join(out), None
                    z, out, started = zlib.decompressobj(31), [], False
            except zlib.error as e:
                yield b"".join(out), f"gzip: {e}"
                data = data[1:]
                z, out, started, lost = zlib.decompressobj(31), [], False, True
    if started:
        yield b"".join(out), "gzip: the stream ends inside a member"


def parse(content: bytes) -> dict:
    """A record's fields, with ``error`` if its framing or digests don't hold."""
    out = dict.fromkeys(("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "error"))
    head, sep, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        return out | {"error": "no WARC header"}
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        length = int(fields["content-length"])
        out |= {"url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None}
        out |= {k: int(fields[f]) for k, f in (("page_id", "x-page-id"), ("refers_to", "x-refers-to-page-id")) if f in fields}
    except (KeyError, ValueError) as e:
        return out | {"error": f"header: {e!r}"}
    block, end = rest[:length], rest[length:]
    if len(block) < length or end != b"\r\n\r\n":
        return out | {"error": "framing: the block doesn't end where Content-Length says"}
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest32(block)}":
        return out | {"error": "block digest"}
    if out["record_type"] == "warcinfo":
        return out | {"payload": block, "payload_bytes": len(block)}
    http, _, payload = block.partition(b"\r\n\r\n")
    if out["record_type"] == "revisit":
        sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        return out | {"payload_bytes": int(sizes[0]) if sizes else None}
    out |= {"payload": payload, "payload_bytes": len(payload)}
    if out["payload_digest"] != digest32(payload):
        return out | {"error": "payload digest"}
    return out


def write_archives(pages: DataFrame, scratch: Scratch, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archives (name, content) with a record for each page."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.cast("binary").alias("payload"))
    sha = F.sha1("payload")
    found = rows.where(F.octet_length("payload") >= least).groupBy(sha.alias("_sha")).agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    again = scratch.save(found.where("_n > 1 and not _first.none").select("_sha", F.col("_first.page_id").alias("_id"), F.col("_first.url").alias("_url"), "_n"))
    if again.count() <= BROADCAST_ROWS:
        linked = rows.join(F.broadcast(again.drop("_n")), sha == F.col("_sha"), "left")
    else:
        keyed = rows.withColumn("_sha", sha)
        linked = join_by_count(keyed, again, ["_sha"], "_n", rows.count()).drop("_n")
        linked = linked.unionByName(keyed.join(again.select("_sha"), "_sha", "left_anti"), allowMissingColumns=True)
    first = F.col("page_id").eqNullSafe(F.col("_id")) | (F.octet_length("payload") < least)
    linked = linked.select("page_id", "url", "payload", F.when(~first, F.col("_id")).alias("refers_to"), F.when(~first, F.col("_url")).alias("refers_to_url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{n:04d}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join([info(name), *held])], pa.binary())], ["name", "content"])

        for batch in batches:
            for i, u, p, r, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(i, u, p, digest32(p), r, r is not None, v))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    n, held, size = n + 1, [], 0
        if held:
            yield flush()

    return scratch.save(linked.mapInArrow(write, "name string, content binary"), codec="uncompressed")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of archives (name or path, content), in the order of each archive, without those that describe it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "error"]

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names], names)

        for batch in batches:
            for blob in batch.column(0):
                content, rows = memoryview(blob.as_py()), []
                for data, error in members(bytes(content[i : i + CHUNK_BYTES]) for i in range(0, len(content), CHUNK_BYTES)):
                    r = parse(data) if error is None else dict.fromkeys(names) | {"error": error}
                    if r["record_type"] != "warcinfo" or r["error"]:
                        rows.append(r if with_payload else r | {"payload": None})
                    if len(rows) >= 500:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return archives.select("content").mapInArrow(read, RECORD)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc.gz files."""
    return read_archives(spark.read.format("binaryFile").load(path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "warc"))
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p
), bits AS (
  SELECT *, list_reduce(list_transform(range(40), lambda i: lpad(bin(strpos('0123456789abcdef', substr(hex, (i + 1)::INT, 1)) - 1), 4, '0')), lambda a, b: a || b) AS b FROM d
)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(5), lambda j: substr(b, (5 * i + j + 1)::INT, 1)::INT * (16 >> j::INT))))::INT, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM bits
"""
