"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata
record; request and metadata name the response in WARC-Concurrent-To.  Writing uses
Spark's text writer with the record end as line separator, so archives reach any
store that Spark can write to.  Reading frames records by Content-Length only.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketsense.llm.common import numbered

RECORD_END = "\r\n\r\n"
# (captures of up to so many payload bytes, captures in a file): a file holds 64 MB of payload, or one larger capture.
FILE_CLASSES = [(1 << 16, 1000), (1 << 22, 16), (None, 1)]
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, digest string, payload_length long, profile string, block binary"


def _urn(*parts: Column) -> Column:
    """A stable record identifier made of the parts."""
    digest = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str | Column, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its end: version, named fields (those with a null value are left out), blank line, block."""
    fields = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit("2024-01-01T00:00:00Z")), *headers]
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(line, F.lit("")) for line in lines], size, block)


def plan_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """Decide which captures hold their payload and which revisit an equal one.

    Returns a staged table (row, page_id, url, html, size, digest, is_revisit, leader, leader_row).
    Of equal payloads (same digest and size, at least ``min_bytes``) the smallest id
    holds it; among rows that repeat an id the first row does.  Null ids come last;
    a null payload is empty.  The leader of a payload is found by partial
    aggregation and joined back, so a payload that a third of all pages share is
    never gathered.
    """
    html = F.coalesce(F.col(payload_col), F.lit(""))
    size, digest = F.octet_length(html).cast("long"), F.sha2(html.cast("binary"), 256)
    kept = numbered(
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), size.alias("size"), digest.alias("digest")), "warc-pages"
    )
    order = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id"), F.col("row"))
    leaders = kept.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min(order).alias("leader"))
    joined = kept.join(leaders, ["digest", "size"], "left")
    revisit = F.coalesce(F.col("leader.row") != F.col("row"), F.lit(False))
    return joined.select("row", "page_id", "url", "html", "size", "digest", revisit.alias("is_revisit"), F.col("leader.page_id").alias("leader_id"), F.col("leader.row").alias("leader_row"))


def write_archives(captures: DataFrame, path: str) -> None:
    """Write three records per capture; each file is one gzip stream, bounded by ``FILE_CLASSES``.

    Captures are written by size class, so a file that is read as a whole stays small
    whatever the pages are like.
    """

    def identity(part: str, row: str = "row", page: str = "page_id") -> Column:
        return _urn(F.lit(part), F.coalesce(F.col(page).cast("string"), F.lit("~")), F.col(row).cast("string"))

    own = identity("response")
    # Header values must stay on one line.
    uri = F.regexp_replace(F.col("url"), r"[\r\n]+", " ")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n")
    )
    block = F.when(F.col("is_revisit"), head).otherwise(F.concat(head, F.col("html")))
    main = _record(
        F.when(F.col("is_revisit"), "revisit").otherwise("response"), own,
        [
            ("WARC-Target-URI", uri), ("Content-Type", F.lit("application/http;msgtype=response")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(F.col("is_revisit"), REVISIT_PROFILE)),
            ("WARC-Refers-To", F.when(F.col("is_revisit"), identity("response", "leader_row", "leader_id"))),
        ],
        block,
    )
    request = _record(
        "request", identity("request"),
        [("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        "metadata", identity("metadata"), [("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("fetchStatus: 200\r\n")),
    )
    below = -1
    for most, in_file in FILE_CLASSES:
        chosen = captures.filter((F.col("size") > below) & (F.col("size") <= most if most else F.lit(True)))
        lines = chosen.select(F.explode(F.array(request, main, metadata)).alias("value"))
        writer = lines.write.mode("append").option("lineSep", RECORD_END).option("maxRecordsPerFile", 3 * in_file)
        writer.option("compression", "gzip").text(path)
        below = most


_FIELDS = {
    b"warc-type": "type", b"warc-record-id": "record_id", b"warc-concurrent-to": "concurrent_to", b"warc-refers-to": "refers_to",
    b"warc-target-uri": "target_uri", b"warc-payload-digest": "digest", b"warc-profile": "profile",
}


def parse_records(content: bytes) -> Iterator[dict]:
    """The records of one archive, framed by Content-Length; a broken rest raises ValueError.

    Size and digest of a response's payload are those of the bytes read; a revisit has
    the ones its headers name.
    """
    place = 0
    while place < len(content):
        if not content.startswith(b"WARC/", place):
            raise ValueError(f"no record at byte {place}")
        end = content.index(b"\r\n\r\n", place)
        named = {}
        for line in content[place:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            named[name.strip().lower()] = value.strip()
        start, size = end + 4, int(named[b"content-length"])
        if start + size > len(content):
            raise ValueError(f"record at byte {place} is cut short")
        record = dict.fromkeys(["type", "record_id", "concurrent_to", "refers_to", "target_uri", "digest", "payload_length", "profile"])
        record |= {ours: named[theirs].decode() for theirs, ours in _FIELDS.items() if theirs in named}
        record["block"] = content[start : start + size]
        if record["type"] == "response":
            # What was read counts, not what the headers say.
            payload = record["block"].partition(b"\r\n\r\n")[2]
            record["payload_length"], record["digest"] = len(payload), f"sha256:{hashlib.sha256(payload).hexdigest()}"
        elif record["type"] == "revisit":
            head = record["block"].partition(b"\r\n\r\n")[0]
            length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            record["payload_length"] = int(length[1]) if length else None
        yield record
        place = start + size
        while content.startswith(b"\r\n", place):
            place += 2


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder, plain or gzip.  A task holds one file, which the writer keeps small."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                held, size = [], 0
                content = bytes(content)
                for record in parse_records(gzip.decompress(content) if content.startswith(b"\x1f\x8b") else content):
                    held.append(record)
                    size += len(record["block"])
                    if size > 8_000_000:
                        yield pd.DataFrame(held)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, RECORD_SCHEMA)


def assemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """One nested row per capture: the response or revisit, its request and its metadata records.

    Records meet by identifier: a response by its own, the others by the one they
    are concurrent to.  Identifiers are per capture, so no group grows with the
    data.  A capture without request or metadata has null or no element there; records
    concurrent to nothing known are returned with null fields in the response.  Blocks
    move with their records once; without ``payloads`` those of responses stay where they are.
    """
    keyed = records.withColumn("capture", F.coalesce("concurrent_to", "record_id"))
    fields = ["record_id", "type", "refers_to", "target_uri", "digest", "payload_length", "profile", *["block"] * payloads]
    if not payloads:
        keyed = keyed.withColumn("block", F.when(~F.col("type").isin("response", "revisit"), F.col("block")))
    main, request, metadata = F.col("type").isin("response", "revisit"), F.col("type") == "request", F.col("type") == "metadata"
    found = keyed.groupBy("capture").agg(
        *[F.max(F.when(main, F.col(name))).alias(f"main_{name}") for name in fields],
        F.max(F.when(request, F.struct("record_id", "block"))).alias("request"),
        F.sort_array(F.collect_list(F.when(metadata, F.struct("record_id", "block")))).alias("metadata"),
    )
    return found.select("capture", F.struct(*[F.col(f"main_{name}").alias(name) for name in fields]).alias("response"), "request", "metadata")
