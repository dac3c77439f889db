"""Operator 1: WARC archives with revisit resolution.

Headers (id, payload digest, payload size) are shuffled by digest; the largest id of each digest is the original. Every
page then becomes a WARC record with fresh headers: the original a `response` with its payload, every other page with an
equal payload a `revisit` (profile identical-payload-digest) that names the original and carries no payload.

Records are built as one string column and written by Spark's text writer, so a lost task is simply written again. Each
record of a run begins with the same two lines, the second a fresh run id; the reader splits the archives at these lines.
A payload was made before the run id was drawn, so it cannot hold them, whatever bytes it has; sizes and digests of the
records are checked on reading. A task holds one record at a time, and archives can be split among readers.

Cases: a null payload is the empty payload; a null URL has no WARC-Target-URI line, line breaks in a URL are
percent-encoded; a null id sorts below all others and is written as an empty field; rows that repeat an id and its
payload are all response or all revisit together; an empty table gives empty archives and no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import join_counted
from sensorloom.session import spool, spool_root

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"

_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: each 5 hex digits (20 bits) become 4 digits to base 32."""
    digest = F.sha1(payload)
    four = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*four)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_uri(page_id: Column, digest: Column) -> Column:
    """A record id that follows from page and payload, so that a task written again names its records the same."""
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-8"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def originals(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """payload_digest, payload_bytes, original (largest id) of the payloads that more than one header has.

    One partial sum per task and digest is all that is shuffled, so a digest of any frequency is harmless.
    """
    groups = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
    return groups.agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit(""))


def records(pages: DataFrame, dup: DataFrame, date: str) -> DataFrame:
    """One string per page: named fields, the HTTP head, and for a response the payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("string")
    rows = pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = join_counted(rows, dup, ["payload_digest", "payload_bytes"])
    revisit = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END)
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", record_uri(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Page-ID", F.col("page_id")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, record_uri(F.col("original"), F.col("payload_digest")))),
        _line("WARC-Refers-To-Page-ID", F.when(revisit, F.col("original"))),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        _line("Content-Length", F.octet_length(http) + F.octet_length(body)),
    )
    return rows.select(F.concat(head, F.lit(END), http, body, F.lit(END)).alias("value"))


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str | None = None, compression: str = "none") -> str:
    """Write the deduplicated archives of `pages` (page_id, url, html) below `path`; returns the run id."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("string")
    headers = pages.select("page_id", base32_sha1(payload.cast("binary")).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    dup = spool(originals(headers, min_bytes))
    date = date or pages.sparkSession.range(1).select(F.date_format(F.to_utc_timestamp(F.now(), F.current_timezone()), _ISO)).first()[0]
    run = uuid.uuid4().hex
    start = F.lit(f"{VERSION}{END}WARC-Run-ID: {run}{END}")
    lines = records(pages, dup, date).select(F.concat(start, "value").alias("value"))
    lines.write.option("lineSep", END).option("compression", compression).text(path)
    return run


def read_archives(spark: SparkSession, path: str, run: str) -> DataFrame:
    """One row per record of a run: page_id, record_type, url, payload_digest, payload_bytes, refers_to, payload.

    A record whose size differs from its Content-Length, or whose payload from its digest, raises.
    """
    raw = spark.read.option("lineSep", f"{VERSION}{END}WARC-Run-ID: {run}{END}").text(path).where("value <> ''")
    cut = F.instr("value", END + END)
    parts = raw.select(F.substring("value", F.lit(1), cut + 1).alias("head"), F.substring("value", cut + 4, F.length("value")).alias("rest"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r]*)\r", 1), F.lit(""))
    http = F.instr("rest", END + END)
    rows = parts.select(
        field("WARC-Page-ID").cast("long").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("url"),
        F.substring(field("WARC-Payload-Digest"), 6, 32).alias("payload_digest"),
        F.regexp_extract(F.substring("rest", F.lit(1), http + 1), r"Content-Length: (\d+)\r", 1).cast("long").alias("payload_bytes"),
        field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        field("Content-Length").cast("long").alias("block"),
        (F.octet_length("rest") - 4).alias("held"),
        F.substring("rest", http + 4, F.length("rest") - http - 7).alias("payload"),
    )
    whole = (F.col("block") == F.col("held")) & (
        (F.col("record_type") == "revisit")
        | ((F.octet_length("payload") == F.col("payload_bytes")) & (base32_sha1(F.col("payload").cast("binary")) == F.col("payload_digest")))
    )
    checked = F.when(whole, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a WARC record differs from its headers")).cast("long"))
    return rows.withColumn("payload_bytes", checked).drop("block", "held")


def archive_folder(spark: SparkSession) -> str:
    return f"{spool_root(spark)}/warc-{uuid.uuid4().hex}"
