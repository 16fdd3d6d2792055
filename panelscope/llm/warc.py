"""WARC archives: writing through Spark's text sink, and reading by
boundary-chain verification.

Writing: a record is one row of the text sink, whose line separator is the two
line ends that close a WARC record, so archives land wherever Spark can write.
Of records with equal payloads the one with the largest id is the response;
the others are revisits that refer to it and hold no payload.

Reading: a task looks for the magic string in its archive and emits each
candidate record with the offset of its successor, by its own header. A magic
string inside a payload makes false candidates. Those on the chain from the
start of the file are found by pointer jumping (log2 of the records in joins of
narrow rows), and only they are kept. An archive is read by one task, so the
writer begins a new one after as many records as make ``ARCHIVE_BYTES`` at the
most that a record of its kind may have (see ``KINDS``)."""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.common import marked, prepare, read, scratch, table, text_of

ARCHIVE_BYTES = 16 << 20
MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of(hex_: Column) -> Column:
    """Upper-case base32 of 40 hex digits (20 bytes: four groups of 5 bytes, 8 letters each)."""
    groups = []
    for k in range(4):
        n = F.conv(F.substring(hex_, 10 * k + 1, 10), 16, 10).cast("long")
        groups += [F.substring(F.lit(B32), F.shiftright(n, 35 - 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*groups)


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """(id, url, html, bytes, digest, refers): refers is the id of the response a
    record revisits, else null. Payloads under ``least`` bytes are all responses.
    Null html: empty payload. Of rows that repeat the largest id, all are responses; a null id counts as the smallest."""
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), text_of(html_col).alias("html"))
    p = p.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    p = p.withColumn("key", F.xxhash64("sha"))
    # of repeated payloads only do texts move, at most one a task and payload; all others are written where they are read
    many = table(p.where(F.col("bytes") >= least).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated")
    p = marked(p, many, "key", "again").withColumn("again", F.col("again") & (F.col("bytes") >= least))
    once = p.where(~F.col("again")).select("id", "url", "html", "bytes", "sha", F.lit(None).cast("long").alias("refers"))
    again = p.where("again")
    last = again.groupBy("sha", "bytes").agg(F.max("id").alias("last"), F.first("html").alias("html"))
    more = again.select("id", "url", "bytes", "sha").join(last, ["sha", "bytes"]).withColumn("refers", F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last")))
    more = more.select("id", "url", F.when(F.col("refers").isNull(), F.col("html")).alias("html"), "bytes", "sha", "refers")
    return once.unionByName(more).select("id", "url", "html", "bytes", base32_of(F.col("sha")).alias("digest"), "refers")


def uri(url: Column) -> Column:
    """``url`` with its ASCII control signs and blanks percent-encoded, as a header line can't hold them."""
    out = url
    for code in (*range(33), 127):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), out).otherwise(url)


def record(date: str) -> Column:
    """A record's text, without the line ends that close it."""
    revisit = F.col("refers").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers").cast("string"), F.lit(">\r\n"))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"), body,
    )


#: Payloads of one kind are at most so many times the mean size; an archive holds as many records as fit if all were that long.
KINDS = (4, 64)


def write(pages: DataFrame, path: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2000-01-01T00:00:00Z", **columns) -> None:
    """Write a record per row of ``pages`` into archives under ``path``, of
    at most about ``archive_bytes`` each or one record: payloads far longer than
    the mean go to archives of their own kind. An empty table writes no record."""
    size = F.octet_length(text_of(columns.get("html_col", "html")))
    total, n = pages.agg(F.sum(size), F.count(F.lit(1))).first()
    mean = ((total or 0) + 500 * n) // max(n, 1) + 1  # with the header
    bounds = [0, *(k * mean for k in KINDS), None]
    ranges = [(size >= a) & (size < b) if b else size >= a for a, b in zip(bounds, bounds[1:])]
    filled = pages.agg(*(F.count_if(r) for r in ranges)).first()
    p = planned(pages, least=least, **columns)
    for (a, b), count in zip(zip(bounds, bounds[1:]), filled, strict=True):
        if not count and (a or n):
            continue
        own = p.where((F.col("bytes") >= a) & (F.col("bytes") < b)) if b else p.where(F.col("bytes") >= a)
        most = max(1, archive_bytes // (b + 500)) if b else 1
        own.select(record(date).alias("value")).write.mode("append").option("lineSep", END.decode()).option("maxRecordsPerFile", most).text(path)


HEADER = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")


def candidates(path: str, data: bytes) -> list[tuple]:
    """(path, offset, successor, header fields, payload) of each magic string: its
    header must close, and its length must lead to the file's end or at least to two line ends within it."""
    out, at = [], data.find(MAGIC)
    while at >= 0:
        stop = data.find(b"\r\n\r\n", at)
        if stop > 0:
            head = {k.lower(): v for k, v in HEADER.findall(data, at + len(MAGIC), stop + 2)}
            if (n := head.get(b"content-length", b"")).isdigit():
                start = stop + 4
                end = start + int(n)
                if data[end : end + 4] == END:
                    out.append((path, at, end + 4, {k.decode("latin-1"): v.decode("utf-8", "replace") for k, v in head.items()}, data[start:end]))
        at = data.find(MAGIC, at + 1)
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All candidates in the archives under ``path``: (path, offset, next, head, payload)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def find(batches):
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                got = candidates(name, bytes(data))
                for k in range(0, len(got), 500):
                    yield pd.DataFrame(got[k : k + 500], columns=["path", "offset", "next", "head", "payload"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # an archive a batch
    return files.mapInPandas(find, "path string, offset long, next long, head map<string,string>, payload binary")


def reachable(steps: DataFrame) -> DataFrame:
    """(path, offset) of the candidates on the chain from offset 0 of their file,
    of (path, offset, next). Pointer jumping: each round joins the candidates reached so far with the
    jumps, and then doubles these."""
    jump = table(steps.select("path", "offset", "next"), "jumps")
    seen = table(jump.where("offset = 0").select("path", "offset"), "seen")
    while not jump.isEmpty():
        reached = seen.join(jump, ["path", "offset"]).select("path", F.col("next").alias("offset"))
        seen = table(seen.unionByName(reached), "seen")
        far = jump.select("path", F.col("offset").alias("next"), F.col("next").alias("far"))
        jump = table(jump.join(far, ["path", "next"]).select("path", "offset", F.col("far").alias("next")), "jumps")
    there = steps.select("path", "offset")
    return seen.join(there, ["path", "offset"], "left_semi")


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``, in no order: path, offset,
    type, id, url, refers, payload_bytes, payload_digest, and the payload. Of a
    revisit, the length and digest are those its header gives; of a response,
    those of the payload itself. No archive or no record: no rows."""
    found = scan(spark, path)
    raw = F.col("payload")
    narrow = found.select("path", "offset", "next", "head", F.octet_length(raw).cast("long").alias("n"), base32_of(F.sha1(raw)).alias("sha"), *([raw] if payload else []))
    at = table(narrow, "candidates")
    prepare(spark)
    chain = reachable(at.select("path", "offset", "next"))
    kept = at.join(chain, ["path", "offset"])
    head = lambda k: F.element_at("head", k)
    revisit = F.lower(head("warc-type")) == "revisit"
    return kept.select(
        "path", "offset", head("warc-type").alias("type"),
        F.expr("try_cast(regexp_extract(element_at(head, 'warc-record-id'), '^<urn:page:(-?[0-9]+)>$', 1) as bigint)").alias("id"),
        head("warc-target-uri").alias("url"),
        F.expr("try_cast(regexp_extract(element_at(head, 'warc-refers-to'), '^<urn:page:(-?[0-9]+)>$', 1) as bigint)").alias("refers"),
        F.when(revisit, head("x-payload-length").cast("long")).otherwise(F.col("n")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(head("warc-payload-digest"), "^sha1:", "")).otherwise(F.col("sha")).alias("payload_digest"),
        *([raw] if payload else []),
    )


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as read back from the archives."""
    where = scratch(spark, "warc")
    write(read(spark, sf_dir, "pages"), where)
    got = read_archives(spark, where, payload=False)
    return got.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers").alias("refers_to"))


#: op8_warc in SQL. DuckDB has no base32: the digest's 40 hex digits are turned into letters by fives of bits.
SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
l AS (SELECT h, payload_bytes, max(page_id) AS last FROM p GROUP BY ALL)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{B32}', ((('0x' || substr(h, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN l USING (h, payload_bytes)"""
