"""WARC archives: write, read back, and resolve revisits.

Record headers (never payloads) are shuffled by payload digest to choose, of equal payloads, the
page that is the response; the others become revisit records without payload. Archives
are written by Spark's text sink, whose line separator is the blank line that ends every WARC
record, so they can be in any store that Spark writes. Files are gzip-compressed as a whole. They are
read with the binaryFile source by their Content-Length fields, so payloads may hold anything.

Defined cases. Null html: the empty payload. Null page_id: written without an id, read as null, never chosen as
the response while another page has the payload. Of rows that repeat the chosen page_id and html the first by url is
the response, the others revisit it. Payloads under min_bytes are all responses. Empty table: no records. Other columns don't take part,
but for url, which becomes WARC-Target-URI if it's there.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Records in a file at most, and bytes of payload in a file by their mean; a file is read back as one cell of its compressed bytes, a record at a time.
FILE_RECORDS, FILE_BYTES = 5_000, 2**27
#: Fixed values of the archive format (ISO 28500, WARC 1.1).
VERSION = "WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_SCHEMA = "page_id long, uri string, record_type string, refers_to long, content_length long, payload_bytes long, payload_digest string, actual_digest string"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: every 5 hexadecimal digits make 4 base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), HEX_DIGITS, BASE32_DIGITS)


def headers_of(pages: DataFrame) -> DataFrame:
    html = C.text_of("html")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(html).alias("payload_digest"))


def resolve(headers: DataFrame, min_bytes: int = 0, keep: str = "max") -> DataFrame:
    """Headers with refers_to, the page whose record holds the payload, or null where the record holds it itself; headers is read several times."""
    total = headers.count()
    best = F.max("page_id") if keep == "max" else F.min("page_id")
    groups = headers.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(best.alias("response_id"), F.count("*").alias("n")).filter("n > 1")
    joined = C.join_group_facts(headers, groups, "payload_digest", "n", total)
    return joined.select("page_id", "payload_bytes", "payload_digest", F.when((F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")).alias("refers_to"))


def record_text(kind: Column, uri: Column, page_id: Column, digest: Column, size: Column, refers_to: Column, payload: Column) -> Column:
    """A record without the blank line that ends it."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    field = lambda name, c: F.coalesce(F.concat(F.lit(f"\r\n{name}: "), c), F.lit(""))
    revisit = kind == "revisit"
    return F.concat(
        F.lit(VERSION),
        field("WARC-Type", kind),
        field("WARC-Record-ID", urn(page_id)),
        field("WARC-Target-URI", F.regexp_replace(uri, r"[\r\n]+", " ")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        field("WARC-Refers-To", F.when(revisit, urn(refers_to))),
        field("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        field("Content-Type", F.when(~revisit, F.lit("text/html; charset=utf-8"))),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(size.cast("string"))),
        F.lit(END),
        F.when(revisit, F.lit("")).otherwise(payload),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, keep: str = "max") -> None:
    """Write a record per row of pages under path, each payload once."""
    spark = pages.sparkSession
    headers = C.materialize(headers_of(pages), "headers")
    decided = resolve(headers, min_bytes, keep)
    revisits = decided.filter(F.col("refers_to").isNotNull()).select(F.col("page_id").alias("r_id"), "refers_to", F.col("payload_digest").alias("r_digest")).distinct()
    uri = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), uri.alias("uri"), C.text_of("html").alias("html"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("html")))
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left")
    rows = rows.select("page_id", "uri", "html", "payload_digest", "refers_to", F.col("refers_to").isNotNull().alias("again"))
    key = F.struct(F.col("page_id"), F.col("payload_digest")).alias("k")
    alike = decided.filter(F.col("refers_to").isNull() & (F.col("payload_bytes") >= min_bytes)).groupBy(key).count().filter("count > 1").select("k")
    if alike.limit(1).count():  # rows that repeat a response
        keyed = rows.select(key, "*")
        same = lambda x: keyed["k"].eqNullSafe(x["k"])
        twins = keyed.join(alike, same(alike), "left_semi").withColumn("again", F.row_number().over(Window.partitionBy("k").orderBy("uri")) > 1)
        twins = twins.withColumn("refers_to", F.when(F.col("again"), F.col("page_id")))
        rows = keyed.join(alike, same(alike), "left_anti").unionByName(twins).drop("k")
    kind = F.when(F.col("again"), "revisit").otherwise("response")
    lines = rows.select(record_text(kind, F.col("uri"), F.col("page_id"), F.col("payload_digest"), F.octet_length("html"), F.col("refers_to"), F.col("html")).alias("value"))
    mean = headers.agg(F.avg("payload_bytes")).first()[0] or 0
    records = max(1, min(FILE_RECORDS, int(FILE_BYTES / (mean + 1))))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
    C.discard(headers)


def parse_archive(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record."""
    while line := stream.readline():
        if not re.fullmatch(rb"WARC/\d\.\d\r\n", line):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("the archive ends inside a header")
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its Content-Length says")
        yield fields, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: its headers, and length and digest of the payload it holds."""

    def page(urn: str | None) -> int | None:
        return int(m[1]) if urn and (m := re.fullmatch(r"<urn:page:(-?\d+)>", urn)) else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                data = b.column("content")[k].as_py()
                stream = io.BytesIO(data)
                out: list[list] = [[] for _ in range(8)]
                for fields, block in parse_archive(io.BufferedReader(gzip.GzipFile(fileobj=stream)) if data[:2] == b"\x1f\x8b" else stream):
                    held = fields["warc-type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(block).digest()).decode() if held else None
                    row = (page(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields["warc-type"], page(fields.get("warc-refers-to")), len(block), len(block) if held else None, fields.get("warc-payload-digest", "").removeprefix("sha1:"), digest)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["page_id", "uri", "record_type", "refers_to", "content_length", "payload_bytes", "payload_digest", "actual_digest"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, RECORD_SCHEMA)


def resolve_records(records: DataFrame) -> DataFrame:
    """Records read from archives, revisits joined by digest to the response they revisit; a response whose payload doesn't have its digest fails the job."""
    responses, revisits = records.filter("record_type = 'response'"), records.filter("record_type = 'revisit'")
    checked = F.when(F.col("payload_digest") == F.col("actual_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ in record "), F.col("page_id").cast("string"))))
    own = responses.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    counts = revisits.groupBy("payload_digest").agg(F.count("*").alias("n"))
    originals = responses.select("payload_digest", "payload_bytes", F.col("page_id").alias("original")).join(counts, "payload_digest")
    originals = originals.groupBy("payload_digest").agg(F.max("original").alias("original"), F.max("payload_bytes").alias("payload_bytes"), F.max("n").alias("n"))
    linked = C.join_group_facts(revisits.select("page_id", "payload_digest", "record_type", "refers_to"), originals, "payload_digest", "n", records.count())
    return own.unionByName(linked.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.fresh_path(spark, "warc")
    write_archives(C.load(spark, sf_dir, "pages"), path, min_bytes=0, keep="max")
    C.release(spark)
    records = C.materialize(read_archives(spark, path), "records")
    C.remove_path(spark, path)
    return resolve_records(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
     b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
                  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                         1 + CAST((CAST(('0x' || substr(hex, 1 + 5 * (k // 4), 5)) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest
           FROM h),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM g
"""
