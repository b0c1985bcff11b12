"""Content-addressed WARC archive.

An archive is a folder of two parquet tables.  ``payloads`` holds every payload once under
its SHA-256; ``headers`` holds one row per record: the exact header block, the digest of
its payload and what the header says.  Joining both gives back the records byte for byte.
``export_files`` writes plain WARC/1.1 files, ``import_files`` reads such files back into
records, exact header blocks included.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.llm.common import NO_ID, delete_path
from tripwise.session import scratch_path

#: base32 of RFC 4648, and the end of a WARC record.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"

PAYLOADS = "sha256 BINARY, payload BINARY"
HEADERS = "record BIGINT, page_id BIGINT, uri STRING, record_type STRING, refers_to BIGINT, header BINARY, sha256 BINARY"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: 160 bits are 32 digits of 5 bits without padding."""
    hex_ = F.sha1(data)
    groups = [F.conv(F.substring(hex_, 1 + 5 * g, 5), 16, 10).cast("int") for g in range(8)]
    digits = [
        F.substring(F.lit(BASE32), F.shiftright(g, 5 * (3 - i)).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in groups for i in range(4)
    ]
    return F.concat(*digits)


def record_id(page_id: Column, uri: Column) -> Column:
    """A record id that depends on the page only."""
    h = F.md5(F.concat_ws("\x01", F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(uri, F.lit(""))).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archive one record per row (page_id, url, html; other columns are ignored).

    A null html is an empty payload.  Of rows with equal payloads of at least
    ``min_revisit_bytes`` bytes those with the smallest page_id (null last) are responses
    and the others revisits that refer to it; repeated rows of that id are all responses.
    Smaller payloads are all responses.  Line breaks inside a url become spaces in the header.

    Payloads of one digest are compared by length and SHA-1 as well; should they differ,
    the write fails rather than storing one for the other.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("uri"), payload.alias("payload"))
    # numbered once and written without the payloads
    digests = scratch_path(spark, "digests")
    named = rows.select(
        "page_id", "uri", F.octet_length("payload").cast("bigint").alias("size"), F.unhex(F.sha2("payload", 256)).alias("sha256"),
        base32_sha1(F.col("payload")).alias("sha1"),
    ).withColumn("record", F.monotonically_increasing_id())
    named.write.parquet(digests)
    named = spark.read.schema("page_id BIGINT, uri STRING, size BIGINT, sha256 BINARY, sha1 STRING, record BIGINT").parquet(digests)
    first = named.groupBy("sha256").agg(
        F.min(F.struct(F.coalesce("page_id", F.lit(NO_ID)).alias("d"), "page_id", F.coalesce("uri", F.lit("")).alias("u"))).alias("b"),
        F.min(F.struct("size", "sha1")).alias("low"), F.max(F.struct("size", "sha1")).alias("high"),
    ).select(
        "sha256", F.col("b.d").alias("first"), F.col("b.u").alias("first_uri"), F.col("b.page_id").alias("first_id"),
        F.when(F.col("low") == F.col("high"), True).otherwise(F.raise_error(F.lit("two payloads share a SHA-256"))).alias("sound"),
    )
    # the stored copy comes from the first page: with its id and url in the key, copies of
    # a frequent payload spread over all tasks
    key = ["first", "first_uri", "sha256"]
    stored = rows.withColumns({
        "first": F.coalesce("page_id", F.lit(NO_ID)), "first_uri": F.coalesce("uri", F.lit("")), "sha256": F.unhex(F.sha2("payload", 256))})
    stored = stored.join(first.where("sound").select(*key), key, "left_semi")
    # the same page may occur twice: its rows agree, so any of them will do
    stored.dropDuplicates(key).select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    response = (F.col("size") < min_revisit_bytes) | (F.coalesce("page_id", F.lit(NO_ID)) == F.col("first"))
    told = named.join(first, "sha256").withColumns({
        "record_type": F.when(response, F.lit("response")).otherwise(F.lit("revisit")),
        "refers_to": F.when(~response, F.col("first_id")),
    })
    told.select(
        "record", "page_id", "uri", "record_type", "refers_to", _header(date).cast("binary").alias("header"), "sha256"
    ).write.option("compression", "zstd").parquet(f"{path}/headers")
    delete_path(spark, digests)


def _header(date: str) -> Column:
    """The exact header block, closing blank line included."""
    uri = F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\r\n]+", " ")
    refers = F.when(F.col("record_type") == "revisit", F.concat(
        F.lit("\r\nWARC-Refers-To: "), record_id(F.col("refers_to"), F.col("first_uri")),
        F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
    )).otherwise(F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), record_id(F.col("page_id"), F.col("uri")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"), refers,
        F.lit("\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END),
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from both tables: the header's words and the stored payload's
    length and digests, worked out anew from its bytes once per payload.

    A payload that no longer has its SHA-256, or that a header misdescribes, fails the read.
    """
    headers = spark.read.schema(HEADERS).parquet(f"{path}/headers")
    payloads = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    sound = payloads.select(
        "sha256", F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
        (F.unhex(F.sha2("payload", 256)) == F.col("sha256")).alias("sound"),
    )
    said = F.decode("header", "utf-8")
    both = headers.join(sound, "sha256", "left").withColumns({
        "said_bytes": F.regexp_extract(said, r"\r\nContent-Length: (\d+)\r\n\r\n$", 1).cast("bigint"),
        "said_digest": F.regexp_extract(said, r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]{32})\r\n", 1),
        "said_type": F.regexp_extract(said, r"^WARC/1\.1\r\nWARC-Type: (\w+)\r\n", 1),
    })
    fine = F.col("sound") & (F.col("said_bytes") == F.col("payload_bytes")) & (F.col("said_digest") == F.col("payload_digest"))
    checked = both.withColumn("record_type", F.when(fine, F.col("said_type")).otherwise(
        F.raise_error(F.concat(F.lit("damaged record "), F.col("record").cast("string")))))
    return checked.select("record", "page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "header", "sha256")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: record, page_id, header, payload and ``bytes``, the whole record.

    Payloads of revisits are filled in from the response's copy."""
    payloads = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    records = read_index(spark, path).join(payloads, "sha256")
    return records.withColumn("bytes", F.concat("header", "payload", F.lit(END.encode())))


def export_files(spark: SparkSession, path: str, target: str, compression: str = "gzip") -> None:
    """Write the archive as plain WARC files: one record after the other.

    Spark's text writer ends each record with the line separator, the second half of the
    record's end; text columns carry any bytes unchanged.
    """
    body = F.concat("header", "payload", F.lit(b"\r\n")).cast("string")
    read_records(spark, path).select(body.alias("value")).write.option("lineSep", "\r\n").option("compression", compression).text(target)


def import_files(spark: SparkSession, source: str) -> DataFrame:
    """Records (file, number, header, payload) of plain or gzip WARC files.

    One task reads one file at a time, as such files have no safe place to split; keep
    them at the usual size of about 1 GB or less."""
    files = spark.read.format("binaryFile").load(source).select("path", "content")
    return files.mapInPandas(_parse, "file string, number bigint, header binary, payload binary")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)
            at, number, rows = 0, 0, []
            while at < len(data):
                end = data.index(b"\r\n\r\n", at) + 4
                header = data[at:end]
                size = next(int(x.split(b":", 1)[1]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                rows.append((path, number, header, data[end:end + size]))
                at, number = end + size + 4, number + 1
                if len(rows) >= 1000:
                    yield pd.DataFrame(rows, columns=["file", "number", "header", "payload"])
                    rows = []
            yield pd.DataFrame(rows, columns=["file", "number", "header", "payload"])
