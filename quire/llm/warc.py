"""Content-addressed WARC archive.

An archive is two tables in a folder. `payloads` holds every distinct payload once, under its SHA-256; `headers` holds one
row a record: its exact header block, byte for byte, and the SHA-256 of its payload. A record is rebuilt by joining the
two, and a payload counts as read only if its bytes still give the digest it is stored under.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import durable, hint_small

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BROADCAST_IDS = 2_000_000  # revisiting ids (16 MB) up to which they are broadcast; above, both sides are shuffled
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each of the 32 characters is five bits out of two hex digits of the sum."""

    def letters(digits: Column) -> Column:
        pair = lambda i: F.conv(F.substring(digits, i * 5 // 4 + 1, 2), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(pair(i), 3 - i % 4).bitwiseAND(31) + 1, F.lit(1)) for i in range(32)])

    return F.transform(F.array(F.sha1(payload)), letters)[0]  # the sum is computed once and not for every letter


def _header(kind: Column) -> Column:
    """The record's header block with its closing empty line."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\r\n"))
    revisit = kind == "revisit"
    return F.encode(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", kind),
            line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
            F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "%0A"))).otherwise(""),
            line("WARC-Date", F.lit(DATE)),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            F.when(
                revisit,
                F.concat(
                    line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("response_id").cast("string"), F.lit(">"))),
                    line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                )
            ).otherwise(""),
            line("Content-Type", F.lit("text/html; charset=utf-8")),
            line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))),
            F.lit("\r\n"),
        ),
        "utf-8",
    )


def write_archive(pages: DataFrame, path: str, *, least: int = 0) -> None:
    """Writes payloads and headers under path.

    Of the records with equal payloads of at least `least` bytes, the one with the largest page_id is a response and the
    others are revisits of it; shorter payloads are responses each, though their bytes are stored once as well. The
    payload is the html in UTF-8; a null html is an empty payload. Rows that repeat a page_id with an equal payload are
    records of their own, all of the same type. Null page_ids rank lowest. Extra columns are ignored.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    slim = durable(
        pages.select("page_id", url.alias("url"), payload.alias("p")).select(
            "page_id", "url", F.sha2("p", 256).alias("sha256"), base32_sha1(F.col("p")).alias("sha1"),
            F.octet_length("p").cast("long").alias("payload_bytes")
        ),
        "warc-slim",
    )
    first = slim.groupBy("sha256").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
    # Only digests that occur again need the join; the rest are responses. They are written first: broadcast if they are
    # few, else both sides of the join are scans, whose exchange adaptive execution splits where a digest is hot.
    again = slim.join(hint_small(first.where("n > 1"), "warc-again"), "sha256", "left")
    revisit = (F.col("payload_bytes") >= least) & F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    again.withColumn("header", _header(kind)).select("header", "sha256").write.option("compression", "zstd").parquet(f"{path}/headers")
    # Payloads are written by the one page that keeps them, so that only ids move and not the bytes.
    spare = durable(
        again.where("n > 1").where(~F.col("page_id").eqNullSafe(F.col("response_id"))).select(
            F.col("page_id").alias("_spare"), F.col("sha256").alias("_sum")
        ).distinct(),
        "warc-spare"
    )
    n = spare.count()
    full = pages.select("page_id", payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    if n:
        same = full["page_id"].eqNullSafe(spare["_spare"]) & (full["sha256"] == spare["_sum"])
        full = full.join(F.broadcast(spare) if n <= BROADCAST_IDS else spare, same, "left_anti")
    rows = slim.agg(F.count("*"), F.count_distinct(F.struct("page_id", "sha256"))).first()
    if rows[0] > rows[1]:  # repeated rows: one of them keeps the bytes
        full = full.groupBy("sha256").agg(F.first("payload").alias("payload"))
    full.select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, payload); fails on a payload whose bytes do not give the digest it is stored under."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    good = F.when(
        F.sha2("payload", 256) == F.col("sha256"), F.col("payload")
    ).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary"))
    return stored.select("sha256", good.alias("payload"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload): the records as written, each with its whole payload, revisits too."""
    headers = spark.read.schema("header binary, sha256 string").parquet(f"{path}/headers")
    return headers.join(read_payloads(spark, path), "sha256").select("header", "payload")


def record_bytes(records: DataFrame) -> DataFrame:
    """(record): bytes of the records as they stand in a WARC file; a revisit has no body."""
    body = F.when(F.decode("header", "utf-8").contains("WARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    return records.select(F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, taken from header blocks and payload bytes."""
    head = F.decode("header", "utf-8")
    field = lambda name: F.nullif(F.regexp_extract(head, rf"(?md)^{name}: (.*?)\r$", 1), F.lit(""))
    page = lambda name: F.regexp_extract(head, rf"(?md)^{name}: <urn:page:(-?\d+)>\r$", 1).try_cast("long")
    return records.select(
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        field("WARC-Payload-Digest").alias("declared_digest"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT x, max(page_id) AS r FROM p GROUP BY x)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(p.x, (i * 5 // 4 + 1)::INTEGER, 2))::INTEGER >> (3 - i % 4)::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = r THEN NULL ELSE r END AS refers_to
FROM p JOIN m ON p.x = m.x
"""
