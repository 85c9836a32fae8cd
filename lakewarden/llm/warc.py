"""A content-addressed WARC archive.

``payloads`` holds each distinct payload once under its SHA-256, ``headers`` holds
the exact header bytes of every record and the digest of its payload. Records are
rebuilt by joining the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of RFC 4648 (base32) against the digits of ``conv``.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_ID = "<urn:lakewarden:page:%s>"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: every five hex digits are four base32 ones."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32)


def _header(date: str) -> Column:
    """Header block of one record, ending with its empty line."""
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), F.format_string(RECORD_ID, F.col("record_key"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), F.format_string(RECORD_ID, F.col("refers_key")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")), "utf-8")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` (page_id, url, html; others are ignored).

    A null html is an empty payload. Of records with equal payloads of at least
    ``min_bytes`` bytes, the one with the largest page_id is the response and the
    others revisit it; a null page_id counts as smallest. Among rows that repeat
    that page_id and payload, the one with the largest url is the response; rows
    equal in all three columns are one record, stored with its number of copies,
    and only one of them is the response. A null url leaves out the target line.
    """
    payload = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    facts = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
        .select(
            "page_id", "url", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("payload_digest"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
        )
        .groupBy("page_id", "url", "sha256", "payload_digest", "payload_bytes")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    facts.write.parquet(f"{path}/facts")
    facts = pages.sparkSession.read.schema(facts.schema).parquet(f"{path}/facts")
    rank = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("id"), F.coalesce("url", F.lit("")).alias("url"))
    shared = F.col("payload_bytes") >= min_bytes
    # Partial sums fold the copies of a hot payload before anything is shuffled.
    first = facts.groupBy("sha256").agg(F.max(F.struct(rank.alias("rank"), "page_id", "url")).alias("first"))
    first = first.select("sha256", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    # Written, so that both sides of the next join are plain shuffles and a hot payload's side can be split.
    first.write.parquet(f"{path}/responses")
    first = pages.sparkSession.read.schema(first.schema).parquet(f"{path}/responses")
    leads = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    repeated = F.col("lead") & shared & (F.col("copies") > 1)
    once = F.struct(F.lit("response").alias("kind"), F.lit(1).cast("long").alias("times"))
    others = F.struct(F.lit("revisit").alias("kind"), (F.col("copies") - 1).alias("times"))
    alike = F.struct(F.when(F.col("lead"), "response").otherwise("revisit").alias("kind"), F.col("copies").alias("times"))
    records = (
        facts.join(first, "sha256")
        .withColumn("lead", leads | ~shared)
        # copies of a record that leads: one response, the rest revisit it
        .select("*", F.explode(F.when(repeated, F.array(once, others)).otherwise(F.array(alike))).alias("as"))
        .withColumn("record_type", F.col("as.kind"))
        .withColumn("record_key", F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
        .withColumn("refers_key", F.coalesce(F.col("first_id").cast("string"), F.lit("null")))
    )
    records.select("sha256", F.col("as.times").alias("times"), _header(date).alias("header")).write.parquet(
        f"{path}/headers"
    )
    # One row of each distinct payload: the join is by the row's own id, so a hot payload is no hot key.
    holders = first.select(F.col("first_id").alias("page_id"), F.col("first_url").alias("url"), "sha256").withColumn(
        "slot", F.xxhash64("page_id", "url", "sha256")
    )
    bodies = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn(
        "slot", F.xxhash64("page_id", "url", F.sha2("payload", 256))
    )
    (
        bodies.select("slot", "payload")
        .join(
            holders.select(F.col("slot").alias("holder_slot"), "sha256"),
            (F.col("slot") == F.col("holder_slot")) & (F.sha2("payload", 256) == F.col("sha256")),
        )
        # of rows equal in all columns the first; the keys are those of the join, so nothing is shuffled again
        .withColumn("before", F.lag("holder_slot").over(Window.partitionBy("sha256", "holder_slot").orderBy("sha256", "holder_slot")))
        .filter("before IS NULL")
        .select("sha256", "payload")
        .write.parquet(f"{path}/payloads")
    )


def _line(name: str) -> Column:
    # (?d): a line ends at a line feed only, which values never hold; other line ends are part of a value
    found = F.regexp_extract(F.decode("header", "utf-8"), rf"(?dm)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def _page(key: Column) -> Column:
    return F.regexp_extract(key, "page:(-?[0-9]+)>", 1)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Distinct payloads; a stored payload that does not match its digest fails the job."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("sha256")
    return stored.select(
        "sha256",
        F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))).alias("payload"),
    )


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Parsed headers, one row per record: sha256, header, record_type, page_id,
    refers_to, target_uri, payload_digest."""
    kept = spark.read.schema("sha256 string, times long, header binary").parquet(f"{path}/headers")
    refers = _page(_line("WARC-Refers-To"))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(
        "sha256", "header", _line("WARC-Type").alias("record_type"),
        _page(_line("WARC-Record-ID")).try_cast("long").alias("page_id"),
        refers.try_cast("long").alias("refers_to"), _line("WARC-Target-URI").alias("target_uri"),
        F.regexp_replace(_line("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Original records: header columns, the full payload of the page, and the exact
    WARC bytes (a revisit has no block)."""
    joined = read_headers(spark, path).join(read_payloads(spark, path), "sha256")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to;
    size and digest are taken anew from the stored payload, which is digested once
    however many records share it."""
    stored = read_payloads(spark, path).select(
        "sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("stored_digest")
    )
    same = F.col("stored_digest") == F.col("payload_digest")
    return read_headers(spark, path).drop("header").join(stored, "sha256").select(
        "page_id", "payload_bytes",
        F.when(same, F.col("stored_digest")).otherwise(F.raise_error(F.concat(F.lit("digest differs in record of "), F.col("page_id").cast("string")))).alias("payload_digest"),
        "record_type", "refers_to",
    )
