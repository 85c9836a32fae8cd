"""Redaction, live audit rollups and policy decisions on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.operators.policy import decide, strip_masked
from lakewarden.operators.redact import redact


def governed_stream(rows: DataFrame, masked: list[str], *, numeric: str = "variant") -> DataFrame:
    """Mask and redact rows before they land, with the result that a batch has: stateless
    projections only, typed by the schema."""
    return redact(strip_masked(rows, masked), numeric=numeric)


def audit_rollup(audit: DataFrame, *, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Actions, failures and redactions per window; late rows are bounded by
    the watermark."""
    hits = F.aggregate(
        F.map_values(F.from_json("details", "pii_counts map<string,bigint>")["pii_counts"]),
        F.lit(0).cast("bigint"), lambda acc, n: acc + n,
    )
    return (
        audit.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        .withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", every), "action")
        .agg(
            F.count(F.lit(1)).alias("events"), F.count_if(~F.col("success")).alias("failed"),
            F.sum(F.coalesce(hits, F.lit(0))).alias("redactions"),
        )
        .select(F.col("window.start").alias("window_start"), "action", "events", "failed", "redactions")
    )


def decided_stream(requests: DataFrame, policies: DataFrame, *, default_deny: bool = False) -> DataFrame:
    """Decisions on a request stream against the static policy table."""
    return decide(requests, policies, default_deny=default_deny)


def land(rows: DataFrame, path: str) -> DataFrame:
    """All rows that are available now, appended under `path` exactly once, and read back.

    The offsets and state stay beside the rows, so a later call with the same path takes
    up where this one, or one that was lost, has stopped. Windows land when the watermark
    has passed them."""
    done = (
        rows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    )
    done.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
