"""Audit log: append, listings, usage, quota and entitlement state.

Audit rows: id, timestamp, action, resource_type, resource_id, api_key_id,
datasource_id, details (JSON text), success.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metered actions, free grant and grace period.
METERED = ["query", "query_metric"]
FREE_DATASOURCES, FREE_QUERIES = 5, 1000
GRACE_DAYS = 30

AUDIT_SCHEMA = (
    "id bigint, timestamp timestamp, action string, resource_type string, resource_id string, "
    "api_key_id string, datasource_id string, details string, success boolean"
)
DETAILS_TYPE = (
    "request struct<sql:string>, rows bigint, pii_redactions bigint, pii_counts map<string,bigint>, "
    "include_pii boolean, basis string, reason string"
)


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows to a Parquet log partitioned by day."""
    rows.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def with_details(audit: DataFrame) -> DataFrame:
    return audit.withColumn("details", F.from_json("details", DETAILS_TYPE))


def recent(audit: DataFrame, limit: int = 100) -> DataFrame:
    return audit.orderBy(F.desc("id")).limit(limit)


def count_actions_since(audit: DataFrame, actions: list[str], since: dt.datetime) -> DataFrame:
    return audit.filter(F.col("action").isin(actions) & (F.col("timestamp") >= F.lit(since))).agg(
        F.count(F.lit(1)).alias("used")
    )


def actions_histogram(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action").agg(F.count(F.lit(1)).alias("events"))


def query_outcomes(audit: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed and the success rate to 3 places
    (half to even), null when there were no queries."""
    asked = F.col("action") == "query"
    totals = audit.agg(
        F.count_if(asked).alias("total"), F.count_if(asked & F.col("success")).alias("succeeded")
    )
    rate = F.when(F.col("total") > 0, F.bround(F.col("succeeded") / F.col("total"), 3))
    return totals.select(
        "total", "succeeded", (F.col("total") - F.col("succeeded")).alias("failed"), rate.alias("success_rate")
    )


def redactions_by_type(audit: DataFrame) -> DataFrame:
    """Redactions of all queries, by type. A session logs the counts of a finished query as
    "query_result"; older logs have them in the "query" row."""
    counts = audit.filter(F.col("action").isin("query", "query_result")).select(
        F.from_json("details", "pii_counts map<string,bigint>")["pii_counts"].alias("c")
    )
    return counts.select(F.explode("c").alias("pii_type", "hits")).groupBy("pii_type").agg(F.sum("hits").alias("hits"))


def milestones(audit: DataFrame) -> DataFrame:
    """One row: first datasource, first successful query, last activity."""
    def first(when: Column) -> Column:
        return F.min(F.when(when, F.col("timestamp")))

    return audit.agg(
        first((F.col("action") == "create") & (F.col("resource_type") == "datasource")).alias("first_datasource_at"),
        first((F.col("action") == "query") & F.col("success")).alias("first_successful_query_at"),
        F.max("timestamp").alias("last_activity_at"),
    )


def monthly_usage(audit: DataFrame) -> DataFrame:
    """Metered actions by UTC month, failures included. A metric run logs a
    query and a query_metric row and so counts twice."""
    metered = audit.filter(F.col("action").isin(METERED))
    return metered.groupBy(F.date_trunc("month", "timestamp").alias("month")).agg(F.count(F.lit(1)).alias("used"))


def first_past_cap(metered: DataFrame, cap: int) -> DataFrame:
    """(month, at, id): the first metered event of each month past the cap.

    Counts per second find the second in which the cap is crossed (a month has
    a fixed number of seconds); only the events of that one second are ranked.
    """
    second = F.date_trunc("second", "timestamp")
    per_second = metered.groupBy("month", second.alias("second")).agg(F.count(F.lit(1)).alias("n"))
    in_month = F.sum("n").over(Window.partitionBy("month").orderBy("second"))
    crossing = (
        per_second.withColumn("upto", in_month)
        .filter((F.col("upto") > cap) & (F.col("upto") - F.col("n") <= cap))
        .select("month", "second", (F.lit(cap) - (F.col("upto") - F.col("n"))).alias("left"))
    )
    tied = metered.withColumn("second", second).join(F.broadcast(crossing), ["month", "second"])
    place = F.row_number().over(Window.partitionBy("month").orderBy("timestamp", "id"))
    # The rank filter keeps only the first rows per task before the shuffle.
    ranked = tied.withColumn("place", place).filter(F.col("place") <= cap + 1)
    return ranked.filter(F.col("place") == F.col("left") + 1).select("month", F.col("timestamp").alias("at"), "id")


def classify_quota(audit: DataFrame, *, cap: int = FREE_QUERIES, licensed: bool = False) -> DataFrame:
    """Adds month and quota to metered events: allowed, overage (recorded once,
    on the first event past the cap) or blocked.

    A blocked query is free, so once the cap is reached the month stays there:
    everything is decided by comparing an event with its month's first event
    past the cap, and no month is ever ranked as one group.
    """
    metered = audit.filter(F.col("action").isin(METERED)).withColumn("month", F.date_trunc("month", "timestamp"))
    edge = first_past_cap(metered, cap).select("month", F.struct("at", F.col("id").alias("eid")).alias("edge"))
    # One row per calendar month.
    joined = metered.join(F.broadcast(edge), "month", "left")
    me = F.struct(F.col("timestamp").alias("at"), F.col("id").alias("eid"))
    past = F.when(F.lit(licensed), F.when(me == F.col("edge"), "overage").otherwise("allowed")).otherwise("blocked")
    return joined.withColumn(
        "quota", F.when(F.col("edge").isNull() | (me < F.col("edge")), "allowed").otherwise(past)
    ).drop("edge")


def entitlement_state(entitlements: DataFrame, as_of: Column) -> DataFrame:
    """Adds licensed, expired, in_grace, degraded to rows with license_id and
    expires_at."""
    expired = F.coalesce(as_of > F.col("expires_at"), F.lit(False))
    grace = expired & (as_of <= F.col("expires_at") + F.expr(f"INTERVAL {GRACE_DAYS} DAYS"))
    return entitlements.withColumns(
        {
            "licensed": F.col("license_id").isNotNull(),
            "expired": expired,
            "in_grace": grace,
            "degraded": expired & ~grace,
        }
    )


def datasource_quota(registrations: DataFrame, *, max_datasources: int = FREE_DATASOURCES, degraded: bool = False) -> DataFrame:
    """Adds `outcome` to registration attempts (id, created_at): registered, or
    why not. The first `max_datasources` are found with a bounded sort."""
    me = F.struct("created_at", "id")
    last = (
        registrations.orderBy("created_at", "id").limit(max_datasources)
        .agg(F.max(me).alias("last"), F.count(F.lit(1)).alias("held"))
    )
    judged = registrations.withColumn("__last", last.select("last").scalar())
    limit = F.lit(f"licensed for {max_datasources} datasources ({max_datasources} registered)")
    expired = F.lit("license expired: renew to register new datasources (existing sources keep serving)")
    outcome = F.when(F.lit(degraded), expired).when(me <= F.col("__last"), "registered").otherwise(limit)
    return judged.withColumn("outcome", outcome).drop("__last")
