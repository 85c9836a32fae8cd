"""Audit analytics over the event log read as an audit trail."""

import datetime as dt

from pyspark.sql import functions as F

from lakewarden.operators import audit as A
from workload.registry import DERIVED, derive, query

DERIVED["audit_log"] = """
SELECT event_id AS id, ts AS timestamp,
  CASE event_type WHEN 'view' THEN 'query' WHEN 'error' THEN 'query' WHEN 'purchase' THEN 'query_metric' WHEN 'signup' THEN 'create' ELSE 'discover_schema' END AS action,
  CASE WHEN event_type = 'signup' AND user_id % 2 = 0 THEN 'datasource' ELSE 'semantic' END AS resource_type,
  concat('ds', user_id % 7) AS resource_id, concat('user-', user_id) AS api_key_id, concat('ds', user_id % 7) AS datasource_id,
  concat('{{"pii_counts":{{"email":', CAST(floor(value) AS BIGINT) % 4, ',"phone":', user_id % 3, '}}}}') AS details,
  event_type <> 'error' AND value > 1 AS success
FROM {events}"""


def audit_log(spark, sf_dir):
    return derive(spark, sf_dir, "audit_log")


def _stamp(*columns):
    return {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns}


@query("audit_actions", "SELECT action, count(*) AS events FROM {audit_log} GROUP BY action")
def audit_actions(spark, sf_dir):
    return A.actions_histogram(audit_log(spark, sf_dir))


@query(
    "audit_outcomes",
    """SELECT count(*) AS total, count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE NOT success) AS failed,
    round_even(count(*) FILTER (WHERE success) / count(*), 3) AS success_rate FROM {audit_log} WHERE action = 'query'""",
)
def audit_outcomes(spark, sf_dir):
    return A.query_outcomes(audit_log(spark, sf_dir))


@query(
    "audit_redactions",
    """SELECT 'email' AS pii_type, CAST(sum(CAST(json_extract(details, '$.pii_counts.email') AS BIGINT)) AS BIGINT) AS hits FROM {audit_log} WHERE action = 'query'
    UNION ALL SELECT 'phone', CAST(sum(CAST(json_extract(details, '$.pii_counts.phone') AS BIGINT)) AS BIGINT) FROM {audit_log} WHERE action = 'query'""",
)
def audit_redactions(spark, sf_dir):
    return A.redactions_by_type(audit_log(spark, sf_dir))


@query(
    "audit_milestones",
    """SELECT strftime(min(timestamp) FILTER (WHERE action = 'create' AND resource_type = 'datasource'), '%Y-%m-%d %H:%M:%S.%f') AS first_datasource_at,
    strftime(min(timestamp) FILTER (WHERE action = 'query' AND success), '%Y-%m-%d %H:%M:%S.%f') AS first_successful_query_at,
    strftime(max(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS last_activity_at FROM {audit_log}""",
)
def audit_milestones(spark, sf_dir):
    names = ("first_datasource_at", "first_successful_query_at", "last_activity_at")
    return A.milestones(audit_log(spark, sf_dir)).withColumns(_stamp(*names))


@query(
    "audit_recent",
    "SELECT id, action, api_key_id, success FROM {audit_log} ORDER BY id DESC LIMIT 100",
)
def audit_recent(spark, sf_dir):
    return A.recent(audit_log(spark, sf_dir), 100).select("id", "action", "api_key_id", "success")


_SINCE = dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc)


@query(
    "usage_since",
    "SELECT count(*) AS used FROM {audit_log} WHERE action IN ('query', 'query_metric') AND timestamp >= TIMESTAMP '2024-01-10'",
)
def usage_since(spark, sf_dir):
    return A.count_actions_since(audit_log(spark, sf_dir), A.METERED, _SINCE)


@query(
    "usage_monthly",
    """SELECT strftime(date_trunc('month', timestamp), '%Y-%m') AS month, count(*) AS used FROM {audit_log}
    WHERE action IN ('query', 'query_metric') GROUP BY 1""",
)
def usage_monthly(spark, sf_dir):
    out = A.monthly_usage(audit_log(spark, sf_dir))
    return out.withColumn("month", F.date_format("month", "yyyy-MM"))


def _quota_sql(licensed: bool) -> str:
    over = "CASE WHEN n = 1001 THEN 'overage' ELSE 'allowed' END" if licensed else "'blocked'"
    return f"""WITH n AS (SELECT id, row_number() OVER (PARTITION BY date_trunc('month', timestamp) ORDER BY timestamp, id) AS n
      FROM {{audit_log}} WHERE action IN ('query', 'query_metric'))
    SELECT id, CASE WHEN n <= 1000 THEN 'allowed' ELSE {over} END AS quota FROM n"""


@query("quota_free_plan", _quota_sql(False))
def quota_free_plan(spark, sf_dir):
    return A.classify_quota(audit_log(spark, sf_dir), cap=1000).select("id", "quota")


@query("quota_licensed", _quota_sql(True))
def quota_licensed(spark, sf_dir):
    return A.classify_quota(audit_log(spark, sf_dir), cap=1000, licensed=True).select("id", "quota")


@query(
    "quota_datasources",
    """WITH n AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS n FROM customer)
    SELECT id, CASE WHEN n <= 5 THEN 'registered' ELSE 'licensed for 5 datasources (5 registered)' END AS outcome FROM n""",
)
def quota_datasources(spark, sf_dir):
    rows = derive(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("created_at"))
    return A.datasource_quota(rows).select("id", "outcome")


@query(
    "entitlement_states",
    """SELECT o_orderkey, o_orderkey % 4 <> 0 AS licensed, o_orderdate < TIMESTAMP '1998-06-15' AS expired,
    o_orderdate < TIMESTAMP '1998-06-15' AND o_orderdate >= TIMESTAMP '1998-05-16' AS in_grace,
    o_orderdate < TIMESTAMP '1998-05-16' AS degraded FROM orders""",
)
def entitlement_states(spark, sf_dir):
    rows = derive(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.lit("lic")).alias("license_id"), F.col("o_orderdate").alias("expires_at")
    )
    as_of = F.to_timestamp(F.lit("1998-06-15"))
    return A.entitlement_state(rows, as_of).drop("license_id", "expires_at")
