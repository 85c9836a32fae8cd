"""The stream forms of redaction, audit rollup and decisions, over whole tables."""

import uuid

from pyspark.sql import functions as F

from lakewarden.operators.redact import as_numbers
from lakewarden.session import shared_root
from lakewarden.streaming.governed_stream import audit_rollup, decided_stream, governed_stream, land
from workload.pii import redaction_ctes
from workload.policy import decision_sql
from workload.registry import DERIVED, derive, query, table


def _stream(spark, sf_dir, name):
    """A given table, read as a stream of files; by a pattern, as it may be one file or a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _landed(rows, name):
    return land(rows, f"{shared_root(rows.sparkSession)}/{name}-{uuid.uuid4().hex}")


@query(
    "stream_governed_documents",
    f"WITH {redaction_ctes('documents', 'doc_id, lang, n_chars', 'text')} SELECT doc_id, lang, n_chars, t AS text FROM r5",
)
def stream_governed_documents(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents")
    landed = _landed(governed_stream(docs, ["SOURCE"]), "governed-documents")
    return as_numbers(landed, docs.drop("source").schema).select("doc_id", "lang", "n_chars", "text")


@query(
    "stream_audit_rollup",
    """SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS window_start, action, count(*) AS events,
      count(*) FILTER (WHERE NOT success) AS failed,
      CAST(sum(CAST(json_extract(details, '$.pii_counts.email') AS BIGINT) + CAST(json_extract(details, '$.pii_counts.phone') AS BIGINT)) AS BIGINT) AS redactions
    FROM {audit_log} GROUP BY date_trunc('hour', timestamp), action
    HAVING date_trunc('hour', timestamp) + INTERVAL 1 HOUR <= (SELECT max(timestamp) - INTERVAL 10 MINUTE FROM {audit_log})""",
)
def stream_audit_rollup(spark, sf_dir):
    """Windows that the watermark has closed by the end of the table."""
    log = spark.sql(DERIVED["audit_log"], events=_stream(spark, sf_dir, "events"))
    landed = _landed(audit_rollup(log, every="1 hour"), "audit-rollup")
    return landed.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_decisions", decision_sql(True))
def stream_decisions(spark, sf_dir):
    asked = spark.sql(DERIVED["requests"], events=_stream(spark, sf_dir, "events"))
    landed = _landed(decided_stream(asked, derive(spark, sf_dir, "policies"), default_deny=True), "decisions")
    return landed.select("event_id", "allowed", "denied_by", "default_denied", F.array_join("masked_columns", ",").alias("masks"))
