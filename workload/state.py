"""Transitions of relationship, metric and policy tables."""

from pyspark.sql import functions as F

from lakewarden.operators import state as S
from lakewarden.plans.detection import detect_run
from workload.joins import columns_meta
from workload.registry import DERIVED, derive, query



def _now():
    return F.to_timestamp(F.lit("2030-01-01"))


# One stored edge per customer; orders bring incoming edges in both directions.
DERIVED["stored"] = """
SELECT concat('rel-', c_custkey) AS id, concat('crm', c_custkey % 3) AS from_datasource_id, concat('customers', c_custkey) AS from_table,
  'id' AS from_column, 'shop' AS to_datasource_id, concat('orders', c_custkey % 50) AS to_table, concat('customer', c_custkey) AS to_column,
  CASE WHEN c_nationkey % 5 = 0 THEN 'foreign_key' ELSE 'candidate_join' END AS kind,
  CASE c_nationkey % 5 WHEN 0 THEN 'structural' WHEN 1 THEN 'heuristic' WHEN 2 THEN 'proposed' WHEN 3 THEN 'behavioral' ELSE 'heuristic' END AS source,
  CASE WHEN c_nationkey % 5 = 0 THEN 'approved' WHEN c_acctbal < 2000 THEN 'rejected' WHEN c_acctbal < 5000 THEN 'approved' ELSE 'candidate' END AS status,
  CAST(CASE WHEN c_nationkey % 5 = 0 THEN 1.0 ELSE 0.8 END AS DOUBLE) AS confidence, concat('kept ', c_custkey) AS rationale,
  CAST('2024-01-01' AS TIMESTAMP) AS created_at, CAST('2024-01-01' AS TIMESTAMP) AS updated_at FROM {customer}"""

DERIVED["incoming"] = """
SELECT CASE WHEN flip THEN d2 ELSE d1 END AS from_datasource_id, CASE WHEN flip THEN t2 ELSE t1 END AS from_table,
  CASE WHEN flip THEN c2 ELSE c1 END AS from_column, CASE WHEN flip THEN d1 ELSE d2 END AS to_datasource_id,
  CASE WHEN flip THEN t1 ELSE t2 END AS to_table, CASE WHEN flip THEN c1 ELSE c2 END AS to_column,
  CASE WHEN fact THEN 'foreign_key' ELSE 'candidate_join' END AS kind, CASE WHEN fact THEN 'structural' ELSE 'heuristic' END AS source,
  CAST(CASE WHEN fact THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence, concat('found ', ord) AS rationale, ord
FROM (SELECT o_orderkey AS ord, o_orderkey % 2 = 0 AS flip, o_orderpriority = '1-URGENT' AS fact,
  concat('crm', o_custkey % 3) AS d1, concat('customers', o_custkey) AS t1, CASE WHEN o_orderstatus = 'F' THEN 'code' ELSE 'id' END AS c1,
  'shop' AS d2, concat('orders', o_custkey % 50) AS t2, concat('customer', o_custkey) AS c2 FROM {orders}) x"""

_EDGE = "from_datasource_id, from_table, from_column, to_datasource_id, to_table, to_column"
_KEYED = """CASE WHEN (from_datasource_id, from_table, from_column) < (to_datasource_id, to_table, to_column)
  THEN concat_ws('~', from_datasource_id, from_table, from_column, to_datasource_id, to_table, to_column)
  ELSE concat_ws('~', to_datasource_id, to_table, to_column, from_datasource_id, from_table, from_column) END AS edge"""


def _upserted(incoming: str) -> str:
    picked = ["kind", "source", "rationale", *_EDGE.split(", ")]
    cols = ", ".join(
        f"CASE WHEN s.edge IS NULL OR up THEN CASE WHEN fo IS NOT NULL THEN f.{c} ELSE n.{c} END ELSE s.{c} END AS {c}" for c in picked
    )
    return f"""st AS (SELECT *, {_KEYED} FROM {{stored}}), inc AS (SELECT *, {_KEYED} FROM {incoming}),
    g AS (SELECT edge, min(ord) AS no, min(ord) FILTER (WHERE source = 'structural') AS fo FROM inc GROUP BY edge),
    j AS (SELECT coalesce(s.edge, g.edge) AS edge, g.no, g.fo, s.edge IS NOT NULL AND g.fo IS NOT NULL AND s.source <> 'structural' AS up
      FROM st s FULL JOIN g ON s.edge = g.edge),
    merged AS (SELECT s.id, {cols}, j.edge,
      CASE WHEN (s.edge IS NULL OR up) AND fo IS NOT NULL THEN 'approved' WHEN s.edge IS NULL THEN 'candidate' ELSE s.status END AS status,
      CASE WHEN (s.edge IS NULL OR up) AND fo IS NOT NULL THEN 1.0 WHEN s.edge IS NULL THEN n.confidence ELSE s.confidence END AS confidence,
      CASE WHEN s.edge IS NULL THEN 'created' WHEN up THEN 'upgraded' ELSE 'kept' END AS change
      FROM j LEFT JOIN st s ON s.edge = j.edge LEFT JOIN inc n ON n.ord = j.no AND n.edge = j.edge LEFT JOIN inc f ON f.ord = j.fo AND f.edge = j.edge)"""


def _shown(df):
    known_id = F.when(F.col("change") != "created", F.col("id"))
    return df.withColumn("id", known_id).drop("created_at", "updated_at")


@query(
    "relationship_upsert",
    f"WITH {_upserted('{incoming}')} SELECT id, {_EDGE}, kind, source, status, confidence, rationale, change FROM merged",
)
def relationship_upsert(spark, sf_dir):
    return _shown(S.upsert_relationships(derive(spark, sf_dir, "stored"), derive(spark, sf_dir, "incoming"), _now()))


DERIVED["foreign_keys"] = """
SELECT DISTINCT concat('crm', o_custkey % 3) AS datasource_id, concat('customers', o_custkey) AS from_table, 'id' AS from_column,
  concat('customers', o_custkey + 3) AS to_table, 'id' AS to_column FROM {orders} WHERE o_orderpriority = '2-HIGH'"""


@query(
    "relationship_sync_structural",
    f"""WITH fk AS (SELECT datasource_id AS from_datasource_id, from_table, from_column, datasource_id AS to_datasource_id, to_table, to_column,
      'foreign_key' AS kind, 'structural' AS source, 1.0 AS confidence, 'foreign key constraint in the source database' AS rationale,
      row_number() OVER (ORDER BY from_table) AS ord FROM {{foreign_keys}}), {_upserted('fk')}
    SELECT id, {_EDGE}, kind, source, status, confidence, rationale, change FROM merged
    WHERE NOT (source = 'structural' AND from_datasource_id IN ('crm0', 'crm1') AND edge NOT IN (SELECT edge FROM inc))""",
)
def relationship_sync_structural(spark, sf_dir):
    found = spark.sql("SELECT 'crm0' AS datasource_id UNION ALL SELECT 'crm1'")
    keys = derive(spark, sf_dir, "foreign_keys")
    return _shown(S.sync_structural(derive(spark, sf_dir, "stored"), found, keys, _now()))


DERIVED["reviews"] = """
SELECT concat('rel-', o_custkey) AS id, CASE WHEN o_totalprice < 250000 THEN 'approved' ELSE 'rejected' END AS status,
  o_orderkey AS ord FROM {orders}"""


@query(
    "relationship_review",
    """WITH r AS (SELECT id, arg_max(status, ord) AS new FROM {reviews} GROUP BY id)
    SELECT s.id, CASE WHEN new IS NOT NULL AND source <> 'structural' THEN new ELSE status END AS status,
      CASE WHEN new IS NOT NULL AND source <> 'structural' THEN status END AS previous_status,
      CASE WHEN new IS NULL THEN 'untouched' WHEN source = 'structural' THEN 'conflict' ELSE 'applied' END AS outcome
    FROM {stored} s LEFT JOIN r ON r.id = s.id""",
)
def relationship_review(spark, sf_dir):
    out = S.review(derive(spark, sf_dir, "stored"), derive(spark, sf_dir, "reviews"), _now())
    return out.select("id", "status", "previous_status", "outcome")


DERIVED["live_columns"] = """
SELECT concat('crm', c_custkey % 3) AS datasource_id, concat('customers', c_custkey) AS "table", 'id' AS "column"
FROM {customer} WHERE c_mktsegment <> 'MACHINERY' AND c_custkey % 3 <> 2"""


def live_columns(spark, sf_dir):
    text = DERIVED["live_columns"].replace('"table"', "`table`").replace('"column"', "`column`")
    return spark.sql(text, customer=derive(spark, sf_dir, "customer"))


@query(
    "relationship_prune",
    """SELECT id, status FROM {stored} s WHERE NOT (status = 'candidate'
      AND from_datasource_id IN (SELECT datasource_id FROM {live_columns})
      AND NOT EXISTS (SELECT 1 FROM {live_columns} l WHERE l.datasource_id = s.from_datasource_id AND l."table" = s.from_table AND l."column" = s.from_column))""",
)
def relationship_prune(spark, sf_dir):
    return S.prune_candidates(derive(spark, sf_dir, "stored"), live_columns(spark, sf_dir)).select("id", "status")


DERIVED["metric_rows"] = """
SELECT concat('m', p_partkey) AS id, concat(p_name, ' ', p_partkey) AS name, p_type AS description, concat('crm', p_partkey % 5) AS datasource_id,
  CASE WHEN p_size < 20 THEN 'candidate' ELSE 'approved' END AS status, p_partkey AS created_at FROM {part}"""
DERIVED["policy_rows"] = "SELECT concat('p', s_suppkey) AS name, concat('crm', s_suppkey % 5) AS resource_id FROM {supplier}"


@query(
    "source_cascade_delete",
    """SELECT 'relationship' AS kind, id FROM {stored} WHERE from_datasource_id <> 'crm1' AND to_datasource_id <> 'crm1'
    UNION ALL SELECT 'metric', id FROM {metric_rows} WHERE datasource_id <> 'crm1'
    UNION ALL SELECT 'policy', name FROM {policy_rows} WHERE resource_id <> 'crm1'""",
)
def source_cascade_delete(spark, sf_dir):
    gone = derive(spark, sf_dir, "region").filter("r_regionkey = 1").selectExpr("concat('crm', r_regionkey) AS datasource_id")
    kept = S.drop_sources(gone, *(derive(spark, sf_dir, n) for n in ("stored", "metric_rows", "policy_rows")))
    parts = [
        df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
        for df, kind, key in zip(kept, ("relationship", "metric", "policy"), ("id", "id", "name"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "relationship_listing",
    "SELECT id, status FROM {stored} WHERE status = 'candidate' AND (from_datasource_id = 'crm0' OR to_datasource_id = 'crm0')",
)
def relationship_listing(spark, sf_dir):
    out = S.list_relationships(derive(spark, sf_dir, "stored"), status="candidate", datasource_id="crm0")
    return out.select("id", "status")


@query("metric_listing", "SELECT id, name FROM {metric_rows} WHERE status = 'approved'")
def metric_listing(spark, sf_dir):
    return S.list_metrics(derive(spark, sf_dir, "metric_rows"), status="approved").select("id", "name")


@query(
    "outstanding_proposals",
    """SELECT (SELECT count(*) FROM {stored} WHERE status = 'candidate' AND source IN ('proposed', 'behavioral'))
      + (SELECT count(*) FROM {metric_rows} WHERE status = 'candidate') AS outstanding""",
)
def outstanding_proposals(spark, sf_dir):
    return S.outstanding_proposals(derive(spark, sf_dir, "stored"), derive(spark, sf_dir, "metric_rows"))


@query(
    "schema_relationships",
    """SELECT id, status, CASE WHEN status = 'approved' THEN 0 ELSE 1 END AS status_rank FROM {stored}
    WHERE status <> 'rejected' AND from_datasource_id IN ('crm0', 'shop') AND to_datasource_id IN ('crm0', 'shop')""",
)
def schema_relationships(spark, sf_dir):
    seen = derive(spark, sf_dir, "region").selectExpr("if(r_regionkey = 0, 'crm0', 'shop') AS datasource_id")
    return S.schema_relationships(derive(spark, sf_dir, "stored"), seen).select("id", "status", "status_rank")


@query(
    "export_relationships",
    """SELECT id, concat('  - from: "', from_datasource_id, '/', from_table, '.', from_column, '"', chr(10), '    to: "', to_datasource_id, '/',
      to_table, '.', to_column, '"', chr(10), '    kind: "', kind, '"', chr(10), '    source: "', source, '"', chr(10), '    confidence: ', confidence) AS block
    FROM {stored} WHERE status = 'approved'""",
)
def export_relationships(spark, sf_dir):
    return S.export_relationships(derive(spark, sf_dir, "stored")).select("id", "block")


@query(
    "export_metrics",
    """SELECT id, concat('  - name: "', name, '"', chr(10), '    description: "', description, '"', chr(10), '    datasource: "', datasource_id, '"', chr(10),
      '    template: "{{\\"sql\\": \\"', name, '\\"}}"', chr(10), '    params: "[]"') AS block FROM {metric_rows} WHERE status = 'approved'""",
)
def export_metrics(spark, sf_dir):
    rows = derive(spark, sf_dir, "metric_rows").withColumns(
        {"template": F.concat(F.lit('{"sql": "'), "name", F.lit('"}')), "params_json": F.lit("[]")}
    )
    return S.export_metrics(rows).select("id", "block")


@query("detection_run")
def detection_run(spark, sf_dir):
    """Whole run (no SQL: its parts are checked one by one)."""
    log = derive(spark, sf_dir, "query_log")
    out = detect_run(
        derive(spark, sf_dir, "stored"), columns_meta(spark, sf_dir), log, derive(spark, sf_dir, "metric_rows"), _now(),
    )
    return out.groupBy("source", "status", "change").agg(F.count(F.lit(1)).alias("relationships"))
