"""Join discovery over catalogs derived from orders and customers."""

from pyspark.sql import functions as F

from lakewarden.functions.text import alnum_key, table_stem
from lakewarden.functions.types import type_family
from lakewarden.operators import joins as J
from workload.registry import DERIVED, derive, query

DERIVED["columns_meta"] = """
SELECT concat('src', o_orderkey % 11) AS datasource_id, 'shop' AS datasource_name, concat('Order_', o_orderkey, 's') AS "table",
  1 AS ordinal, 'id' AS "column", 'integer' AS type FROM {orders}
UNION ALL SELECT concat('src', o_orderkey % 11), 'shop', concat('Order_', o_orderkey, 's'), 2,
  concat('customer_', o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN '_id' ELSE 'Id' END),
  CASE WHEN o_orderkey % 3 = 0 THEN 'text' WHEN o_orderkey % 7 = 0 THEN 'date' ELSE 'bigint' END FROM {orders}
UNION ALL SELECT concat('crm', c_custkey % 3), 'crm', concat('lake/customer_', c_custkey, 's.csv'), 1, 'Id', 'integer' FROM {customer}
UNION ALL SELECT concat('crm', c_custkey % 3), 'crm', concat('lake/customer_', c_custkey, 's.csv'), 2, 'name', 'string' FROM {customer}
UNION ALL SELECT concat('crm', c_custkey % 3), 'crm', concat('lake/customer_', c_custkey, 's.csv'), 3, 'created_id', 'timestamp' FROM {customer}"""


def columns_meta(spark, sf_dir):
    text = DERIVED["columns_meta"].replace('"table"', "`table`").replace('"column"', "`column`")
    return spark.sql(text, orders=derive(spark, sf_dir, "orders"), customer=derive(spark, sf_dir, "customer"))


_NORMS = """keys AS (SELECT datasource_id, "table", "column", ordinal,
    regexp_replace(lower("column"), '[^a-z0-9]', '', 'g') AS norm,
    regexp_replace(regexp_replace(lower(regexp_extract("table", '([^/.]*)[^/]*$', 1)), '[^a-z0-9]', '', 'g'), 's$', '') AS stem,
    CASE WHEN type IN ('integer', 'bigint') THEN 'numeric' WHEN type IN ('date', 'timestamp') THEN 'temporal' ELSE 'text' END AS family
  FROM {columns_meta})"""


@query(
    "join_names",
    f"""WITH {_NORMS} SELECT datasource_id, "table", "column", norm, stem, family,
    regexp_matches(norm, '(id|key|code|uuid)$') AS key_like FROM keys""",
)
def join_names(spark, sf_dir):
    return columns_meta(spark, sf_dir).select(
        "datasource_id", "table", "column", alnum_key("column").alias("norm"), table_stem("table").alias("stem"),
        type_family("type").alias("family"), J.is_key_like("column").alias("key_like"),
    )


@query(
    "join_candidates",
    f"""WITH {_NORMS}, k AS (SELECT * FROM keys WHERE family <> 'temporal' AND regexp_matches(norm, '(id|key|code|uuid)$')),
    n AS (SELECT DISTINCT datasource_id, "table", "column", ordinal, unnest([stem || 'id', stem || norm]) AS called FROM k),
    pairs AS (SELECT a.datasource_id, a."table", a."column", b.datasource_id AS ds2, b."table" AS t2, b."column" AS c2, 0 AS rule FROM k a JOIN k b ON a.norm = b.norm
        WHERE a.norm NOT IN ('id', 'key', 'code', 'uuid') AND (a.datasource_id, a."table", a.ordinal) < (b.datasource_id, b."table", b.ordinal)
      UNION ALL SELECT a.datasource_id, a."table", a."column", b.datasource_id, b."table", b."column", 1 FROM k a JOIN n b ON a.norm = b.called
        WHERE (a.datasource_id, a."table", a.ordinal) < (b.datasource_id, b."table", b.ordinal)
      UNION ALL SELECT a.datasource_id, a."table", a."column", b.datasource_id, b."table", b."column", 2 FROM n a JOIN k b ON b.norm = a.called
        WHERE (a.datasource_id, a."table", a.ordinal) < (b.datasource_id, b."table", b.ordinal)),
    best AS (SELECT datasource_id, "table", "column", ds2, t2, c2, min(rule) AS rule FROM pairs
      WHERE datasource_id <> ds2 OR "table" <> t2 GROUP BY ALL)
    SELECT datasource_id AS from_datasource_id, "table" AS from_table, "column" AS from_column, ds2 AS to_datasource_id,
      t2 AS to_table, c2 AS to_column, 'candidate_join' AS kind, 'heuristic' AS source,
      CAST(CASE WHEN rule = 0 THEN 0.9 ELSE 0.8 END AS DOUBLE) AS confidence,
      CASE rule WHEN 0 THEN concat('column names match after normalization (''', "column", ''' ~ ''', c2, ''')')
        WHEN 1 THEN concat("table", '.', "column", ' names the ', t2, ' table''s key (', c2, ')')
        ELSE concat(t2, '.', c2, ' names the ', "table", ' table''s key (', "column", ')') END AS rationale FROM best""",
)
def join_candidates(spark, sf_dir):
    return J.detect_candidates(columns_meta(spark, sf_dir))


# Every event becomes one logged query that joins two of the derived tables.
DERIVED["query_log"] = """
SELECT event_id AS id, CASE WHEN event_type = 'signup' THEN 'discover' ELSE 'query' END AS action, event_type <> 'error' AS success,
  CASE WHEN user_id % 13 = 0 THEN NULL ELSE concat('user-', user_id) END AS api_key_id,
  concat('crm', user_id % 3) AS datasource_id,
  CASE event_id % 6
    WHEN 0 THEN concat('SELECT * FROM customer_', user_id, ' a JOIN db.customer_', user_id + 3, 's AS b ON a.id = b.NAME WHERE a.id > 5')
    WHEN 1 THEN concat('select 1 from customer_', user_id + 3, 's join customer_', user_id, 's on customer_', user_id + 3, 's.name = customer_', user_id, 's.Id')
    WHEN 2 THEN concat('SELECT * FROM t', user_id, ' a JOIN t', user_id, ' b ON a.x = b.x')
    WHEN 3 THEN concat('WITH z AS (SELECT 1) SELECT * FROM z JOIN customer_', user_id, ' c ON z.id = c.id')
    WHEN 4 THEN concat('SELECT * FROM customer_', user_id, ' a LEFT JOIN customer_', user_id + 3, ' b ON a.id = b.missing')
    ELSE 'SELECT 1' END AS sql
FROM {events}"""


@query(
    "join_mining",
    """WITH ran AS (SELECT *, coalesce(api_key_id, 'unknown') AS caller, CAST(substr(datasource_id, 4) AS INTEGER) AS d,
        CAST(regexp_extract(sql, 'customer_([0-9]+)', 1) AS BIGINT) AS n1 FROM {query_log}
        WHERE action = 'query' AND success AND id % 6 IN (0, 1)),
      ends AS (SELECT datasource_id, caller, CASE WHEN id % 6 = 0 THEN n1 ELSE n1 - 3 END AS u FROM ran),
      named AS (SELECT e.datasource_id, e.caller, concat('lake/customer_', u, 's.csv') AS ta, concat('lake/customer_', u + 3, 's.csv') AS tb
        FROM ends e JOIN customer x ON x.c_custkey = u JOIN customer y ON y.c_custkey = u + 3
        WHERE concat('crm', u % 3) = e.datasource_id),
      edges AS (SELECT datasource_id, caller, CASE WHEN ta < tb THEN ta ELSE tb END AS t1, CASE WHEN ta < tb THEN 'Id' ELSE 'name' END AS c1,
        CASE WHEN ta < tb THEN tb ELSE ta END AS t2, CASE WHEN ta < tb THEN 'name' ELSE 'Id' END AS c2 FROM named)
      SELECT datasource_id AS from_datasource_id, t1 AS from_table, c1 AS from_column, datasource_id AS to_datasource_id,
        t2 AS to_table, c2 AS to_column, 'candidate_join' AS kind, 'behavioral' AS source, CAST(0.7 AS DOUBLE) AS confidence,
        concat('JOIN..ON observed in ', count(*), ' audited quer', CASE WHEN count(*) = 1 THEN 'y' ELSE 'ies' END, ' by ',
          count(DISTINCT caller), ' distinct caller', CASE WHEN count(DISTINCT caller) = 1 THEN '' ELSE 's' END) AS rationale,
        count(*) AS runs, count(DISTINCT caller) AS callers
      FROM edges GROUP BY ALL""",
)
def join_mining(spark, sf_dir):
    return J.mine_query_log(derive(spark, sf_dir, "query_log"), columns_meta(spark, sf_dir))


@query(
    "joins_in_query_texts",
    """SELECT id, concat('customer_', regexp_extract(sql, 'customer_([0-9]+)', 1), CASE WHEN id % 6 = 1 THEN 's' ELSE '' END) AS left_table,
      CASE id % 6 WHEN 0 THEN 'id' WHEN 1 THEN 'name' ELSE 'id' END AS left_column,
      concat('customer_', regexp_extract(sql, 'customer_[0-9]+.*?customer_([0-9]+)', 1), CASE WHEN id % 6 < 2 THEN 's' ELSE '' END) AS right_table,
      CASE id % 6 WHEN 0 THEN 'NAME' WHEN 1 THEN 'Id' ELSE 'missing' END AS right_column
      FROM {query_log} WHERE id % 6 IN (0, 1, 4)
      UNION ALL SELECT id, 'z', 'id', concat('customer_', regexp_extract(sql, 'customer_([0-9]+)', 1)), 'id' FROM {query_log} WHERE id % 6 = 3""",
)
def joins_in_query_texts(spark, sf_dir):
    return derive(spark, sf_dir, "query_log").select("id", F.inline(J.joins_in_sql("sql")))


DERIVED["proposals"] = """
SELECT concat('src', o_orderkey % 13) AS from_datasource_id, concat('Order_', o_orderkey, 's') AS from_table, 'id' AS from_column,
  concat('crm', o_custkey % 3) AS to_datasource_id, concat('lake/customer_', o_custkey, 's.csv') AS to_table,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Id' ELSE 'ghost' END AS to_column,
  concat('seen by ann@example.com on ', o_orderkey) AS rationale, o_orderkey AS ord FROM {orders}"""


@query(
    "join_proposals",
    """WITH live AS (SELECT DISTINCT datasource_id AS d, "table" AS t, "column" AS c FROM {columns_meta})
    SELECT p.from_datasource_id, from_table, from_column, to_datasource_id, to_table, to_column, 'candidate_join' AS kind,
      'proposed' AS source, CAST(0.5 AS DOUBLE) AS confidence, concat('seen by [REDACTED:email] on ', ord,
        CASE WHEN a.d IS NULL THEN concat(' [note: ', from_table, '.', from_column, ' not found in the discovered schema]') ELSE '' END,
        CASE WHEN b.d IS NULL THEN concat(' [note: ', to_table, '.', to_column, ' not found in the discovered schema]') ELSE '' END) AS rationale, ord
    FROM {proposals} p LEFT JOIN live a ON (a.d, a.t, a.c) = (from_datasource_id, from_table, from_column)
      LEFT JOIN live b ON (b.d, b.t, b.c) = (to_datasource_id, to_table, to_column)
    WHERE from_datasource_id IN (SELECT d FROM live) AND from_datasource_id <> 'src4'""",
)
def join_proposals(spark, sf_dir):
    return _propose(spark, sf_dir)[0]


@query(
    "join_proposals_refused",
    """SELECT ord, concat('datasource not found: ', from_datasource_id) AS reason FROM {proposals}
    WHERE from_datasource_id = 'src4' OR from_datasource_id NOT IN (SELECT datasource_id FROM {columns_meta})""",
)
def join_proposals_refused(spark, sf_dir):
    return _propose(spark, sf_dir)[1].select("ord", "reason")


def _propose(spark, sf_dir):
    meta = columns_meta(spark, sf_dir)
    registry = meta.select(F.col("datasource_id").alias("id")).distinct()
    hidden = derive(spark, sf_dir, "region").filter("r_name = 'AFRICA'").selectExpr(
        "r_name AS name", "'deny' AS effect", "concat('src', r_regionkey + 4) AS resource_id", "array('discover') AS actions",
        "array('*') AS subjects", "CAST(NULL AS array<string>) AS mask_columns",
    )
    return J.propose_relationships(derive(spark, sf_dir, "proposals"), meta, registry, hidden, "agent")
