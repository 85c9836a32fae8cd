"""Landed service payloads, listings, query texts and result pages."""

from pyspark.sql import functions as F

from lakewarden.session import use_all_cores
from lakewarden.sources import drive, records, rest, sqltext, tickets, wiki
from lakewarden.sources.jdbc import catalog_frames
from workload.registry import DERIVED, derive, query

_SITE = "https://acme.example"


@query(
    "drive_names",
    """SELECT o_orderkey, concat('File ', o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '.TXT' ELSE '' END, CASE o_orderkey % 3
      WHEN 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '.txt' END WHEN 1 THEN '.csv' ELSE '' END) AS name,
      CASE o_orderkey % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/csv' END AS export_as FROM orders""",
)
def drive_names(spark, sf_dir):
    mime = F.expr(
        "CASE o_orderkey % 3 WHEN 0 THEN 'application/vnd.google-apps.document' WHEN 1 THEN 'application/vnd.google-apps.spreadsheet' ELSE 'image/png' END"
    )
    name = F.expr("concat('File ', o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '.TXT' ELSE '' END)")
    return derive(spark, sf_dir, "orders").select(
        "o_orderkey", drive.effective_name(name, mime).alias("name"), drive.export_mime(mime).alias("export_as")
    )


DERIVED["drive_listing"] = f"""
SELECT concat('r', r_regionkey) AS id, 'root' AS parent_id, r_name AS name, '{drive.FOLDER_MIME}' AS mime FROM {{region}}
UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name, '{drive.FOLDER_MIME}' FROM {{nation}}
UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), s_name, '{drive.FOLDER_MIME}' FROM {{supplier}}
UNION ALL SELECT concat('p', p_partkey), concat('s', p_partkey % 50), p_name, 'text/plain' FROM {{part}}
UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), c_name, 'application/vnd.google-apps.spreadsheet' FROM {{customer}}
UNION ALL SELECT concat('lost', s_suppkey), 'nowhere', s_name, 'text/plain' FROM {{supplier}}"""


@query(
    "drive_tree",
    """WITH f AS (SELECT n_nationkey, concat(r_name, '/', n_name, '/') AS p FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT concat(p, c_name, '.csv') AS path, concat('c', c_custkey) AS id FROM customer JOIN f ON c_nationkey = n_nationkey
    UNION ALL SELECT concat(p, s_name, '/', p_name), concat('p', p_partkey) FROM part JOIN supplier ON s_suppkey = p_partkey % 50 JOIN f ON s_nationkey = n_nationkey""",
)
def drive_tree(spark, sf_dir):
    return drive.walk_folders(derive(spark, sf_dir, "drive_listing"), "root").select("path", "id")


@query(
    "issue_rows",
    """SELECT CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE concat('ENG-', o_orderkey) END AS key, concat('Order ', o_orderkey) AS summary,
      o_orderstatus AS status, '' AS issue_type, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS priority,
      '' AS assignee, concat('user ', o_custkey) AS reporter, CAST(o_orderdate AS VARCHAR)[1:10] AS created_at, '' AS updated_at,
      CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE concat('https://acme.example/browse/ENG-', o_orderkey) END AS url FROM orders""",
)
def issue_rows(spark, sf_dir):
    payload = F.to_json(
        F.struct(
            F.expr("if(o_orderkey % 50 = 0, NULL, concat('ENG-', o_orderkey))").alias("key"),
            F.struct(
                F.expr("concat('Order ', o_orderkey)").alias("summary"), F.struct(F.col("o_orderstatus").alias("name")).alias("status"),
                F.expr("if(o_orderkey % 3 = 0, NULL, struct(o_orderpriority AS name))").alias("priority"),
                F.lit(None).cast("struct<displayName:string>").alias("assignee"),
                F.struct(F.expr("concat('user ', o_custkey)").alias("displayName")).alias("reporter"),
                F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"),
            ).alias("fields"),
        ),
        {"ignoreNullFields": "false"},
    )
    return tickets.issue_rows(derive(spark, sf_dir, "orders").select(payload.alias("payload")), _SITE)


@query(
    "issue_rich_text",
    """SELECT doc_id, concat(array_to_string([l FOR l IN string_split(text, chr(10)) IF l <> ''], chr(10)), chr(10), 'see ', source) AS content FROM documents""",
)
def issue_rich_text(spark, sf_dir):
    node = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), line.alias("text"))).alias("content")
        ),
    )
    closing = F.struct(
        F.lit("paragraph").alias("type"),
        F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("see "), "source").alias("text"))).alias("content"),
    )
    tree = F.to_json(F.struct(F.lit("doc").alias("type"), F.concat(node, F.array(closing)).alias("content")))
    docs = use_all_cores(derive(spark, sf_dir, "documents"))
    return docs.select("doc_id", tickets.rich_text(tree, max_chars=None).alias("content"))


@query(
    "wiki_rows",
    """SELECT CAST(page_id AS VARCHAR) AS id, concat('Page ', page_id) AS title, 'current' AS status, concat('', page_id % 7) AS space_id,
      CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('', page_id - 1) END AS parent_id, '' AS author_id, '2024-01-01' AS created_at,
      CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('https://acme.example/wiki/x/', page_id) END AS url FROM pages""",
)
def wiki_rows(spark, sf_dir):
    payload = F.to_json(
        F.struct(
            F.col("page_id").alias("id"), F.expr("concat('Page ', page_id)").alias("title"), F.lit("current").alias("status"),
            F.expr("page_id % 7").alias("spaceId"), F.expr("if(page_id % 3 = 0, NULL, page_id - 1)").alias("parentId"),
            F.lit("2024-01-01").alias("createdAt"), F.struct(F.expr("if(page_id % 5 = 0, NULL, concat('/x/', page_id))").alias("webui")).alias("_links"),
        ),
        {"ignoreNullFields": "false"},
    )
    return wiki.page_rows(derive(spark, sf_dir, "pages").select(payload.alias("payload")), _SITE)


@query("page_text")
def page_text(spark, sf_dir):
    """Visible text of whole pages (no SQL equivalent; tests recompute it)."""
    pages = use_all_cores(derive(spark, sf_dir, "pages"))
    return pages.select("page_id", wiki.markup_text("html", max_chars=None).alias("content"))


DERIVED["cmdb"] = """
SELECT o_orderkey, concat('CHG', o_orderkey) AS number, concat('u', o_custkey) AS opened_by, o_orderkey % 4 = 0 AS unassigned FROM {orders}"""


@query(
    "service_records",
    "SELECT o_orderkey, number, CASE WHEN unassigned THEN '' ELSE opened_by END AS opened_by FROM {cmdb}",
)
def service_records(spark, sf_dir):
    rows = derive(spark, sf_dir, "cmdb").select(
        "o_orderkey", "number",
        F.struct(F.lit("https://x").alias("link"), F.expr("if(unassigned, NULL, opened_by)").alias("value")).alias("opened_by"),
    )
    return records.flatten_records(rows)


@query(
    "service_json_records",
    "SELECT o_orderkey, number, CASE WHEN unassigned THEN '' ELSE opened_by END AS opened_by FROM {cmdb}",
)
def service_json_records(spark, sf_dir):
    payload = F.expr(
        """concat('{"number":"', number, '","opened_by":', if(unassigned, '{}', concat('{"link":"https://x","value":"', opened_by, '"}')), '}')"""
    )
    rows = derive(spark, sf_dir, "cmdb").select("o_orderkey", payload.alias("payload"))
    return records.flatten_json_records(rows).select(
        "o_orderkey", F.col("record.number").alias("number"), F.col("record.opened_by").alias("opened_by")
    )


@query(
    "service_dictionary",
    """SELECT p_brand AS "table", p_name AS "column", CASE WHEN p_size % 3 = 0 THEN 'string' ELSE p_type END AS type FROM part WHERE p_size % 5 <> 0""",
)
def service_dictionary(spark, sf_dir):
    rows = derive(spark, sf_dir, "part").selectExpr(
        "p_brand AS name", "if(p_size % 5 = 0, '', p_name) AS element", "if(p_size % 3 = 0, NULL, p_type) AS internal_type"
    )
    return records.dictionary_fields(rows)


DERIVED["asked_tables"] = """
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN concat('table_', l_suppkey) WHEN 2 THEN concat('Table', l_suppkey) WHEN 3 THEN 'x;drop' ELSE concat('t', l_partkey) END AS asked FROM {lineitem}"""
DERIVED["allowed_tables"] = "SELECT concat(' table_', s_suppkey, ' ') AS name FROM {supplier} UNION ALL SELECT concat('t', p_partkey) FROM {part} WHERE p_size < 25"


@query(
    "service_scope",
    """SELECT reason, count(*) AS asked FROM (SELECT CASE WHEN NOT regexp_matches(asked, '^[a-z][a-z0-9_]{{0,79}}$') THEN concat('invalid name: ', asked)
      WHEN asked NOT IN (SELECT trim(name) FROM {allowed_tables}) THEN concat('not in the allowlist: ', asked) ELSE 'in scope' END AS reason FROM {asked_tables}) GROUP BY reason""",
)
def service_scope(spark, sf_dir):
    fine, refused = records.scoped(derive(spark, sf_dir, "asked_tables"), derive(spark, sf_dir, "allowed_tables"), "asked")
    both = fine.select(F.lit("in scope").alias("reason")).unionByName(refused.select("reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("asked"))


@query(
    "issue_scope",
    """SELECT o_orderkey, o_orderkey % 3 = 0 AS inside FROM orders""",
)
def issue_scope(spark, sf_dir):
    key = F.expr("concat(CASE o_orderkey % 3 WHEN 0 THEN 'eng-' WHEN 1 THEN 'OPS-' ELSE 'ENG' END, o_orderkey)")
    return derive(spark, sf_dir, "orders").select("o_orderkey", records.issue_in_project(key, "ENG").alias("inside"))


# Three result pages per customer; a record can be on two pages, later pages are stale.
DERIVED["page_items"] = """
SELECT o_custkey AS source, o_orderkey % 4 AS page_no, CASE WHEN o_orderkey % 4 < 2 THEN 'more' ELSE '' END AS next_token, o_orderkey,
  concat('{{"id":"', CAST(floor(o_orderkey / 2) AS BIGINT), '","v":', o_orderkey, '}}') AS record FROM {orders}"""


@query(
    "page_assembly",
    """WITH l AS (SELECT source, min(page_no) AS last FROM {page_items} WHERE next_token = '' GROUP BY source),
    i AS (SELECT p.*, row_number() OVER (PARTITION BY p.source, page_no ORDER BY o_orderkey) - 1 AS position FROM {page_items} p),
    k AS (SELECT i.* FROM i LEFT JOIN l ON l.source = i.source WHERE last IS NULL OR page_no <= last)
    SELECT CAST(source AS BIGINT) AS source, json_extract_string(record, '$.id') AS id, arg_min(record, (page_no, position)) AS record FROM k GROUP BY 1, 2""",
)
def page_assembly(spark, sf_dir):
    items = derive(spark, sf_dir, "page_items")
    pages = items.groupBy("source", "page_no", "next_token").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "record"))), lambda r: r["record"]).alias("records")
    )
    return records.assemble_pages(pages, "$.id").select("source", "id", "record")


@query(
    "rest_payloads",
    """SELECT event_id, 0 AS position, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL AS content FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT event_id, 0, CAST(json_extract(props, '$.k') AS BIGINT), NULL FROM events WHERE event_id % 3 = 1
    UNION ALL SELECT event_id, 1, user_id, NULL FROM events WHERE event_id % 3 = 1
    UNION ALL SELECT event_id, 0, NULL, concat('busy ', user_id) FROM events WHERE event_id % 3 = 2""",
)
def rest_payloads(spark, sf_dir):
    body = F.expr(
        "CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat('[', props, ',', user_id, ']') ELSE concat('busy ', user_id) END"
    )
    rows = rest.payload_rows(derive(spark, sf_dir, "events").select("event_id", body.alias("payload")), max_chars=None)
    k = F.coalesce(F.try_variant_get("item", "$.k", "bigint"), F.try_variant_get("item", "$.value", "bigint"))
    return rows.select("event_id", "position", k.alias("k"), F.try_variant_get("item", "$.content", "string").alias("content"))


@query(
    "openapi_fields",
    """SELECT p_partkey, concat('/', p_name) AS "table", CAST(0 AS INTEGER) AS ordinal, 'q' AS "column", 'string' AS type FROM part
    UNION ALL SELECT p_partkey, concat('/', p_name), 1, 'size', 'integer' FROM part
    UNION ALL SELECT p_partkey, '/plain', NULL, NULL, NULL FROM part""",
)
def openapi_fields(spark, sf_dir):
    spec = F.expr(
        """concat('{"paths":{"/', p_name, '":{"get":{"parameters":[{"name":"q"},{"name":"size","schema":{"type":"integer"}}]}},"/plain":{"get":{}},"/write":{"post":{}}}}')"""
    )
    return rest.openapi_fields(derive(spark, sf_dir, "part").select("p_partkey", spec.alias("spec")))


DERIVED["statements"] = """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN concat('/* a; */ -- b', chr(10), ' (SELECT ', user_id, ')') WHEN 1 THEN concat('drop table t', user_id) WHEN 2 THEN 'select 1; drop table x'
  WHEN 3 THEN concat('WITH a AS (SELECT '';'') SELECT 1;', chr(10)) WHEN 4 THEN 'select "a;b", [c;d] /* x /* ; */ ; */ from t' WHEN 5 THEN 'selectx'
  WHEN 6 THEN concat('/*! select */ select ', user_id) ELSE concat('select 1 -- ; ', user_id) END AS sql FROM {events}"""


@query(
    "statement_gate",
    """SELECT event_id, event_id % 8 IN (0, 2, 3, 4, 7) AS is_select, event_id % 8 <> 2 AS single_statement,
      CASE WHEN event_id % 8 IN (1, 5, 6) THEN 'only SELECT queries are supported' WHEN event_id % 8 = 2 THEN 'only a single statement is allowed' END AS reason FROM {statements}""",
)
def statement_gate(spark, sf_dir):
    return sqltext.gate_statements(derive(spark, sf_dir, "statements")).select("event_id", "is_select", "single_statement", "reason")


@query(
    "catalog_frames",
    """SELECT 'erp' AS datasource_id, concat('APP.', 'T', o_custkey) AS "table", CAST(o_orderkey AS INTEGER) AS ordinal, concat('C', o_orderkey) AS "column",
      o_orderpriority AS type, o_orderstatus = 'F' AS is_pk, o_orderstatus = 'P' AS is_fk FROM orders""",
)
def catalog_frames_query(spark, sf_dir):
    base = derive(spark, sf_dir, "orders").selectExpr(
        "'APP' AS owner", "concat('T', o_custkey) AS table_name", "o_orderkey AS ordinal", "concat('C', o_orderkey) AS column_name",
        "o_orderpriority AS type_name", "o_orderstatus",
    )
    keys = base.filter("o_orderstatus = 'F'")
    fks = base.filter("o_orderstatus = 'P'").selectExpr(
        "owner", "table_name AS from_table", "column_name AS from_column", "owner AS to_owner", "'PARENT' AS to_table", "'ID' AS to_column"
    )
    return catalog_frames(base, keys, fks, "erp")[0]
