"""Schema discovery: inferred types, catalogs, file listings."""

from pyspark.sql import functions as F

from lakewarden.functions.types import FLOAT_PATTERN, INTEGER_PATTERN
from lakewarden.operators import discovery as D
from lakewarden.sources import files as S
from workload.joins import columns_meta
from workload.registry import DERIVED, derive, query

# Cells as text, the way a CSV scan delivers them; `file` groups them.
DERIVED["cells"] = """
SELECT concat('f', l_suppkey, '.csv') AS file, concat(lpad(CAST(l_orderkey AS STRING), 12, '0'), '-', l_linenumber) AS line,
  CAST(l_partkey AS STRING) AS a, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE CAST(l_quantity AS STRING) END AS b,
  CASE WHEN l_partkey % 101 = 0 THEN 'n/a' ELSE concat(' +', l_orderkey) END AS c,
  CASE WHEN l_linenumber = 7 THEN 'nan' ELSE concat(l_partkey, '_', l_linenumber, '0') END AS d, '' AS e FROM {lineitem}"""

_INT = INTEGER_PATTERN.replace("(?U)", "")
_FLOAT = FLOAT_PATTERN.replace("(?U)", "")


def _typed(c: str) -> str:
    return (
        f"CASE WHEN bool_and(regexp_matches({c}, '{_INT}')) FILTER (WHERE {c} <> '') THEN 'integer' "
        f"WHEN bool_and(regexp_matches({c}, '{_FLOAT}')) FILTER (WHERE {c} <> '') THEN 'number' ELSE 'string' END"
    )


def _long(source: str, columns: str, keep: str = "") -> str:
    prefix, by = (f"{keep}, ", f" GROUP BY {keep}") if keep else ("", "")
    return " UNION ALL ".join(
        f"SELECT {prefix}CAST({i} AS INTEGER) AS ordinal, '{c}' AS \"column\", {_typed(c)} AS type FROM {source}{by}"
        for i, c in enumerate(columns)
    )


@query("types_inferred", f"WITH x AS (SELECT * FROM {{cells}}) {_long('x', 'abcde')}")
def types_inferred(spark, sf_dir):
    return D.infer_column_types(derive(spark, sf_dir, "cells"), list("abcde"))


@query(
    "csv_fields_sampled",
    f"""WITH x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, a, c, d) AS n FROM {{cells}}) WHERE n <= 20)
    {_long('x', 'abcde', 'file')}""",
)
def csv_fields_sampled(spark, sf_dir):
    cells = derive(spark, sf_dir, "cells").withColumn("line", F.struct("line", "a", "c", "d"))
    return S.csv_fields(cells, list("abcde"), sample_rows=20)


@query("csv_fields_full", f"WITH x AS (SELECT * FROM {{cells}}) {_long('x', 'abcde', 'file')}")
def csv_fields_full(spark, sf_dir):
    return S.csv_fields(derive(spark, sf_dir, "cells"), list("abcde"), sample_rows=None)


DERIVED["dictionary"] = """
SELECT concat('ds', o_custkey % 20) AS datasource_id, concat('t', o_custkey) AS "table", o_orderkey AS ordinal, concat('c', o_orderkey) AS "column",
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END AS type, o_orderstatus AS mark FROM {orders}"""


def _dictionary(spark, sf_dir):
    text = DERIVED["dictionary"].replace('"table"', "`table`").replace('"column"', "`column`")
    return spark.sql(text, orders=derive(spark, sf_dir, "orders"))


@query(
    "schema_key_flags",
    """SELECT datasource_id, "table", ordinal, "column", CASE WHEN type = '' THEN 'any' ELSE type END AS type, mark = 'F' AS is_pk, mark = 'P' AS is_fk FROM {dictionary}""",
)
def schema_key_flags(spark, sf_dir):
    rows = _dictionary(spark, sf_dir)
    return D.schema_rows(rows.drop("mark"), rows.filter("mark = 'F'"), rows.filter("mark = 'P'"))


@query(
    "schema_grouped",
    """SELECT datasource_id, "table", string_agg("column", ',' ORDER BY ordinal) AS fields FROM {dictionary} GROUP BY 1, 2""",
)
def schema_grouped(spark, sf_dir):
    rows = _dictionary(spark, sf_dir).withColumns({"is_pk": F.lit(False), "is_fk": F.lit(False)})
    out = D.grouped_schema(rows)
    return out.withColumn("fields", F.array_join(F.transform("fields", lambda f: f["name"]), ","))


DERIVED["parent_keys"] = """
SELECT 'erp' AS datasource_id, concat('parent', o_custkey) AS "table", concat('k', o_orderkey) AS "column" FROM {orders} WHERE o_orderpriority = '5-LOW'"""
DERIVED["child_keys"] = """
SELECT 'erp' AS datasource_id, concat('child', o_orderkey) AS from_table, 'ref' AS from_column, concat('parent', o_custkey) AS to_table,
  CASE WHEN o_orderstatus = 'F' THEN 'id' END AS to_column FROM {orders}"""


@query(
    "implicit_key_targets",
    """WITH p AS (SELECT "table" AS t, min("column") AS k FROM {parent_keys} GROUP BY 1 HAVING count(DISTINCT "column") = 1)
    SELECT datasource_id, from_table, from_column, to_table, coalesce(to_column, k) AS to_column FROM {child_keys} LEFT JOIN p ON t = to_table
    WHERE coalesce(to_column, k) IS NOT NULL""",
)
def implicit_key_targets(spark, sf_dir):
    text = DERIVED["parent_keys"].replace('"table"', "`table`").replace('"column"', "`column`")
    keys = spark.sql(text, orders=derive(spark, sf_dir, "orders"))
    return D.implicit_targets(derive(spark, sf_dir, "child_keys"), keys)


@query(
    "schema_owner_names",
    "SELECT o_orderkey, concat(o_orderstatus, '.', o_orderpriority) AS name FROM orders",
)
def schema_owner_names(spark, sf_dir):
    return derive(spark, sf_dir, "orders").select("o_orderkey", D.qualified("o_orderstatus", "o_orderpriority").alias("name"))


@query(
    "source_listing",
    """WITH n AS (SELECT datasource_id AS id, count(DISTINCT "table") AS tables FROM {columns_meta} GROUP BY 1),
    r AS (SELECT DISTINCT concat('src', o_orderkey % 15) AS id FROM orders)
    SELECT r.id, concat('source ', r.id) AS name, tables FROM r LEFT JOIN n ON n.id = r.id WHERE r.id <> 'src3'""",
)
def source_listing(spark, sf_dir):
    registry = derive(spark, sf_dir, "orders").select(F.expr("concat('src', o_orderkey % 15)").alias("id")).distinct()
    registry = registry.withColumn("name", F.concat(F.lit("source "), "id"))
    hide = derive(spark, sf_dir, "region").filter("r_name = 'AFRICA'").selectExpr(
        "r_name AS name", "'deny' AS effect", "concat('src', r_regionkey + 3) AS resource_id", "array('discover') AS actions",
        "array('reader') AS subjects", "CAST(NULL AS array<string>) AS mask_columns",
    )
    return D.source_listing(registry, columns_meta(spark, sf_dir), hide, "reader")


@query("blob_sizes", "SELECT doc_id, concat('<', strlen(text), ' bytes>') AS body FROM documents")
def blob_sizes(spark, sf_dir):
    docs = derive(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    return D.size_for_blobs(docs)


# --- files -----------------------------------------------------------------------

DERIVED["listing"] = """
SELECT concat('lake/', source, '/', lang, '/doc', doc_id, CASE doc_id % 8 WHEN 0 THEN '.CSV' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.pdf' WHEN 3 THEN '.txt'
  WHEN 4 THEN '.Md' WHEN 5 THEN '.json' WHEN 6 THEN '.bin' ELSE '/' END) AS name, CASE WHEN doc_id % 16 = 7 THEN 0 ELSE n_chars * 100 END AS length FROM {documents}"""
_KIND = """CASE WHEN suffix(lower(name), '.csv') THEN 'csv' WHEN suffix(lower(name), '.xlsx') THEN 'xlsx' WHEN suffix(lower(name), '.pdf') THEN 'pdf'
  WHEN regexp_matches(lower(name), '\\.(txt|md|log|json)$') THEN 'text' END"""


@query("file_kinds", f"SELECT name, {_KIND} AS kind FROM {{listing}}")
def file_kinds(spark, sf_dir):
    return derive(spark, sf_dir, "listing").select("name", S.file_kind("name").alias("kind"))


@query(
    "file_tables",
    f"""SELECT name AS "table", {_KIND} AS kind, CASE WHEN {_KIND} IN ('pdf', 'text') THEN 'content text' ELSE '' END AS fields
    FROM {{listing}} WHERE {_KIND} IS NOT NULL""",
)
def file_tables(spark, sf_dir):
    listing = derive(spark, sf_dir, "listing")
    out = S.document_tables(listing.withColumn("kind", S.file_kind("name")))
    shown = F.array_join(F.transform("fields", lambda f: F.concat_ws(" ", f["name"], f["type"])), ",")
    return out.withColumn("fields", shown)


@query(
    "object_prefix_listing",
    "SELECT substr(name, 6) AS name, name AS key, length FROM {listing} WHERE starts_with(name, 'lake/') AND NOT (suffix(name, '/') AND length = 0)",
)
def object_prefix_listing(spark, sf_dir):
    return S.under_prefix(S.drop_markers(derive(spark, sf_dir, "listing")), "lake/").select("name", "key", "length")


@query(
    "object_size_refusals",
    "SELECT name, length, concat('object exceeds the 1 MiB read in one query: ', name) AS reason FROM {listing} WHERE length > 1048576",
)
def object_size_refusals(spark, sf_dir):
    return S.size_gate(derive(spark, sf_dir, "listing"), 1024 * 1024)[1]


DERIVED["asked_paths"] = """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat('a/../b', o_custkey) WHEN 1 THEN concat('../data/c', o_custkey) WHEN 2 THEN concat('x/../../etc/', o_custkey)
  WHEN 3 THEN '/srv/data/./y' WHEN 4 THEN '/srv/database' ELSE concat('p', o_custkey, '//q') END AS path FROM {orders}"""


@query("path_scope_guard", "SELECT o_orderkey, o_orderkey % 6 NOT IN (2, 4) AS inside, o_orderkey % 6 < 3 AS steps_up FROM {asked_paths}")
def path_scope_guard(spark, sf_dir):
    return derive(spark, sf_dir, "asked_paths").select(
        "o_orderkey", S.inside_root("path", "/srv/data").alias("inside"), S.has_parent_step("path").alias("steps_up")
    )


@query("document_content", "SELECT doc_id, text AS content, CAST(length(text) AS INTEGER) AS chars FROM documents")
def document_content(spark, sf_dir):
    content = S.capped_text("text", None)
    return derive(spark, sf_dir, "documents").select("doc_id", content.alias("content"), F.length(content).alias("chars"))
