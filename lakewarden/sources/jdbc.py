"""Relational sources through Spark's JDBC reader."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.operators.discovery import implicit_targets, schema_rows, size_for_blobs

DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "mariadb": "org.mariadb.jdbc.Driver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "oracle": "oracle.jdbc.OracleDriver",
    "sqlite": "org.sqlite.JDBC",
}
QUERY_TIMEOUT_SECONDS = 30


def dialect_of(url: str) -> str:
    found = re.match(r"jdbc:(\w+):", url)
    if not found or found[1] not in DRIVERS:
        raise ValueError(f"no JDBC dialect for {url!r}")
    return found[1]


def query_options(url: str, sql: str, *, fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options for one read-only statement. SQL Server takes no ORDER
    BY or WITH inside a derived table, so a leading WITH goes to prepareQuery."""
    dialect = dialect_of(url)
    body = sql.strip().rstrip(";").rstrip()
    options = {
        "url": url, "driver": DRIVERS[dialect], "fetchsize": str(fetch_size),
        "queryTimeout": str(QUERY_TIMEOUT_SECONDS), "isolationLevel": "READ_COMMITTED",
    }
    with_part = re.match(r"(?is)(with\b.*\))\s*(select\b.*)\Z", body) if dialect == "sqlserver" else None
    if with_part:
        return options | {"prepareQuery": with_part[1], "query": with_part[2]}
    return options | {"query": body}


def read_query(spark: SparkSession, url: str, sql: str, *, limit: int | None = None, **more: str) -> DataFrame:
    """A query's rows; Spark pushes a following limit and filters to the server."""
    df = spark.read.format("jdbc").options(**query_options(url, sql), **more).load()
    df = size_for_blobs(df) if dialect_of(url) == "sqlite" else df
    return df if limit is None else df.limit(limit)


def table_options(url: str, table: str, split_column: str, lower: object, upper: object, splits: int) -> dict[str, str]:
    """Reader options for a whole table read in parallel by ranges of a column."""
    return {
        "url": url, "driver": DRIVERS[dialect_of(url)], "dbtable": table, "partitionColumn": split_column,
        "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(splits),
        "queryTimeout": str(QUERY_TIMEOUT_SECONDS),
    }


def read_table(spark: SparkSession, url: str, table: str, split_column: str, lower, upper, splits: int) -> DataFrame:
    return spark.read.format("jdbc").options(**table_options(url, table, split_column, lower, upper, splits)).load()


_STANDARD_COLUMNS = (
    "SELECT table_name AS table_name, column_name AS column_name, ordinal_position AS ordinal, data_type AS type_name "
    "FROM information_schema.columns WHERE table_schema = {schema}"
)
_STANDARD_KEYS = (
    "SELECT k.table_name AS table_name, k.column_name AS column_name FROM information_schema.key_column_usage k "
    "JOIN information_schema.table_constraints c ON c.constraint_name = k.constraint_name "
    "AND c.table_schema = k.table_schema AND c.table_name = k.table_name "
    "WHERE c.constraint_type = 'PRIMARY KEY' AND k.table_schema = {schema}"
)
# Dictionary queries per dialect: columns, primary keys, foreign keys. Where the
# standard views hide rows from a SELECT-only login, the native catalog is read.
CATALOG = {
    "postgresql": {
        "columns": _STANDARD_COLUMNS.format(schema="'public'"),
        "primary_keys": (
            "SELECT t.relname AS table_name, a.attname AS column_name FROM pg_index i "
            "JOIN pg_class t ON t.oid = i.indrelid JOIN pg_namespace s ON s.oid = t.relnamespace "
            "JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = ANY(i.indkey) "
            "WHERE i.indisprimary AND s.nspname = 'public'"
        ),
        "foreign_keys": (
            "SELECT ft.relname AS from_table, fa.attname AS from_column, tt.relname AS to_table, "
            "ta.attname AS to_column FROM (SELECT conrelid, confrelid, connamespace, unnest(conkey) AS child, "
            "unnest(confkey) AS parent FROM pg_constraint WHERE contype = 'f') c "
            "JOIN pg_namespace s ON s.oid = c.connamespace AND s.nspname = 'public' "
            "JOIN pg_class ft ON ft.oid = c.conrelid JOIN pg_class tt ON tt.oid = c.confrelid "
            "JOIN pg_attribute fa ON fa.attrelid = c.conrelid AND fa.attnum = c.child "
            "JOIN pg_attribute ta ON ta.attrelid = c.confrelid AND ta.attnum = c.parent"
        ),
    },
    "mysql": {
        "columns": _STANDARD_COLUMNS.format(schema="DATABASE()"),
        "primary_keys": _STANDARD_KEYS.format(schema="DATABASE()"),
        "foreign_keys": (
            "SELECT table_name AS from_table, column_name AS from_column, referenced_table_name AS to_table, "
            "referenced_column_name AS to_column FROM information_schema.key_column_usage "
            "WHERE referenced_table_name IS NOT NULL AND table_schema = DATABASE()"
        ),
    },
    "sqlserver": {
        "columns": _STANDARD_COLUMNS.format(schema="SCHEMA_NAME()"),
        "primary_keys": _STANDARD_KEYS.format(schema="SCHEMA_NAME()"),
        "foreign_keys": (
            "SELECT ct.name AS from_table, cc.name AS from_column, pt.name AS to_table, pc.name AS to_column "
            "FROM sys.foreign_key_columns f JOIN sys.tables ct ON ct.object_id = f.parent_object_id "
            "JOIN sys.columns cc ON cc.object_id = ct.object_id AND cc.column_id = f.parent_column_id "
            "JOIN sys.tables pt ON pt.object_id = f.referenced_object_id "
            "JOIN sys.columns pc ON pc.object_id = pt.object_id AND pc.column_id = f.referenced_column_id "
            "WHERE ct.schema_id = SCHEMA_ID()"
        ),
    },
    "oracle": {
        "columns": (
            "SELECT c.owner AS owner, c.table_name AS table_name, c.column_name AS column_name, "
            "c.column_id AS ordinal, c.data_type AS type_name FROM all_tab_columns c JOIN all_users u "
            "ON u.username = c.owner AND u.oracle_maintained = 'N' WHERE c.table_name NOT LIKE 'BIN$%'"
        ),
        "primary_keys": (
            "SELECT k.owner AS owner, k.table_name AS table_name, k.column_name AS column_name "
            "FROM all_cons_columns k JOIN all_constraints c ON c.owner = k.owner "
            "AND c.constraint_name = k.constraint_name AND c.constraint_type = 'P' "
            "JOIN all_users u ON u.username = k.owner AND u.oracle_maintained = 'N'"
        ),
        "foreign_keys": (
            "SELECT c.owner AS owner, k.table_name AS from_table, k.column_name AS from_column, "
            "p.owner AS to_owner, p.table_name AS to_table, p.column_name AS to_column FROM all_constraints c "
            "JOIN all_cons_columns k ON k.owner = c.owner AND k.constraint_name = c.constraint_name "
            "JOIN all_cons_columns p ON p.owner = c.r_owner AND p.constraint_name = c.r_constraint_name "
            "AND p.position = k.position JOIN all_users u ON u.username = c.owner AND u.oracle_maintained = 'N' "
            "WHERE c.constraint_type = 'R'"
        ),
    },
    "sqlite": {
        "columns": (
            "SELECT t.name AS table_name, c.name AS column_name, c.cid AS ordinal, c.type AS type_name "
            "FROM sqlite_master t JOIN pragma_table_info(t.name) c "
            "WHERE t.type IN ('table', 'view') AND t.name NOT LIKE 'sqlite_%'"
        ),
        "primary_keys": (
            "SELECT t.name AS table_name, c.name AS column_name FROM sqlite_master t "
            "JOIN pragma_table_info(t.name) c WHERE c.pk > 0 AND t.type = 'table' AND t.name NOT LIKE 'sqlite_%'"
        ),
        "foreign_keys": (
            'SELECT t.name AS from_table, f."from" AS from_column, f."table" AS to_table, f."to" AS to_column '
            "FROM sqlite_master t JOIN pragma_foreign_key_list(t.name) f "
            "WHERE t.type = 'table' AND t.name NOT LIKE 'sqlite_%'"
        ),
    },
}
CATALOG["mariadb"] = CATALOG["mysql"]


def catalog_frames(columns: DataFrame, primary_keys: DataFrame, foreign_keys: DataFrame, datasource_id: str) -> tuple[DataFrame, DataFrame]:
    """(columns_meta, foreign keys) from dictionary rows. Rows with an owner
    get owner-qualified table names; null key targets are the parent's key."""
    ds = F.lit(datasource_id).alias("datasource_id")

    def table(df: DataFrame, name: str, owner: str) -> Column:
        has_owner = owner in df.columns
        return (F.concat_ws(".", owner, name) if has_owner else F.col(name))

    cols = columns.select(
        ds, table(columns, "table_name", "owner").alias("table"), F.col("ordinal").cast("int").alias("ordinal"),
        F.col("column_name").alias("column"), F.col("type_name").alias("type"),
    )
    pks = primary_keys.select(
        ds, table(primary_keys, "table_name", "owner").alias("table"), F.col("column_name").alias("column")
    )
    fks = implicit_targets(
        foreign_keys.select(
            ds, table(foreign_keys, "from_table", "owner").alias("from_table"), "from_column",
            table(foreign_keys, "to_table", "to_owner").alias("to_table"), "to_column",
        ),
        pks,
    )
    fk_cols = fks.select("datasource_id", F.col("from_table").alias("table"), F.col("from_column").alias("column"))
    return schema_rows(cols, pks, fk_cols), fks


def read_catalog(spark: SparkSession, url: str, datasource_id: str) -> tuple[DataFrame, DataFrame]:
    queries = CATALOG[dialect_of(url)]
    frames = {name: read_query(spark, url, sql) for name, sql in queries.items()}
    lowered = {n: d.toDF(*[c.lower() for c in d.columns]) for n, d in frames.items()}
    return catalog_frames(lowered["columns"], lowered["primary_keys"], lowered["foreign_keys"], datasource_id)
