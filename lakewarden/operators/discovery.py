"""Schema discovery: inferred types, catalog rows, implicit keys, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.types import inferred_type
from lakewarden.operators.policy import visible


def infer_column_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ordinal, column, type) over all rows of string columns, in one aggregate."""
    names = columns or df.columns
    row = df.agg(*[inferred_type(F.col(f"`{c}`")).alias(f"t{i}") for i, c in enumerate(names)])
    cells = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"t{i}").alias("type"))
        for i, c in enumerate(names)
    ]
    return row.select(F.inline(F.array(*cells)))


def schema_rows(columns: DataFrame, primary_keys: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Catalog columns with is_pk and is_fk. Keys are (datasource_id, table,
    column); a missing type reads as 'any'."""
    key = ["datasource_id", "table", "column"]
    pks = primary_keys.select(*key, F.lit(True).alias("__pk")).distinct()
    fks = foreign_keys.select(*key, F.lit(True).alias("__fk")).distinct()
    return (
        columns.join(pks, key, "left")
        .join(fks, key, "left")
        .withColumn("type", F.when(F.coalesce("type", F.lit("")) == "", "any").otherwise(F.col("type")))
        .withColumn("is_pk", F.coalesce("__pk", F.lit(False)))
        .withColumn("is_fk", F.coalesce("__fk", F.lit(False)))
        .drop("__pk", "__fk")
    )


def grouped_schema(columns_meta: DataFrame) -> DataFrame:
    """One row per table with its fields in order: a table's width bounds the list."""
    field = F.struct("ordinal", F.col("column").alias("name"), "type", "is_pk", "is_fk")
    return columns_meta.groupBy("datasource_id", "table").agg(F.array_sort(F.collect_list(field)).alias("fields"))


def implicit_targets(foreign_keys: DataFrame, primary_keys: DataFrame) -> DataFrame:
    """Fill a null to_column with the parent's only key column; a parent with
    a composite or no key drops the row."""
    single = (
        primary_keys.select("datasource_id", F.col("table").alias("to_table"), "column").distinct()
        .groupBy("datasource_id", "to_table")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("column").alias("__pk"))
        .filter("__n = 1")
    )
    return (
        foreign_keys.join(single, ["datasource_id", "to_table"], "left")
        .withColumn("to_column", F.coalesce("to_column", "__pk"))
        .filter(F.col("to_column").isNotNull())
        .select(*foreign_keys.columns)
    )


def qualified(owner: Column | str, table: Column | str) -> Column:
    return F.concat_ws(".", owner, table)


def size_for_blobs(df: DataFrame) -> DataFrame:
    """Binary columns shown by size, the way a governed answer reports them."""
    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            shown = F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes>"))
            return shown.alias(f.name)
        return c

    return df.select(*[cell(f) for f in df.schema.fields])


def source_listing(
    registry: DataFrame, columns_meta: DataFrame, policies: DataFrame, subject: str, *,
    is_admin: bool = False, default_deny: bool = False,
) -> DataFrame:
    """Sources the subject may discover with their table counts (null while
    undiscovered). Connection settings are left out."""
    tables = columns_meta.groupBy("datasource_id", "table").agg(F.lit(1).alias("one"))
    counts = tables.groupBy(F.col("datasource_id").alias("id")).agg(F.count("one").alias("tables"))
    shown = [c for c in ("id", "name", "type", "status", "description") if c in registry.columns]
    seen = visible(registry.select(*shown), "id", policies, subject, is_admin=is_admin, default_deny=default_deny)
    return seen.join(counts, "id", "left")
