"""Landed REST payloads and API descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.sources.files import capped_text

_SPEC = (
    "paths map<string,struct<get:struct<parameters:"
    "array<struct<name:string,schema:struct<type:string>>>>>>"
)


def payload_rows(payloads: DataFrame, column: str = "payload", *, max_chars: int | None = None) -> DataFrame:
    """One row per item of every response body: `item` variant, `position`.

    A list gives one row per element (scalars wrapped as {"value": ...}), an
    object one row, a body that is not JSON one {"content": text} row.
    """
    body = F.try_parse_json(column)
    parsed = payloads.withColumn("__body", body).withColumn("__kind", F.schema_of_variant("__body"))
    keep = payloads.columns
    is_list = F.col("__kind").startswith("ARRAY<")
    items = parsed.filter(is_list).select(
        *keep, F.posexplode(F.variant_get("__body", "$", "array<variant>")).alias("position", "__item")
    )
    wrapped = F.to_variant_object(F.struct(F.col("__item").alias("value")))
    is_object = F.schema_of_variant("__item").startswith("OBJECT<")
    listed = items.select(*keep, "position", F.when(is_object, F.col("__item")).otherwise(wrapped).alias("item"))
    single = parsed.filter(F.col("__body").isNotNull() & ~is_list).select(
        *keep, F.lit(0).alias("position"), F.col("__body").alias("item")
    )
    text = F.to_variant_object(F.struct(capped_text(column, max_chars).alias("content")))
    plain = parsed.filter(F.col("__body").isNull() & F.col(column).isNotNull()).select(
        *keep, F.lit(0).alias("position"), text.alias("item")
    )
    return listed.unionByName(single).unionByName(plain)


def openapi_fields(specs: DataFrame, column: str = "spec") -> DataFrame:
    """(table, ordinal, column, type): one table per GET path, one field per
    parameter, type string by default; a path without parameters has one row
    with a null column."""
    parsed = specs.withColumn("__paths", F.from_json(column, _SPEC)["paths"])
    keep = [c for c in specs.columns if c != column]
    paths = parsed.select(*keep, F.explode("__paths").alias("table", "__ops")).filter(F.col("__ops.get").isNotNull())
    fields = paths.select(*keep, "table", F.posexplode_outer("__ops.get.parameters").alias("ordinal", "__p"))
    return fields.select(
        *keep, "table", "ordinal",
        F.when(F.col("ordinal").isNotNull(), F.coalesce("__p.name", F.lit(""))).alias("column"),
        F.when(F.col("ordinal").isNotNull(), F.coalesce("__p.schema.type", F.lit("string"))).alias("type"),
    )
