"""Landed service records, scopes and result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.text import col, strip

# Key shapes.
TABLE_NAME = r"\A[a-z][a-z0-9_]{0,79}\n?\z"
PROJECT_KEY = r"\A[A-Za-z][A-Za-z0-9_]{0,254}\n?\z"
ISSUE_KEY = r"\A[A-Za-z][A-Za-z0-9_]{0,254}-[0-9]{1,19}\n?\z"


def flatten_records(records: DataFrame) -> DataFrame:
    """Reference columns ({link, value} structs) reduced to their value; an
    object without one reads as ''."""
    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.StructType):
            return c
        value = c["value"] if "value" in f.dataType.names else F.lit("")
        return F.when(c.isNotNull(), F.coalesce(value.cast("string"), F.lit(""))).alias(f.name)

    return records.select(*[cell(f) for f in records.schema.fields])


def flatten_json_records(records: DataFrame, column: str = "payload") -> DataFrame:
    """The same over JSON objects with open keys: adds map<string,string>
    `record`, nested objects replaced by their value."""
    values, kinds = F.from_json(column, "map<string,string>"), F.from_json(column, "map<string,variant>")
    flat = F.transform_values(
        values,
        lambda k, v: F.when(
            F.schema_of_variant(F.element_at(kinds, k)).startswith("OBJECT<"), F.coalesce(F.get_json_object(v, "$.value"), F.lit(""))
        ).otherwise(v),
    )
    return records.withColumn("record", flat)


def dictionary_fields(rows: DataFrame) -> DataFrame:
    """(table, column, type) from dictionary rows (name, element,
    internal_type); the row describing the table itself is dropped."""
    kind = F.coalesce("internal_type", F.lit(""))
    return rows.filter(F.coalesce("element", F.lit("")) != "").select(
        F.col("name").alias("table"), F.col("element").alias("column"),
        F.when(kind != "", kind).otherwise("string").alias("type"),
    )


def scoped(records: DataFrame, allowlist: DataFrame, column: str, *, shape: str = TABLE_NAME) -> tuple[DataFrame, DataFrame]:
    """(rows in scope, refused rows with reason): the name must have the
    expected shape and be listed."""
    name = F.col(column)
    listed = allowlist.select(strip(col(allowlist.columns[0])).alias("__allowed"), F.lit(True).alias("__in")).distinct()
    judged = records.join(listed, name == F.col("__allowed"), "left").drop("__allowed")
    reason = F.when(~F.coalesce(name.rlike(shape), F.lit(False)), F.concat(F.lit("invalid name: "), F.coalesce(name, F.lit("")))).when(
        F.col("__in").isNull(), F.concat(F.lit("not in the allowlist: "), name)
    )
    judged = judged.withColumn("reason", reason).drop("__in")
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def issue_in_project(issue_key: Column | str, project: str) -> Column:
    """A sound issue key whose project part is the scoped project."""
    key = col(issue_key)
    cut = F.length(key) - F.length(F.substring_index(key, "-", -1)) - 1
    return key.rlike(ISSUE_KEY) & (F.upper(F.substring(key, F.lit(1), cut)) == project.upper())


def assemble_pages(pages: DataFrame, record_id: str, *, max_pages: int | None = None) -> DataFrame:
    """Records of landed result pages in order: (source, page_no, position,
    record). Pages: source, page_no, next_token, records array<string>.

    A source's walk ends at its first page without a next token; pages past
    the end, or past `max_pages`, belong to no walk. A record seen on two
    pages is kept where it came first; one without an id is always kept. `record_id` is its id's JSON path.
    """
    last = pages.filter(F.coalesce("next_token", F.lit("")) == "").groupBy("source").agg(
        F.min("page_no").alias("__last")
    )
    walked = pages.join(last, "source", "left").filter(
        F.col("__last").isNull() | (F.col("page_no") <= F.col("__last"))
    )
    if max_pages is not None:
        walked = walked.filter(F.col("page_no") < max_pages)
    items = walked.select("source", "page_no", F.posexplode("records").alias("position", "record"))
    first = F.min_by(F.struct("page_no", "position", "record"), F.struct("page_no", "position"))
    # Records without an id are each their own.
    place = F.when(F.col("id").isNull(), F.struct("page_no", "position"))
    return (
        items.withColumn("id", F.get_json_object("record", record_id))
        .groupBy("source", "id", place.alias("place"))
        .agg(first.alias("r"))
        .select("source", "id", "r.*")
    )
