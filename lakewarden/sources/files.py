"""Files under a root or an object prefix."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.text import col
from lakewarden.functions.types import inferred_type

# Suffixes and the size of an object that is refused.
SUFFIX_KINDS = {"csv": [".csv"], "xlsx": [".xlsx"], "pdf": [".pdf"], "text": [".txt", ".md", ".log", ".json"]}
OBJECT_BYTES = 64 * 1024 * 1024

_RAW = "__raw_record"


def file_kind(name: Column | str) -> Column:
    """csv, xlsx, pdf, text or null, by suffix alone."""
    lowered = F.lower(col(name))
    kind = None
    for label, suffixes in SUFFIX_KINDS.items():
        for suffix in suffixes:
            test = lowered.endswith(suffix)
            kind = F.when(test, label) if kind is None else kind.when(test, label)
    return kind


def capped_text(content: Column | str, max_chars: int | None = None) -> Column:
    c = col(content)
    return c if max_chars is None else F.substring(c, 1, max_chars)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cells(records: pd.Series) -> pd.Series:
    def parse(record):
        return None if record is None else next(csv.reader(io.StringIO(record, newline="")), [])

    return records.map(parse)


def read_csv_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV files sharing a header, every value a string. Cells past the header
    are kept as `_extra`, short rows end in nulls, empty cells are ''.

    Files are scanned once; only the raw text of rows whose cell count differs
    from the header is parsed again, in Python (null for all other rows).
    """
    options = {"header": True, "multiLine": True, "escape": '"', "recursiveFileLookup": True, "pathGlobFilter": "*.[cC][sS][vV]"}
    names = [c for c in spark.read.csv(path, inferSchema=False, **options).columns]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _RAW]])
    rows = spark.read.schema(schema).csv(
        path, mode="PERMISSIVE", columnNameOfCorruptRecord=_RAW, enforceSchema=False, **options
    )
    found, width = F.col("__cells"), F.size("__cells")
    return (
        rows.withColumn("__cells", _cells(_RAW))
        .filter(found.isNull() | (width > 0))
        .select(
            *[
                F.when(found.isNotNull(), F.get(found, F.lit(i))).otherwise(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c)
                for i, c in enumerate(names)
            ],
            F.when(
                width > len(names), F.slice(found, len(names) + 1, F.greatest(width - len(names), F.lit(1)))
            ).alias("_extra"),
        )
    )


def csv_fields(rows: DataFrame, columns: list[str], *, sample_rows: int | None = None) -> DataFrame:
    """(file, ordinal, column, type) per file of a frame that carries a `file`
    column. All rows count; a caller may ask for the first `sample_rows` of each file by `line`.

    Only the first rows of each file leave a task: the rank filter is applied
    before the shuffle.
    """
    if sample_rows is not None:
        place = F.row_number().over(Window.partitionBy("file").orderBy("line"))
        rows = rows.withColumn("__n", place).filter(F.col("__n") <= sample_rows)
    typed = rows.groupBy("file").agg(*[inferred_type(F.col(f"`{c}`")).alias(f"t{i}") for i, c in enumerate(columns)])
    cells = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"t{i}").alias("type"))
        for i, c in enumerate(columns)
    ]
    return typed.select("file", F.inline(F.array(*cells)))


def read_text_documents(spark: SparkSession, path: str | list[str], *, max_chars: int | None = None) -> DataFrame:
    """(path, content): one row per file, whole file when max_chars is None."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), capped_text("value", max_chars).alias("content"))


def list_files(spark: SparkSession, root: str, *, max_files: int | None = None) -> DataFrame:
    """(name, length, kind) of every file under a root, sorted; content is not
    read. Folder markers (empty names ending in '/') are dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    base = root if "://" in root or root.startswith("file:") else "file:" + root
    prefix = F.lit(base.rstrip("/") + "/")
    clean = F.regexp_replace("path", "^file:/+", "file:/")
    listed = drop_markers(raw.select(F.substring(clean, F.length(prefix) + 1, F.length(clean)).alias("name"), "length"))
    listed = listed.withColumn("kind", file_kind("name")).orderBy("name")
    return listed if max_files is None else listed.limit(max_files)


def drop_markers(listing: DataFrame) -> DataFrame:
    """Objects only: an empty key ending in '/' stands for a folder."""
    return listing.filter(~(F.col("name").endswith("/") & (F.col("length") == 0)))


def under_prefix(listing: DataFrame, prefix: str) -> DataFrame:
    """Keys below a prefix, named relative to it."""
    inside = listing.filter(F.col("name").startswith(prefix))
    return inside.withColumn("key", F.col("name")).withColumn(
        "name", F.substring("name", F.lit(len(prefix) + 1), F.length("name"))
    )


def document_tables(listing: DataFrame) -> DataFrame:
    """One table per supported file; documents have a single `content` field,
    CSV fields come from `csv_fields`."""
    content = F.array(F.struct(F.lit("content").alias("name"), F.lit("text").alias("type")))
    none = F.array().cast("array<struct<name:string,type:string>>")
    return listing.filter(F.col("kind").isNotNull()).select(
        F.col("name").alias("table"), "kind",
        F.when(F.col("kind").isin("pdf", "text"), content).otherwise(none).alias("fields"),
    )


def inside_root(path: Column | str, root: str) -> Column:
    """Does a requested path, with its dots resolved, stay under the root?"""
    base = [p for p in root.split("/") if p]
    root_parts = F.array(*map(F.lit, base)).cast("array<string>")
    none = F.array().cast("array<string>")
    p = col(path)
    start = F.when(p.startswith("/"), none).otherwise(root_parts)
    resolved = F.aggregate(
        F.split(p, "/"),
        start,
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part))),
    )
    return F.slice(resolved, 1, max(len(base), 1)) == root_parts if base else F.lit(True)


def has_parent_step(path: Column | str) -> Column:
    """Drive-style guard: any '..' segment (either slash) is refused."""
    return F.exists(F.split(F.translate(col(path), "\\", "/"), "/"), lambda part: part == "..")


def size_gate(listing: DataFrame, max_bytes: int = OBJECT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(readable, refused with reason): an object past the ceiling is refused
    whole, never cut."""
    fits = F.col("length") <= max_bytes
    reason = F.concat(
        F.lit(f"object exceeds the {max_bytes // (1024 * 1024)} MiB read in one query: "), F.col("name")
    )
    return listing.filter(fits), listing.filter(~fits).withColumn("reason", reason)
