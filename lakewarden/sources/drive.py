"""Landed drive listings: export names and folder trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.text import col
from lakewarden.session import cut_lineage

# Native document types and the format each is exported to.
EXPORT_AS = {
    "application/vnd.google-apps.document": ("text/plain", ".txt"),
    "application/vnd.google-apps.spreadsheet": ("text/csv", ".csv"),
    "application/vnd.google-apps.presentation": ("text/plain", ".txt"),
}
FOLDER_MIME = "application/vnd.google-apps.folder"
_CUT_EVERY = 8


def _by_mime(mime: Column, pick: int) -> Column:
    chain = None
    for native, target in EXPORT_AS.items():
        chain = (F if chain is None else chain).when(mime == native, target[pick])
    return chain


def export_mime(mime: Column | str) -> Column:
    return _by_mime(col(mime), 0)


def effective_name(name: Column | str, mime: Column | str) -> Column:
    """File name with the suffix its exported bytes have."""
    n, suffix = col(name), _by_mime(col(mime), 1)
    return F.when(suffix.isNotNull() & ~F.lower(n).endswith(suffix), F.concat(n, suffix)).otherwise(n)


def walk_folders(listing: DataFrame, root_id: str, *, max_depth: int = 64) -> DataFrame:
    """(path, id, mime) of every file below a root folder.

    Listing: id, parent_id, name, mime. Folder paths are built level by level
    over the folder rows only; files are joined to them once at the end.
    `max_depth` ends a walk through a listing with a cycle by an error, not
    by dropping files.
    """
    named = listing.filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("id", F.lit("")) != ""))
    folders = named.filter(F.col("mime") == FOLDER_MIME).select(
        F.col("id").alias("child"), F.col("parent_id").alias("folder"), "name"
    )
    spark = listing.sparkSession
    level = spark.createDataFrame([(root_id, "")], "folder string, prefix string")
    reached = level
    for depth in range(1, max_depth + 2):
        level = level.join(folders, "folder").select(
            F.col("child").alias("folder"), F.concat("prefix", "name", F.lit("/")).alias("prefix")
        )
        level = cut_lineage(level)
        if level.isEmpty():
            break
        if depth > max_depth:
            raise ValueError(f"folders nest deeper than {max_depth} levels below {root_id}")
        reached = reached.unionByName(level)
        if depth % _CUT_EVERY == 0:
            reached = cut_lineage(reached)
    files = named.filter(F.col("mime") != FOLDER_MIME)
    return files.join(reached, files["parent_id"] == reached["folder"]).select(
        F.concat("prefix", effective_name("name", "mime")).alias("path"), "id", "mime"
    )
