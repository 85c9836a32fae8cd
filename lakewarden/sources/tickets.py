"""Landed issue-tracker payloads."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.text import col
from lakewarden.sources.files import capped_text

_ISSUE = (
    "key string, fields struct<summary:string, status:struct<name:string>, issuetype:struct<name:string>, "
    "priority:struct<name:string>, assignee:struct<displayName:string>, reporter:struct<displayName:string>, "
    "created:string, updated:string, description:string>"
)


def issue_rows(issues: DataFrame, site: str, column: str = "payload") -> DataFrame:
    """Ten flat string columns per issue; anything missing or null is ''."""
    parsed = issues.withColumn("__i", F.from_json(column, _ISSUE))

    def text(path: str) -> Column:
        return F.coalesce(F.col(f"__i.{path}"), F.lit(""))

    key = text("key")
    return parsed.select(
        *[c for c in issues.columns if c != column],
        key.alias("key"),
        text("fields.summary").alias("summary"),
        text("fields.status.name").alias("status"),
        text("fields.issuetype.name").alias("issue_type"),
        text("fields.priority.name").alias("priority"),
        text("fields.assignee.displayName").alias("assignee"),
        text("fields.reporter.displayName").alias("reporter"),
        text("fields.created").alias("created_at"),
        text("fields.updated").alias("updated_at"),
        F.when(key != "", F.concat(F.lit(f"{site}/browse/"), key)).otherwise("").alias("url"),
    )


def issue_description(column: str = "payload") -> Column:
    """The rich-text description of an issue payload, as JSON text."""
    return F.from_json(F.col(column), _ISSUE)["fields"]["description"]


def _flatten(node) -> str:
    """Text of a rich-text tree: text nodes, lists joined by line breaks."""
    if isinstance(node, dict):
        node = node.get("text", "") if node.get("type") == "text" else node.get("content", [])
        return _flatten(node)
    if isinstance(node, list):
        return "\n".join(filter(None, map(_flatten, node)))
    return node if isinstance(node, str) else ""


def _text_of(document: str) -> str:
    """A description that is no JSON is plain text already."""
    try:
        return _flatten(json.loads(document))
    except ValueError:
        return document


@F.pandas_udf(T.StringType())
def _document_text(documents: pd.Series) -> pd.Series:
    return documents.map(_text_of, na_action="ignore")


def rich_text(document: Column | str, *, max_chars: int | None = None) -> Column:
    """Plain text of a JSON rich-text column; the tree has no fixed depth."""
    return capped_text(F.coalesce(_document_text(col(document)), F.lit("")), max_chars)
