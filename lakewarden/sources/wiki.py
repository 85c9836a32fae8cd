"""Landed wiki pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.text import col
from lakewarden.sources.files import capped_text

_PAGE = (
    "id string, title string, status string, spaceId string, parentId string, authorId string, createdAt string, "
    "_links struct<webui:string>, body struct<storage:struct<value:string>>"
)


def page_rows(pages: DataFrame, site: str, column: str = "payload") -> DataFrame:
    """Eight flat string columns per page; anything missing or null is ''."""
    parsed = pages.withColumn("__p", F.from_json(column, _PAGE))

    def text(path: str) -> Column:
        return F.coalesce(F.col(f"__p.{path}"), F.lit(""))

    link = text("_links.webui")
    return parsed.select(
        *[c for c in pages.columns if c != column],
        text("id").alias("id"), text("title").alias("title"), text("status").alias("status"),
        text("spaceId").alias("space_id"), text("parentId").alias("parent_id"), text("authorId").alias("author_id"),
        text("createdAt").alias("created_at"),
        F.when(link != "", F.concat(F.lit(f"{site}/wiki"), link)).otherwise("").alias("url"),
    )


def page_markup(column: str = "payload") -> Column:
    return F.coalesce(F.from_json(F.col(column), _PAGE)["body"]["storage"]["value"], F.lit(""))


class _Chunks(HTMLParser):
    """Character data of a page, blank chunks dropped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.kept: list[str] = []

    def handle_data(self, data: str) -> None:
        if data := data.strip():
            self.kept.append(data)


def _text_of(markup: str) -> str:
    reader = _Chunks()
    try:
        reader.feed(markup)
        reader.close()
    except Exception:  # broken markup stays readable as it is
        return markup
    return "\n".join(reader.kept)


@F.pandas_udf(T.StringType())
def _markup_text(pages: pd.Series) -> pd.Series:
    return pages.map(_text_of, na_action="ignore")


def markup_text(markup: Column | str, *, max_chars: int | None = None) -> Column:
    """Visible text of a markup column, one line per chunk of character data."""
    return capped_text(_markup_text(col(markup)), max_chars)
