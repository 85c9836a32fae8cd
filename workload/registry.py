"""Query registry and the input derivations both engines share.

A derivation is one SQL text valid in Spark and DuckDB. Spark runs it over the
tables as DataFrames; for DuckDB it becomes a CTE of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DERIVED: dict[str, str] = {}

_NAME = re.compile(r"(?<!\{)\{([a-z]\w*)\}(?!\})")


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its equivalent."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle(sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input (or a plain table) as a DataFrame."""
    if name not in DERIVED:
        return table(spark, sf_dir, name)
    parts = sorted(set(_NAME.findall(DERIVED[name])))
    return spark.sql(DERIVED[name], **{p: derive(spark, sf_dir, p) for p in parts})


def _needed(sql: str, found: dict[str, str]) -> None:
    for name in _NAME.findall(sql):
        if name in DERIVED and name not in found:
            _needed(DERIVED[name], found)
            found[name] = _plain(DERIVED[name])


def _plain(sql: str) -> str:
    return _NAME.sub(r"\1", sql).replace("{{", "{").replace("}}", "}")


def oracle(sql: str) -> str:
    """DuckDB text: the derivations a query names, as CTEs before it."""
    found: dict[str, str] = {}
    _needed(sql, found)
    body = _plain(sql)
    if not found:
        return body
    ctes = ", ".join(f"{name} AS ({text})" for name, text in found.items())
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes}, {stripped[5:]}"
    return f"WITH {ctes} {body}"
