"""Read-only gates over query texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.text import col

# Fixed value: blanks and comments that may stand before the first keyword.
# Executable comments (/*! ... */) and '--x' are not comments to every server.
LEADING_NOISE = r"(?sU)\A(?:[\s\x1c-\x1f]+|/\*(?!!).*?\*/|--[ \t\r\n][^\n]*|#[^\n]*)+"


def is_select(sql: Column | str) -> Column:
    """Does the statement start with SELECT or WITH?"""
    head = F.ltrim(F.regexp_replace(col(sql), LEADING_NOISE, ""), F.lit("("))
    return head.rlike(r"(?iU)\A(?:select|with)\b")


_OPENERS = re.compile(r"/\*|--[^\n]*|'(?:[^']|'')*+'?|\"(?:[^\"]|\"\")*+\"?|\[(?:[^\]]|\]\])*+\]?|;")
_COMMENT_EDGES = re.compile(r"/\*|\*/")


def one_statement(sql: str) -> bool:
    """No text after the first ';' outside literals, names and comments."""
    at, ended = 0, False
    while True:
        m = _OPENERS.search(sql, at)
        gap = sql[at: m.start() if m else len(sql)]
        if ended and gap.strip():
            return False
        if m is None:
            return True
        at, mark = m.end(), m[0]
        if mark == ";":
            if ended:
                return False
            ended = True
        elif mark == "/*":
            depth = 1
            while depth:
                edge = _COMMENT_EDGES.search(sql, at)
                if edge is None:
                    return True
                depth += 1 if edge[0] == "/*" else -1
                at = edge.end()


@F.pandas_udf(T.BooleanType())
def _single(sqls: pd.Series) -> pd.Series:
    return sqls.map(one_statement, na_action="ignore")


def is_single_statement(sql: Column | str) -> Column:
    """Nested comments need a scan, so texts holding a ';' visit Python; see
    `gate_statements` for a log with many equal texts."""
    return _single(col(sql))


def gate_statements(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds is_select, single_statement and reason. A text without ';' is one
    statement; the others are scanned once per distinct text."""
    doubtful = F.coalesce(F.col(sql).contains(";"), F.lit(False))
    texts = log.filter(doubtful).select(F.col(sql).alias("__text")).distinct()
    scanned = texts.withColumn("__single", is_single_statement("__text"))
    # Only rows with a ';' are joined; the rest keep their place.
    judged = log.filter(doubtful).join(scanned, F.col(sql) == F.col("__text")).drop("__text")
    plain = log.filter(~doubtful).withColumn("__single", F.col(sql).isNotNull())
    out = judged.unionByName(plain).withColumn("is_select", F.coalesce(is_select(sql), F.lit(False)))
    out = out.withColumn("single_statement", F.col("__single"))
    return out.drop("__single").withColumn(
        "reason",
        F.when(~F.col("is_select"), "only SELECT queries are supported").when(
            ~F.col("single_statement"), "only a single statement is allowed"
        ),
    )
