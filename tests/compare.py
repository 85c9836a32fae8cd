"""Order-blind comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> list[str]:
    """Differences in words; empty when equal."""
    spark_cols, spark_rows = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    duck_cols, duck_rows = [d[0] for d in cur.description], cur.fetchall()
    if sorted(spark_cols) != sorted(duck_cols):
        return [f"columns {sorted(spark_cols)} != {sorted(duck_cols)}"]
    a, b = rows_of(spark_cols, spark_rows), rows_of(duck_cols, duck_rows)
    if len(a) != len(b):
        extra = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
        return [f"rows {len(a)} != {len(b)}", f"only spark / only sql: {str(extra)[:1500]}"]
    if not a:
        return ["both results are empty"]
    return [f"{str(x)[:400]} != {str(y)[:400]}" for x, y in zip(a, b) if x != y][:2]
