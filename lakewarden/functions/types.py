"""Type inference for string cells and type families for joinability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewarden.functions.text import col

_BLANK = r"[\s\x1c-\x1f]*"
_DIGITS = r"\d(?:_?\d)*"
INTEGER_PATTERN = rf"(?U)\A{_BLANK}[+-]?{_DIGITS}{_BLANK}\z"
FLOAT_PATTERN = (
    rf"(?U)\A{_BLANK}[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    rf"|(?i:inf|infinity|nan)){_BLANK}\z"
)

# Declared type names by family.
NUMERIC_TYPES = ["integer", "bigint", "smallint", "number", "numeric", "real", "double precision"]
TEMPORAL_TYPES = [
    "date", "time", "timestamp", "timestamp without time zone", "timestamp with time zone", "datetime",
]
BOOLEAN_TYPES = ["boolean", "bool"]


def inferred_type(values: Column | str) -> Column:
    """Aggregate: integer, number or string, ignoring empty cells."""
    v = col(values)
    filled = v.isNotNull() & (v != "")
    all_int = F.bool_and(F.when(filled, v.rlike(INTEGER_PATTERN)))
    all_float = F.bool_and(F.when(filled, v.rlike(FLOAT_PATTERN)))
    return F.when(all_int, "integer").when(all_float, "number").otherwise("string")


def type_family(type_name: Column | str) -> Column:
    t = F.lower(col(type_name))
    return (
        F.when(t.isin(NUMERIC_TYPES), "numeric")
        .when(t.isin(TEMPORAL_TYPES), "temporal")
        .when(t.isin(BOOLEAN_TYPES), "boolean")
        .otherwise("text")
    )


def joinable(a: Column, b: Column) -> Column:
    """Families that can share a key: the same numeric or text one, or one of each."""
    keyed = ["numeric", "text"]
    return a.isin(keyed) & b.isin(keyed)
