"""Text expressions whose edge cases follow Python string rules."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALL = [chr(i) for i in range(sys.maxunicode + 1)]
WHITESPACE = "".join(c for c in _ALL if c.isspace())
_DIGIT_CHARS = [c for c in _ALL if unicodedata.category(c) == "Nd" and not c.isascii()]
DIGITS_FROM = "".join(_DIGIT_CHARS)
DIGITS_TO = "".join(str(unicodedata.digit(c)) for c in _DIGIT_CHARS)
del _ALL, _DIGIT_CHARS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every Unicode blank, not only spaces."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times inside `body`."""
    return F.transform(F.array(value), body)[0]


def alnum_key(name: Column | str) -> Column:
    """Case-, camel- and punctuation-blind form of an identifier."""
    return F.regexp_replace(F.lower(col(name)), "[^a-z0-9]", "")


def singular(word: Column) -> Column:
    def cut(n: int) -> Column:
        return F.substring(word, F.lit(1), F.length(word) - n)

    return (
        F.when(word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(?:s|x|z|ch|sh)es$"), cut(2))
        .when(word.endswith("s"), cut(1))
        .otherwise(word)
    )


def table_stem(table: Column | str) -> Column:
    """'crm/customers.csv' -> 'customer'."""
    leaf = F.substring_index(F.substring_index(col(table), "/", -1), ".", 1)
    return singular(alnum_key(leaf))


def python_float_text(x: Column) -> Column:
    """A double as Python prints it (fixed notation from 1e-4 up to 1e16)."""
    x = x.cast("double")
    java = x.cast("string")
    magnitude = F.abs(x)
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), "^-", "")
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    sign = F.when(java.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    point = exponent + 1
    whole = F.rpad(F.substring(digits, F.lit(1), point), point, F.lit("0"))
    fraction = F.substring(digits, point + 1, F.length(digits))
    large = F.concat(sign, whole, F.lit("."), F.when(fraction == "", "0").otherwise(fraction))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    power = F.concat(
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")),
    )
    scientific = F.concat(sign, F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), power)
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(magnitude == F.lit(float("inf")), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(~java.contains("E"), java)
        .when(magnitude >= 1e16, scientific)
        .when(magnitude >= 1.0, large)
        .when(magnitude >= 1e-4, small)
        .otherwise(scientific)
    )


def number_text(c: Column, type_name: str) -> Column:
    """A numeric value as its JSON encoding prints it."""
    if type_name in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("string")
    if type_name.startswith("decimal"):
        scale = int(type_name.rstrip(")").split(",")[1])
        return c.cast("string") if scale == 0 else python_float_text(c)
    return python_float_text(c)


def quoted(name: Column) -> Column:
    """A name in quotes, switching quote style when it holds an apostrophe."""
    body = F.replace(name, F.lit("\\"), F.lit("\\\\"))
    both = name.contains("'") & name.contains('"')
    return (
        F.when(both, F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
        .when(name.contains("'"), F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), body, F.lit("'")))
    )


def quoted_list(names: Column) -> Column:
    """['a', 'b'] for a list of plain names, sorted."""
    return F.concat(F.lit("['"), F.array_join(F.array_sort(names), "', '"), F.lit("']"))
