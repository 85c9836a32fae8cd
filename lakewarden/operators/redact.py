"""Redaction of whole DataFrames: flat, nested and numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import pii
from lakewarden.functions.text import col, let, number_text

MAX_CARD_DIGITS = 16
_BEFORE, _AFTER = "__leaves", "__redacted_leaves"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def _number_parts(c: Column, dtype: T.DataType) -> Column:
    """struct<sign,whole,fraction,whole_hit,fraction_hit> of a printed number.

    Only the card pass can match a number: the others need separators or an
    '@'. A card is a whole run of 13 to 16 digits, so each side of the point is
    checked as it stands; in powers of ten the digits touch the 'e', which is
    no boundary.
    """
    def card(run: Column) -> Column:
        plain = F.length(run).between(pii.MIN_CARD_DIGITS, MAX_CARD_DIGITS) & ~run.contains("e")
        return F.when(plain, F.call_function("luhn_check", run)).otherwise(False)

    def parts(text: Column) -> Column:
        body = F.ltrim(text, F.lit("-"))
        pointed = body.contains(".")
        whole = F.substring_index(body, ".", 1)
        fraction = F.when(pointed, F.substring_index(body, ".", -1)).otherwise("")
        return F.struct(
            F.when(text.startswith("-"), "-").otherwise("").alias("sign"), whole.alias("whole"), fraction.alias("fraction"),
            card(whole).alias("whole_hit"), card(fraction).alias("fraction_hit"),
        )

    return let(number_text(c, dtype.simpleString()), parts)


def may_hold_card(dtype: T.DataType) -> bool:
    """Whether a number of this type can print a run of 13 digits; the type alone says so."""
    if isinstance(dtype, T.DecimalType):
        return max(dtype.precision - dtype.scale, dtype.scale) >= pii.MIN_CARD_DIGITS
    return is_numeric(dtype) and not isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType))


def _worth_printing(c: Column, dtype: T.DataType) -> Column:
    """A cheap condition that every number with a card-shaped run meets. Short doubles
    have no run of 13 digits, but for those that Java prints with an exponent."""
    if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
        size = F.abs(c.cast("double"))
        return (size >= 1e12) | ((size < 1e-3) & (size > 0)) | (F.length(c.cast("double").cast("string")) > pii.MIN_CARD_DIGITS)
    if isinstance(dtype, T.DecimalType) and dtype.scale >= pii.MIN_CARD_DIGITS:
        return c.isNotNull()
    return ~c.between(1 - 10 ** (pii.MIN_CARD_DIGITS - 1), 10 ** (pii.MIN_CARD_DIGITS - 1) - 1)


def numeric_hits(c: Column, dtype: T.DataType) -> Column:
    """How many card numbers a number reads as (bigint)."""
    if not may_hold_card(dtype):
        return F.lit(0).cast("bigint")
    if isinstance(dtype, T.IntegralType):
        digits = F.ltrim(c.cast("string"), F.lit("-"))
        found = (F.length(digits) <= MAX_CARD_DIGITS) & F.call_function("luhn_check", digits)
        return F.when(_worth_printing(c, dtype) & found, 1).otherwise(0).cast("bigint")
    found = let(_number_parts(c, dtype), lambda p: p["whole_hit"].cast("bigint") + p["fraction_hit"].cast("bigint"))
    return F.coalesce(F.when(_worth_printing(c, dtype), found), F.lit(0).cast("bigint"))


def numeric_as_text(c: Column, dtype: T.DataType) -> Column:
    """The printed number, card numbers replaced."""
    mark = F.lit(pii.token("credit_card"))

    def shown(p: Column) -> Column:
        return F.concat(
            p["sign"],
            F.when(p["whole_hit"], mark).otherwise(p["whole"]),
            F.when(p["fraction"] == "", "").otherwise("."),
            F.when(p["fraction_hit"], mark).otherwise(p["fraction"]),
        )

    return F.when(c.isNotNull(), let(_number_parts(c, dtype), shown))


def redact_number(c: Column, dtype: T.DataType, numeric: str) -> Column:
    """A number under one of the rules of `redact`; the rule and the type alone fix the
    type of the result."""
    if numeric == "string":
        return numeric_as_text(c, dtype)
    if numeric == "skip" or not may_hold_card(dtype):
        return c
    hit = numeric_hits(c, dtype) > 0
    if numeric == "null":
        return F.when(~hit, c)
    return F.when(hit, numeric_as_text(c, dtype).cast("variant")).otherwise(c.cast("variant"))


def _last_entry_per_key(entries: Column) -> Column:
    """Two keys can redact to one token; the later entry wins."""
    return F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + F.lit(2), F.size(entries)), lambda later: later["key"] == e["key"]
        ),
    )


#: Types whose values are read as text before redaction; they leave as text.
_TEXT_LIKE = (T.StringType, T.BinaryType, T.VariantType)


def as_text(c: Column, dtype: T.DataType) -> Column:
    """Bytes as UTF-8 (broken ones replaced), variants as JSON."""
    if isinstance(dtype, T.BinaryType):
        return F.call_function("make_valid_utf8", c.cast("string"))
    return F.to_json(c) if isinstance(dtype, T.VariantType) else c


def redact_value(c: Column, dtype: T.DataType, numeric: str) -> Column:
    """Redact any value by walking its type; numbers follow the rule `numeric` of `redact`.
    A map's keys can be neither variants nor null, so there such numbers become text."""
    if isinstance(dtype, _TEXT_LIKE):
        return pii.redact_text(as_text(c, dtype))
    if isinstance(dtype, T.StructType):
        fields = [redact_value(c[f.name], f.dataType, numeric).alias(n) for n, f in _named(dtype)]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda v: redact_value(v, dtype.elementType, numeric))
    if isinstance(dtype, T.MapType):
        of_keys = "string" if numeric in ("variant", "null") and _holds_number(dtype.keyType) else numeric
        pairs = F.transform(
            F.map_entries(c),
            lambda e: F.struct(
                redact_value(e["key"], dtype.keyType, of_keys).alias("key"),
                redact_value(e["value"], dtype.valueType, numeric).alias("value"),
            ),
        )
        return F.map_from_entries(F.transform(F.array(pairs), _last_entry_per_key)[0])
    return redact_number(c, dtype, numeric) if is_numeric(dtype) else c


def _named(struct: T.StructType) -> list[tuple[str, T.StructField]]:
    """Fields under their redacted names; a later field wins a shared name."""
    last = {pii.redact_name(f.name): f for f in struct.fields}
    return list(last.items())


def _redact_open(c: Column, dtype: T.DataType, numeric: str) -> Column:
    """As `redact_value`, but nothing is merged yet: fields go by place and maps are arrays
    of entries, so every leaf is still there to be counted."""
    if isinstance(dtype, T.StructType):
        fields = [_redact_open(c[f.name], f.dataType, numeric).alias(f"_{i}") for i, f in enumerate(dtype.fields)]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda v: _redact_open(v, dtype.elementType, numeric))
    if isinstance(dtype, T.MapType):
        of_keys = "string" if numeric in ("variant", "null") and _holds_number(dtype.keyType) else numeric
        return F.transform(
            F.map_entries(c),
            lambda e: F.struct(
                _redact_open(e["key"], dtype.keyType, of_keys).alias("key"),
                _redact_open(e["value"], dtype.valueType, numeric).alias("value"),
            ),
        )
    return redact_value(c, dtype, numeric)


def _close(c: Column, dtype: T.DataType) -> Column:
    """A column of `_redact_open` as `redact_value` gives it."""
    if isinstance(dtype, T.StructType):
        last = {pii.redact_name(f.name): (i, f) for i, f in enumerate(dtype.fields)}
        return F.when(c.isNotNull(), F.struct(*[_close(c[f"_{i}"], f.dataType).alias(n) for n, (i, f) in last.items()]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda v: _close(v, dtype.elementType))
    if isinstance(dtype, T.MapType):
        pairs = F.transform(
            c,
            lambda e: F.struct(
                _close(e["key"], dtype.keyType).alias("key"), _close(e["value"], dtype.valueType).alias("value")
            ),
        )
        return F.map_from_entries(F.transform(F.array(pairs), _last_entry_per_key)[0])
    return c


def _leaves(c: Column, dtype: T.DataType, pick, kind: str, opened: bool = False) -> list[Column]:
    """Arrays that together hold pick(leaf) for every leaf it accepts; `opened` says that
    the column is one of `_redact_open`."""
    none = F.array().cast(f"array<{kind}>")

    def below(v: Column, *types: tuple[Column, T.DataType]) -> Column:
        parts = [x for child, t in types for x in _leaves(child, t, pick, kind, opened)]
        return F.concat(none, *parts)

    if isinstance(dtype, T.StructType):
        fields = [(c[f"_{i}"] if opened else c[f.name], f.dataType) for i, f in enumerate(dtype.fields)]
        return [x for child, t in fields for x in _leaves(child, t, pick, kind, opened)]
    if isinstance(dtype, T.ArrayType):
        return [F.coalesce(F.flatten(F.transform(c, lambda v: below(v, (v, dtype.elementType)))), none)]
    if isinstance(dtype, T.MapType):
        pairs = c if opened else F.map_entries(c)
        both = F.transform(pairs, lambda e: below(e, (e["key"], dtype.keyType), (e["value"], dtype.valueType)))
        return [F.coalesce(F.flatten(both), none)]
    leaf = pick(c, dtype)
    return [] if leaf is None else [F.array(leaf)]


def _leaf_text(c: Column, dtype: T.DataType) -> Column | None:
    return as_text(c, dtype) if isinstance(dtype, _TEXT_LIKE) else None


def _leaf_redacted(c: Column, dtype: T.DataType) -> Column | None:
    return c if isinstance(dtype, _TEXT_LIKE) else None


def _new_marks(kind: str) -> Column:
    """How many marks of a type the leaves hold now and did not before. No pattern can match
    a mark or part of one, so marks only come with the values they replace."""
    mark = pii.token(kind)
    before, after = (f"(length({x}) - length(replace({x}, '{mark}', ''))) div {len(mark)}" for x in (_BEFORE, _AFTER))
    return F.expr(f"if({_BEFORE} = {_AFTER}, 0L, {after} - {before})")


def _leaf_hits(c: Column, dtype: T.DataType) -> Column | None:
    return numeric_hits(c, dtype) if may_hold_card(dtype) else None


def _holds_number(dtype: T.DataType) -> bool:
    """Whether some number below may read as a card."""
    if isinstance(dtype, T.ArrayType):
        return _holds_number(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_number(dtype.keyType) or _holds_number(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_holds_number(f.dataType) for f in dtype.fields)
    return may_hold_card(dtype)


def redact(df: DataFrame, *, numeric: str = "variant", counts: str | None = None) -> DataFrame:
    """Redact every column of a DataFrame, names included, in one pass.

    A number that reads as a card is redacted like text. `numeric` says how, and the
    column's type alone decides what it becomes, never the rows: with "variant" a number
    that can print 13 digits (bigint, float, double, wide decimal) becomes a VARIANT that
    holds the number, or the mark as text where it is a card; `as_numbers` gives typed
    columns back. With "null" types stay and a card is null, with "string" every number
    becomes text, with "skip" numbers are left alone. Narrower numbers always stay, but
    for "string". `counts` names a per-row struct of totals by type.
    """
    if numeric not in ("variant", "null", "string", "skip"):
        raise ValueError(f"unknown rule for numbers: {numeric}")
    # Columns are addressed by position: a query's result may have equal names.
    names = df.columns
    df = df.toDF(*[f"__{i}" for i in range(len(names))])
    texts = {f.name: as_text(F.col(f.name), f.dataType) for f in df.schema.fields if isinstance(f.dataType, (T.BinaryType, T.VariantType))}
    df = df.withColumns(texts) if texts else df
    flat, leaves, redacted, hits = [], [], [], []
    opened: dict[str, Column] = {}
    replaced: dict[str, Column] = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            flat.append(f.name)
        elif is_numeric(f.dataType) or isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            own = _leaves(c, f.dataType, _leaf_text, "string") if counts else []
            if own:
                # Redacted once, for the value and for the counts.
                opened[f"{f.name}_open"] = _redact_open(c, f.dataType, numeric)
                whole = F.col(f"`{f.name}_open`")
                redacted += _leaves(whole, f.dataType, _leaf_redacted, "string", opened=True)
                replaced[f.name] = _close(whole, f.dataType)
            else:
                replaced[f.name] = redact_value(c, f.dataType, numeric)
            leaves += own
            hits += _leaves(c, f.dataType, _leaf_hits, "bigint") if numeric != "skip" else []
    out = pii.redact_columns(df, flat, counts=counts)
    if opened:
        out = out.withColumns(opened)
        # Marks are counted in all leaves as one text.
        out = out.withColumns({name: F.array_join(F.concat(*of), "\0") for name, of in ((_BEFORE, leaves), (_AFTER, redacted))})
        both = [(F.col(counts)[t] + F.coalesce(_new_marks(t), F.lit(0).cast("bigint"))).alias(t) for t in pii.PII_TYPES]
        out = out.withColumn(counts, F.struct(*both))
    if counts and hits:
        cards = F.aggregate(F.concat(*hits), F.lit(0).cast("bigint"), lambda a, n: a + n)
        out = out.withColumn(counts, F.col(counts).withField("credit_card", F.col(counts)["credit_card"] + cards))
    if replaced:
        out = out.withColumns(replaced)
    # Names that become one by redaction: the later column wins. Equal names both stay.
    keep: dict[tuple[str, str], str] = {}
    for i, name in enumerate(names):
        new = pii.redact_name(name)
        keep[(new, "" if new != name else str(i))] = f"__{i}"
    chosen = [F.col(old).alias(new) for (new, _), old in keep.items()]
    return out.select(*chosen, *([F.col(counts)] if counts else []))


def as_numbers(df: DataFrame, like: T.StructType) -> DataFrame:
    """Variant columns of a redacted frame in the number types they have in `like`, its
    schema before redaction: a redacted number is null, and others are exact. Columns are
    met by position, and nested values stay as they are."""
    if len(df.columns) != len(like.fields):
        raise ValueError("the frame has other columns than the schema")
    names = df.columns
    rows = df.toDF(*[f"__{i}" for i in range(len(names))])
    typed = [
        F.try_variant_get(f"__{i}", "$", f.dataType.simpleString())
        if is_numeric(f.dataType) and isinstance(rows.schema[i].dataType, T.VariantType) else F.col(f"__{i}")
        for i, f in enumerate(like.fields)
    ]
    return rows.select(*(c.alias(n) for c, n in zip(typed, names, strict=True)))


def redact_free_text(c: Column | str, cap: int | None = None) -> Column:
    """A description or rationale, redacted; cut before at `cap` characters if one is given."""
    return pii.redact_text(col(c) if cap is None else F.substring(col(c), 1, cap))


def total_counts(df: DataFrame, counts: str) -> DataFrame:
    """Table totals from per-row counts: one row per type that occurred."""
    sums = df.agg(*[F.sum(F.col(counts)[t]).alias(t) for t in pii.PII_TYPES])
    pairs = F.array(*[F.struct(F.lit(t).alias("pii_type"), F.col(t).alias("hits")) for t in pii.PII_TYPES])
    return sums.select(F.inline(pairs)).filter("hits > 0")


def pii_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Which columns hold which types: hits, rows hit and a redacted sample.

    Everything is one partial-then-final aggregate over the table; the small
    one-row result is unpivoted afterwards, so no text is shuffled.
    """
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    rows = pii.redact_columns(df.select(*[F.col(f"`{c}`") for c in names]), names, counts="__n", per_column=True)
    measures = []
    for i, c in enumerate(names):
        for k, t in enumerate(pii.PII_TYPES):
            n = F.col("__n")[c][t]
            measures += [
                F.sum(n).alias(f"hits_{i}_{k}"),
                F.count_if(n > 0).alias(f"rows_{i}_{k}"),
                F.min(F.when(n > 0, F.col(f"`{c}`"))).alias(f"sample_{i}_{k}"),
            ]
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(t).alias("pii_type"),
            F.col(f"hits_{i}_{k}").alias("hits"),
            F.col(f"rows_{i}_{k}").alias("rows_hit"),
            F.col(f"sample_{i}_{k}").alias("sample_value"),
        )
        for i, c in enumerate(names)
        for k, t in enumerate(pii.PII_TYPES)
    ]
    return rows.agg(*measures).select(F.inline(F.array(*cells))).filter("hits > 0")
