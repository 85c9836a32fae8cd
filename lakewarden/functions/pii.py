"""Personal-data patterns, redaction and counts as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.text import DIGITS_FROM, DIGITS_TO, col, let

# Pass order and patterns that decide which text counts as
# personal data. Each pass reads the output of the one before it.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b(?:\+?1[\s.-])?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b",
    "credit_card": r"\b(?:\d[ -]?){13,16}\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b",
}
PII_TYPES = tuple(PATTERNS)
MIN_CARD_DIGITS = 13

# A match starts with one of these; looking for them first spares the costly
# Unicode boundary test at every other position.
_STARTS = {"ssn": r"(?=\d)", "phone": r"(?=[\d(+])", "credit_card": r"(?=\d)", "ipv4": r"(?=\d)"}
# (?U): \d \s \b follow Unicode, and the four separator controls are blanks.
_JAVA = {
    k: "(?U)" + _STARTS.get(k, "") + p.replace(r"[\s.-]", r"[\s\x1c-\x1f.-]") for k, p in PATTERNS.items()
}
# A string without '@' and without a digit cannot match any pattern.
_MAY_HOLD_PII = r"[@\p{Nd}]"


def token(kind: str) -> str:
    return f"[REDACTED:{kind}]"


def _checksum_ok(number: Column) -> Column:
    digits = F.translate(F.regexp_replace(number, r"(?U)\D", ""), DIGITS_FROM, DIGITS_TO)
    return F.call_function("luhn_check", digits)


def luhn_ok(number: Column) -> Column:
    """At least 13 digits whose checksum holds."""
    enough = F.length(F.regexp_replace(number, r"(?U)\D", "")) >= MIN_CARD_DIGITS
    return enough & _checksum_ok(number)


def _redact_cards(text: Column) -> Column:
    pattern = _JAVA["credit_card"]
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    kept = F.transform(found, lambda m: F.when(_checksum_ok(m), F.lit(token("credit_card"))).otherwise(m))
    rebuilt = F.array_join(
        F.zip_with(between, kept, lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), ""
    )
    return F.when(text.rlike(pattern), rebuilt).otherwise(text)


def _one_pass(kind: str, text: Column) -> Column:
    if kind == "credit_card":
        return _redact_cards(text)
    replaced = F.regexp_replace(text, _JAVA[kind], token(kind))
    if kind == "email":
        return F.when(text.contains("@"), replaced).otherwise(text)
    return replaced


def redact_text(c: Column | str) -> Column:
    """Redacted text. For whole columns prefer `redact_columns`, which keeps
    each pass a separate projection so no pass is evaluated twice."""
    text = col(c)

    def passes(v: Column) -> Column:
        for kind in ("email", "ssn", "phone"):
            v = _one_pass(kind, v)
        return let(v, lambda t: F.regexp_replace(_redact_cards(t), _JAVA["ipv4"], token("ipv4")))

    return F.when(text.rlike(_MAY_HOLD_PII), passes(text)).otherwise(text)


def redact_columns(
    df: DataFrame, columns: list[str], *, counts: str | None = None, per_column: bool = False
) -> DataFrame:
    """Redact string columns in place, one projection per pass.

    `counts` names a struct column of per-row totals by type; with
    `per_column` it is a struct of such structs, one per redacted column.
    """
    names = df.columns
    stage = {c: [f"__pii_{i}_{k}" for k in range(len(PII_TYPES) + 1)] for i, c in enumerate(columns)}
    may = {c: f"__pii_{i}_may" for i, c in enumerate(columns)}
    out = df.withColumns({stage[c][0]: F.col(f"`{c}`") for c in columns})
    out = out.withColumns({may[c]: F.col(stage[c][0]).rlike(_MAY_HOLD_PII) for c in columns})
    for k, kind in enumerate(PII_TYPES):
        step = {}
        for c in columns:
            prev = F.col(stage[c][k])
            step[stage[c][k + 1]] = F.when(F.col(may[c]), _one_pass(kind, prev)).otherwise(prev)
        out = out.withColumns(step)
    final = [F.col(stage[c][-1]).alias(c) if c in stage else F.col(f"`{c}`") for c in names]
    if counts:
        # Written as SQL text: one expression per count instead of a dozen calls.
        def hits(c: str, k: int) -> str:
            mark = token(PII_TYPES[k])
            before, after = (
                f"(length({x}) - length(replace({x}, '{mark}', ''))) div {len(mark)}" for x in stage[c][k : k + 2]
            )
            return f"if({may[c]}, {after} - {before}, 0L)"

        if per_column:
            cells = [
                F.expr("struct(" + ", ".join(f"{hits(c, k)} AS {t}" for k, t in enumerate(PII_TYPES)) + ")").alias(c)
                for c in columns
            ]
            final.append(F.struct(*cells).alias(counts))
        else:
            sums = [" + ".join(["0L", *[hits(c, k) for c in columns]]) + f" AS {t}" for k, t in enumerate(PII_TYPES)]
            final.append(F.expr(f"struct({', '.join(sums)})").alias(counts))
    return out.select(*final)


# --- names of columns and fields: plan-time metadata, a handful of strings ----

def redact_name(name: str) -> str:
    """Redact a schema name, since object keys can be personal data too."""
    for kind, pattern in PATTERNS.items():
        if kind == "credit_card":
            name = re.sub(pattern, lambda m: token("credit_card") if _luhn(m.group()) else m.group(), name)
        else:
            name = re.sub(pattern, token(kind), name)
    return name


def _luhn(number: str) -> bool:
    digits = [int(ch) for ch in number if ch.isdecimal()]
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return len(digits) >= MIN_CARD_DIGITS and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0
