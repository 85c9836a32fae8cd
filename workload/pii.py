"""Redaction queries over whole texts."""

from pyspark.sql import functions as F

from lakewarden.functions.pii import PATTERNS, PII_TYPES, luhn_ok, redact_columns
from lakewarden.operators.redact import pii_profile, redact, redact_free_text, total_counts
from lakewarden.session import use_all_cores
from workload.registry import query, table


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _luhn(c: str) -> str:
    """Checksum over the reversed digits of a card-shaped match."""
    digits = f"regexp_replace(reverse({c}), '[^0-9]', '', 'g')"
    digit = f"CAST(substr({digits}, d, 1) AS INTEGER)"
    return (
        f"(list_sum([CASE WHEN d % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END "
        f"FOR d IN range(1, length({digits}) + 1)]) % 10 = 0)"
    )


# DuckDB's \\b knows ASCII letters only. For the digit passes every other letter
# is set between two ASCII ones, so a boundary falls where Unicode has it.
_WRAP = "regexp_replace({}, '([^\\P{{L}}A-Za-z])', 'z' || chr(2) || '\\1' || chr(3) || 'z', 'g')"
_UNWRAP = "replace(replace({}, 'z' || chr(2), ''), chr(3) || 'z', '')"


def redaction_ctes(source: str, key: str, text: str, prefix: str = "r") -> str:
    """Chained passes r1..r5 over (key, text); DuckDB SQL with counts n1..n5."""
    card = _q(PATTERNS["credit_card"])
    out = [f"{prefix}0 AS (SELECT {key}, {text} AS t FROM {source})"]
    for k, kind in enumerate(PII_TYPES, 1):
        carried = "".join(f", n{i}" for i in range(1, k))
        prev = f"{prefix}{k - 1}"
        mark = f"'[REDACTED:{kind}]'"
        if kind == "credit_card":
            out.append(
                f"{prefix}m AS (SELECT {key}{carried}, t, regexp_extract_all(t, {card}) AS ms, "
                f"string_split_regex(t, {card}) AS ps FROM {prev})"
            )
            out.append(
                f"{prefix}{k} AS (SELECT {key}{carried}, "
                f"CAST(len([m FOR m IN ms IF {_luhn('m')}]) AS BIGINT) AS n{k}, "
                f"array_to_string([concat(ps[i], CASE WHEN i > len(ms) THEN '' WHEN {_luhn('ms[i]')} THEN {mark} "
                f"ELSE ms[i] END) FOR i IN range(1, len(ps) + 1)], '') AS t FROM {prefix}m)"
            )
        else:
            p = _q(PATTERNS[kind])
            replaced = f"regexp_replace(t, {p}, {mark}, 'g')"
            if kind == "email":
                replaced = _WRAP.format(replaced)
            if kind == PII_TYPES[-1]:
                replaced = _UNWRAP.format(replaced)
            out.append(
                f"{prefix}{k} AS (SELECT {key}{carried}, CAST(len(regexp_extract_all(t, {p})) AS BIGINT) AS n{k}, "
                f"{replaced} AS t FROM {prev})"
            )
    return ", ".join(out)


NAMED_COUNTS = ", ".join(f"n{k} AS {t}" for k, t in enumerate(PII_TYPES, 1))


def _redacted(df, key, text):
    out = redact_columns(df.select(*key, text), [text], counts="n")
    return out.select(*key, F.col(text).alias("redacted"), *[F.col(f"n.{t}") for t in PII_TYPES])


@query(
    "pii_redact_documents",
    f"WITH {redaction_ctes('documents', 'doc_id', 'text')} SELECT doc_id, t AS redacted, {NAMED_COUNTS} FROM r5",
)
def pii_redact_documents(spark, sf_dir):
    return _redacted(use_all_cores(table(spark, sf_dir, "documents")), ["doc_id"], "text")


@query(
    "pii_redact_pages",
    f"WITH {redaction_ctes('pages', 'page_id', 'html')} SELECT page_id, t AS redacted, {NAMED_COUNTS} FROM r5",
)
def pii_redact_pages(spark, sf_dir):
    return _redacted(use_all_cores(table(spark, sf_dir, "pages")), ["page_id"], "html")


@query(
    "pii_redact_conversations",
    f"WITH {redaction_ctes('conversations', 'conv_id, turn', 'text')} "
    f"SELECT conv_id, turn, t AS redacted, {NAMED_COUNTS} FROM r5",
)
def pii_redact_conversations(spark, sf_dir):
    return _redacted(use_all_cores(table(spark, sf_dir, "conversations")), ["conv_id", "turn"], "text")


@query(
    "pii_counts_by_lang",
    f"WITH {redaction_ctes('documents', 'lang', 'text')} SELECT lang, "
    + ", ".join(f"CAST(sum(n{k}) AS BIGINT) AS {t}" for k, t in enumerate(PII_TYPES, 1))
    + " FROM r5 GROUP BY lang",
)
def pii_counts_by_lang(spark, sf_dir):
    rows = redact_columns(use_all_cores(table(spark, sf_dir, "documents")).select("lang", "text"), ["text"], counts="n")
    return rows.groupBy("lang").agg(*[F.sum(f"n.{t}").alias(t) for t in PII_TYPES])


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS pii_type, CAST(sum(n{k}) AS BIGINT) AS hits, "
    f"count(*) FILTER (WHERE n{k} > 0) AS rows_hit, min(t) FILTER (WHERE n{k} > 0) AS sample_value FROM {p}5"
    for c, p in (("text", "a"), ("lang", "b"), ("source", "c"))
    for k, t in enumerate(PII_TYPES, 1)
)


@query(
    "pii_profile_documents",
    f"WITH {redaction_ctes('documents', 'doc_id', 'text', 'a')}, {redaction_ctes('documents', 'doc_id', 'lang', 'b')}, "
    f"{redaction_ctes('documents', 'doc_id', 'source', 'c')} SELECT * FROM ({_PROFILE}) WHERE hits > 0",
)
def pii_profile_documents(spark, sf_dir):
    return pii_profile(use_all_cores(table(spark, sf_dir, "documents")), ["text", "lang", "source"])


@query(
    "pii_totals_documents",
    f"WITH {redaction_ctes('documents', 'doc_id', 'text')} SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS pii_type, CAST(sum(n{k}) AS BIGINT) AS hits FROM r5" for k, t in enumerate(PII_TYPES, 1)
    )
    + ") WHERE hits > 0",
)
def pii_totals_documents(spark, sf_dir):
    docs = use_all_cores(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return total_counts(redact(docs, counts="n"), "n")


@query(
    "pii_nested_rows",
    f"""WITH {redaction_ctes('documents', 'doc_id, lang, source', 'text')}
    SELECT doc_id, t AS inner_text, concat(t, '|', source) AS list_text, t AS map_value, lang AS map_key,
      {', '.join(f'3 * n{k} AS {t}' for k, t in enumerate(PII_TYPES, 1))} FROM r5""",
)
def pii_nested_rows(spark, sf_dir):
    docs = use_all_cores(table(spark, sf_dir, "documents"))
    nested = docs.select(
        "doc_id",
        F.struct("text", "lang").alias("body"),
        F.array("text", "source").alias("items"),
        F.create_map("lang", "text").alias("by_lang"),
    )
    out = redact(nested, counts="n")
    return out.select(
        F.try_variant_get("doc_id", "$", "bigint").alias("doc_id"), F.col("body.text").alias("inner_text"), F.array_join("items", "|").alias("list_text"),
        F.map_values("by_lang")[0].alias("map_value"), F.map_keys("by_lang")[0].alias("map_key"),
        *[F.col(f"n.{t}") for t in PII_TYPES],
    )


_CARD_NUMBER = "1000000000000000 + o_orderkey * 7919 + o_custkey"


@query(
    "pii_numeric_columns",
    f"""SELECT o_orderkey, CASE WHEN {_luhn(f'CAST({_CARD_NUMBER} AS VARCHAR)')} THEN '[REDACTED:credit_card]'
      ELSE CAST({_CARD_NUMBER} AS VARCHAR) END AS account FROM orders""",
)
def pii_numeric_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_CARD_NUMBER).alias("account"))
    return redact(orders).select(F.try_variant_get("o_orderkey", "$", "bigint").alias("o_orderkey"), F.col("account").cast("string").alias("account"))


_IS_CARD = _luhn(f"CAST({_CARD_NUMBER} AS VARCHAR)")


@query(
    "pii_numbers_by_row",
    f"""SELECT CASE WHEN {_IS_CARD} THEN 'STRING' ELSE 'BIGINT' END AS kind, count(*) AS numbers,
      CAST(sum(CASE WHEN {_IS_CARD} THEN 1 ELSE 0 END) AS BIGINT) AS cards,
      CAST(sum(CASE WHEN {_IS_CARD} THEN 0 ELSE ({_CARD_NUMBER}) % 1000 END) AS BIGINT) AS kept
    FROM orders GROUP BY 1""",
)
def pii_numbers_by_row(spark, sf_dir):
    """Numbers and marks side by side in one column: numbers stay numbers, row by row."""
    orders = table(spark, sf_dir, "orders").select(F.expr(_CARD_NUMBER).alias("account"))
    out = redact(orders, counts="n").withColumn("kind", F.expr("schema_of_variant(account)"))
    kept = F.coalesce(F.when(F.col("kind") == "BIGINT", F.try_variant_get("account", "$", "bigint")) % 1000, F.lit(0))
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("numbers"), F.sum("n.credit_card").alias("cards"), F.sum(kept).alias("kept"))


@query(
    "luhn_numbers",
    f"""SELECT l_orderkey % 2 = 0 AS even_order, count(*) AS numbers,
      count(*) FILTER (WHERE {_luhn("CAST(4000000000000 + l_orderkey * 100003 + l_partkey AS VARCHAR)")}) AS valid
      FROM lineitem GROUP BY 1""",
)
def luhn_numbers(spark, sf_dir):
    n = F.expr("CAST(4000000000000 + l_orderkey * 100003 + l_partkey AS STRING)")
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 2 == 0).alias("even_order")).agg(
        F.count(F.lit(1)).alias("numbers"), F.count_if(luhn_ok(n)).alias("valid")
    )


@query(
    "free_text_hygiene",
    f"WITH {redaction_ctes('documents', 'doc_id', 'text')} SELECT doc_id, t AS note FROM r5",
)
def free_text_hygiene(spark, sf_dir):
    return use_all_cores(table(spark, sf_dir, "documents")).select("doc_id", redact_free_text("text").alias("note"))
