"""Golden strings, whole-text recomputation and nested shapes."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import pii
from lakewarden.functions.text import python_float_text
from lakewarden.operators.redact import as_numbers, numeric_hits, redact, redact_free_text

CARD = list(pii.PII_TYPES).index("credit_card")

GOLDEN = {
    "contact alice@example.com now": "contact [REDACTED:email] now",
    "SSN: 123-45-6789": "SSN: [REDACTED:ssn]",
    "call (617) 555-1234 or 617-555-9876": "call ([REDACTED:phone] or [REDACTED:phone]",
    "card 4532015112830366 vs 1234567812345678": "card [REDACTED:credit_card]vs 1234567812345678",
    "host 192.168.1.100 responded": "host [REDACTED:ipv4] responded",
    "nothing sensitive here": "nothing sensitive here",
    "é123-45-6789": "é123-45-6789",
    "[REDACTED:ipv4] 1.2.3.4 [REDACTED:": "[REDACTED:ipv4] [REDACTED:ipv4] [REDACTED:",
}


def by_hand(text):
    counts = []
    for kind, pattern in pii.PATTERNS.items():
        hits = 0

        def swap(m):
            nonlocal hits
            if kind == "credit_card" and not pii._luhn(m[0]):
                return m[0]
            hits += 1
            return pii.token(kind)

        text = re.sub(pattern, swap, text)
        counts.append(hits)
    return text, counts


def test_golden_strings(spark):
    df = spark.createDataFrame([(k,) for k in GOLDEN], "raw string")
    rows = df.select("raw", pii.redact_text("raw").alias("out")).collect()
    expected = {k: by_hand(k)[0] for k in GOLDEN}
    assert {r.raw: r.out for r in rows} == expected
    assert expected["contact alice@example.com now"] == GOLDEN["contact alice@example.com now"]
    assert {k: expected[k] for k in list(GOLDEN)[3:]} == {k: GOLDEN[k] for k in list(GOLDEN)[3:]}


def test_whole_documents_match_recomputation(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", F.col("text").alias("raw"))
    for r in pii.redact_columns(docs, ["text"], counts="n").collect():
        assert (r.text, list(r.n)) == by_hand(r.raw)


def test_redaction_is_idempotent(spark, sf_dir):
    once = spark.read.parquet(f"{sf_dir}/documents.parquet").select(pii.redact_text("text").alias("a"))
    assert once.filter(pii.redact_text("a") != F.col("a")).count() == 0


def test_no_python_in_the_redaction_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    plan = pii.redact_columns(docs, ["text"], counts="n")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_nested_values_and_keys(spark):
    schema = "user struct<email:string,name:string>, notes array<string>, by_mail map<string,int>, active boolean, n int"
    df = spark.createDataFrame(
        [({"email": "bob@corp.io", "name": "Bob"}, ["ip is 10.0.0.1", None], {"a@x.com": 1, "b@x.com": 2}, True, 42)], schema
    )
    row = redact(df, counts="c").first()
    assert row.user.email == "[REDACTED:email]" and row.user.name == "Bob"
    assert row.notes == ["ip is [REDACTED:ipv4]", None]
    assert row.by_mail == {"[REDACTED:email]": 2}  # the later of two equal keys
    assert row.active is True and row.n == 42
    assert row.c.asDict() == {"email": 3, "ssn": 0, "phone": 0, "credit_card": 0, "ipv4": 1}


def said(v):
    return v.toPython() if hasattr(v, "toPython") else v


def test_numbers_turn_to_text_only_on_a_hit(spark):
    df = spark.createDataFrame([(4532015112830366, 7, 3.14), (5, 8, 4532015112830366.0), (None, None, None)], "card bigint, n int, x double")
    out = redact(df, counts="c")
    assert dict(out.dtypes) | {"c": ""} == {"card": "variant", "n": "int", "x": "variant", "c": ""}
    rows = out.collect()
    assert [said(r.card) for r in rows] == ["[REDACTED:credit_card]", 5, None]
    assert [said(r.x) for r in rows] == [3.14, "[REDACTED:credit_card].0", None]
    assert [r.c.credit_card for r in rows] == [1, 1, 0]
    back = as_numbers(out.drop("c"), df.schema)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert [tuple(r) for r in back.collect()] == [(None, 7, 3.14), (5, 8, None), (None, None, None)]


def test_rules_for_numbers(spark):
    df = spark.createDataFrame([(4532015112830366, 7), (5, 8)], "card bigint, n int")
    of = lambda rule: [tuple(r) for r in redact(df, numeric=rule).collect()]
    assert of("null") == [(None, 7), (5, 8)] and redact(df, numeric="null").dtypes == df.dtypes
    assert of("string") == [("[REDACTED:credit_card]", "7"), ("5", "8")]
    assert of("skip") == [tuple(r) for r in df.collect()]
    with pytest.raises(ValueError):
        redact(df, numeric="probe")


def test_the_type_follows_from_the_schema_alone(spark):
    """No rows, and a stream's schema, give the types that rows give; nothing runs to find them."""
    schema = "a tinyint, b int, c bigint, d decimal(12,2), e decimal(13,0), f decimal(20,14), g float, h array<bigint>, i map<bigint,bigint>, j struct<k:bigint,l:int>"
    got = dict(redact(spark.createDataFrame([], schema)).dtypes)
    assert got == {
        "a": "tinyint", "b": "int", "c": "variant", "d": "decimal(12,2)", "e": "variant", "f": "variant", "g": "variant",
        "h": "array<variant>", "i": "map<string,variant>", "j": "struct<k:variant,l:int>",
    }


def test_one_scan_and_no_job(spark, tmp_path):
    spark.range(10).selectExpr("id AS card", "'a@b.co' AS mail").write.parquet(str(tmp_path / "t"))
    out = redact(spark.read.parquet(str(tmp_path / "t")), counts="c")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan and "Exchange" not in plan


def test_guard_lets_no_card_through(spark):
    """The cheap condition before printing agrees with printing every number."""
    rng = random.Random(5)
    cards = [4532015112830366, 4000000000006, 4222222222222, 378282246310005, 5105105105105100, 999999999999, 10**12, -4222222222222]
    doubles = [float(c) for c in cards] + [c / 10**k for c in cards for k in range(1, 24)] + [rng.random() * 10 ** rng.randint(-20, 20) for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in doubles], "x double").select("x", numeric_hits(F.col("x"), T.DoubleType()).alias("n")).collect()
    assert [(r.x, r.n) for r in got] == [(v, by_hand(repr(v))[1][CARD]) for v in doubles]
    whole = cards + [rng.randint(-(10**17), 10**17) for _ in range(2000)]
    got = spark.createDataFrame([(v,) for v in whole], "x bigint").select("x", numeric_hits(F.col("x"), T.LongType()).alias("n")).collect()
    assert [(r.x, r.n) for r in got] == [(v, by_hand(str(v))[1][CARD]) for v in whole]


def test_numbers_inside_arrays(spark):
    df = spark.createDataFrame([([4532015112830366, -4532015112830366, 3],)], "a array<bigint>")
    row = redact(df, counts="c").first()
    assert [said(v) for v in row.a] == ["[REDACTED:credit_card]", "-[REDACTED:credit_card]", 3] and row.c.credit_card == 2


def test_number_text_matches_python(spark):
    values = [0.0, -0.0, 1.5, 1e7, 12345678.5, -2.5e-4, 0.00012345, 1e15, 1e16, 1e-5, 1e22, 123456789.123, float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", python_float_text(F.col("x")).alias("s"))
    assert [r.s for r in rows.collect()] == [repr(v) for v in values]


def test_numeric_redaction_equals_text_redaction(spark):
    values = [4532015112830366.5, 0.4532015112830366, 1234.4532015112830, 1e16, 453201511283036.0]
    rows = redact(spark.createDataFrame([(v,) for v in values], "x double"), numeric="string").collect()
    assert [r.x for r in rows] == [by_hand(repr(v))[0] for v in values]


def test_column_names_are_redacted(spark):
    df = spark.createDataFrame([(1, 2)], T.StructType([T.StructField(n, T.IntegerType()) for n in ("a@b.co", "plain")]))
    assert redact(df).columns == ["[REDACTED:email]", "plain"]


def test_free_text_is_cut_then_redacted(spark):
    row = spark.createDataFrame([("x" * 490 + " a@example.com",)], "t string").select(redact_free_text("t", 500).alias("t")).first()
    assert row.t == "x" * 490 + " a@example"


def test_free_text_is_whole_by_default(spark):
    row = spark.createDataFrame([("x" * 900 + " a@example.com",)], "t string").select(redact_free_text("t").alias("t")).first()
    assert row.t == "x" * 900 + " [REDACTED:email]"


def test_nested_texts_are_redacted_once(spark):
    """Counts come from the redacted values, merged map entries and old marks included."""
    schema = "user struct<email:string,name:string>, notes array<string>, by_mail map<string,struct<a:string,b:bigint>>, t string"
    rows = [
        ({"email": "bob@corp.io", "name": "[REDACTED:email] 123-45-6789"}, ["10.0.0.1 and 4532015112830366", None, "a@b.co [REDACTED:ssn"],
         {"a@x.com": {"a": "555-123-4567", "b": 4532015112830366}, "b@x.com": {"a": "x", "b": 1}}, "c@d.io"),
        (None, None, None, None),
        ({"email": None, "name": "plain"}, [], {}, "plain"),
    ]
    out = redact(spark.createDataFrame(rows, schema), counts="c")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[REDACTED:phone]") <= 3 + 7  # one pass for each nested column, flat texts and counts
    got = out.collect()
    assert [tuple(r.c) for r in got] == [(5, 1, 1, 2, 1), (0,) * 5, (0,) * 5]
    assert got[0].user.name == "[REDACTED:email] [REDACTED:ssn]" and got[0].notes[2] == "[REDACTED:email] [REDACTED:ssn"
    assert list(got[0].by_mail) == ["[REDACTED:email]"] and got[0].by_mail["[REDACTED:email]"].a == "x"
    assert got[1].user is None and got[1].notes is None and got[1].by_mail is None and got[2].user.name == "plain"
