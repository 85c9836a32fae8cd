"""Rates, quota edges and busy moments."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import audit as A


@pytest.mark.parametrize("good", range(17))
def test_success_rate_rounds_like_the_binary_value(spark, good):
    rows = spark.range(16).select(F.lit("query").alias("action"), (F.col("id") < good).alias("success"))
    assert A.query_outcomes(rows).first().success_rate == round(good / 16, 3)


def test_no_queries_have_no_rate(spark):
    rows = spark.createDataFrame([("create", True)], "action string, success boolean")
    assert A.query_outcomes(rows).first().success_rate is None


@pytest.mark.parametrize("licensed", [False, True])
@pytest.mark.parametrize("cap", [0, 1, 7, 50, 500])
def test_quota_with_most_events_in_one_second(spark, cap, licensed):
    start = dt.datetime(2024, 1, 31, 23, 59, 50)
    rows = [(i, start + dt.timedelta(seconds=min(i // 20, 5), microseconds=i % 3), "query" if i % 4 else "query_metric") for i in range(400)]
    rows += [(1000 + i, dt.datetime(2024, 2, 1) + dt.timedelta(minutes=i), "query") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, timestamp timestamp, action string")
    got = {r.id: r.quota for r in A.classify_quota(df, cap=cap, licensed=licensed).collect()}
    seen, expected = {}, {}
    for i, at, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        n = seen[at.month] = seen.get(at.month, 0) + 1
        expected[i] = "allowed" if n <= cap else ("overage" if n == cap + 1 else "allowed") if licensed else "blocked"
    assert got == expected


def test_grace_and_degraded(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 6, 1)), (None, None)], "license_id string, expires_at timestamp")
    day = lambda d: A.entitlement_state(df, F.to_timestamp(F.lit(d))).orderBy(F.desc_nulls_last("license_id")).collect()
    assert [(r.expired, r.in_grace, r.degraded) for r in day("2024-06-15")] == [(True, True, False), (False, False, False)]
    assert [(r.expired, r.in_grace, r.degraded) for r in day("2024-07-15")] == [(True, False, True), (False, False, False)]
