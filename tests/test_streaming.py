"""The same operators on streams."""

import datetime as dt

from lakewarden.operators import audit as A
from lakewarden.streaming.governed_stream import audit_rollup, decided_stream, governed_stream, land


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_rows_are_masked_and_redacted_before_landing(spark, tmp_path):
    spark.sql("SELECT 1 AS id, 'a@b.co' AS mail, 's' AS ssn").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, mail string, ssn string").parquet(str(tmp_path / "in"))
    assert [r.asDict() for r in drain(governed_stream(stream, ["SSN"]), "landed", tmp_path)] == [{"id": 1, "mail": "[REDACTED:email]"}]


def test_rollup_and_decisions(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 0, 0, 30)
    rows = [(i, at + dt.timedelta(minutes=20 * (i // 3)), "query", "datasource", "d", "k", "d", '{"pii_counts":{"email":2}}', i != 0) for i in range(6)]
    spark.createDataFrame(rows, A.AUDIT_SCHEMA).write.parquet(str(tmp_path / "audit"))
    stream = spark.readStream.schema(A.AUDIT_SCHEMA).parquet(str(tmp_path / "audit"))
    (first,) = [r for r in drain(audit_rollup(stream), "rolled", tmp_path) if r.window_start.minute == 0]
    assert (first.events, first.failed, first.redactions) == (3, 1, 6)
    policies = spark.sql("SELECT 'd' AS name, 'deny' AS effect, '*' AS resource_id, array('read') AS actions, array('k') AS subjects, CAST(NULL AS array<string>) AS mask_columns")
    asked = stream.selectExpr("api_key_id AS subject", "false AS is_admin", "'read' AS action", "datasource_id")
    assert {r.allowed for r in drain(decided_stream(asked, policies), "decided", tmp_path)} == {False}


def test_streams_redact_numbers_as_batches_do(spark, tmp_path):
    spark.sql("SELECT 1 AS id, 4532015112830366 AS card UNION ALL SELECT 2, 17").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, card bigint").parquet(str(tmp_path / "in"))
    rows = drain(governed_stream(stream, []), "numbers", tmp_path)
    assert {r.id: r.card.toPython() for r in rows} == {1: "[REDACTED:credit_card]", 2: 17}


def test_landing_goes_on_where_it_stopped(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    write = lambda a, b: spark.range(a, b).selectExpr("id AS k", "concat('a', id, '@b.co') AS mail").write.mode("append").parquet(source)
    write(0, 5)
    stream = spark.readStream.schema("k bigint, mail string").parquet(source)
    assert land(governed_stream(stream, [], numeric="null"), path).count() == 5
    assert land(governed_stream(stream, [], numeric="null"), path).count() == 5
    write(5, 9)
    rows = land(governed_stream(stream, [], numeric="null"), path).collect()
    assert sorted(r.k for r in rows) == list(range(9)) and {r.mail for r in rows} == {"[REDACTED:email]"}


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    start = dt.datetime(2024, 1, 1)

    def write(*minutes):
        rows = [(m, start + dt.timedelta(minutes=m), "query", "datasource", "d", "k", "d", None, True) for m in minutes]
        spark.createDataFrame(rows, A.AUDIT_SCHEMA).write.mode("append").parquet(source)

    write(0, 1, 30)
    stream = spark.readStream.schema(A.AUDIT_SCHEMA).parquet(source)
    assert {(r.window_start.minute, r.events) for r in land(audit_rollup(stream), path).collect()} == {(0, 1), (1, 1)}
    write(1, 25, 60)  # 1 is behind 30 - 10, 25 is not
    got = land(audit_rollup(stream), path).collect()
    assert sorted((r.window_start.minute, r.events) for r in got) == [(0, 1), (1, 1), (25, 1), (30, 1)]
