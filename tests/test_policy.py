"""Decisions, masks and the governed session."""

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import audit
from lakewarden.operators import policy as P
from lakewarden.plans.governed import AccessDenied, GovernedSession, Identity, NotReadOnly, QuotaExceeded

SCHEMA = "name string, effect string, resource_id string, actions array<string>, subjects array<string>, mask_columns array<string>"


def policies(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def decide(spark, table, subject="k", admin=False, action="read", ds="d1", default_deny=False):
    rq = spark.createDataFrame([(subject, admin, action, ds)], "subject string, is_admin boolean, action string, datasource_id string")
    batch = P.decide(rq, table, default_deny=default_deny).first()
    single = P.decide_one(table, subject, action, ds, is_admin=admin, default_deny=default_deny).first()
    assert batch == single
    return batch


def test_deny_beats_allow_and_admin_bypasses(spark):
    table = policies(spark, ("a", "allow", "*", ["read"], ["*"], []), ("d", "deny", "d1", ["read"], ["k"], []))
    assert decide(spark, table).allowed is False
    assert decide(spark, table, ds="d2").allowed is True
    assert decide(spark, table, admin=True).allowed is True


def test_a_mask_is_no_allow(spark):
    table = policies(spark, ("m", "deny", "*", ["read"], ["*"], ["ssn"]))
    assert decide(spark, table).masked_columns == ["ssn"]
    assert decide(spark, table, default_deny=True).default_denied is True


def test_masks_accumulate_sorted(spark):
    table = policies(
        spark, ("m1", "deny", "*", ["read"], ["*"], ["ssn", "dob"]), ("m2", "deny", "d1", ["read"], ["k"], ["dob", "pay"]),
        ("null", "deny", "other", ["read"], ["k"], None),
    )
    assert decide(spark, table).masked_columns == ["dob", "pay", "ssn"]


def test_strip_masked_at_every_depth(spark):
    df = spark.sql(
        "SELECT 1 AS ID, 'n' AS Name, '9' AS SSN, named_struct('SSN', '1', 'ok', array(named_struct('ssn', '2', 'keep', 3))) AS detail, "
        "map('Ssn', 1, 'x', 2) AS m"
    )
    row = P.strip_masked(df, ["ssn", "name"]).first()
    assert row.asDict(recursive=True) == {"ID": 1, "detail": {"ok": [{"keep": 3}]}, "m": {"x": 2}}


@pytest.mark.parametrize(
    ("sql", "hit"),
    [
        ("SELECT ssn AS x FROM t", "ssn"), ('SELECT "SSN" FROM t', "ssn"), ("SELECT t.ssn FROM t", "ssn"),
        ("SELECT ssn_hash FROM t", None), ("SELECT id FROM t", None), ("SELECT 1 -- ssn", "ssn"), ("SELECT `home address`", "home address"),
    ],
)
def test_mask_gate(spark, sql, hit):
    df = spark.createDataFrame([(sql, ["SSN", "home address"])], "sql string, masks array<string>")
    assert df.select(P.named_mask(F.col("sql"), F.col("masks"))).first()[0] == hit


def test_decisions_keep_request_partitioning(spark):
    table = policies(spark, ("a", "allow", "*", ["read"], ["*"], []))
    rq = spark.range(1000).select(
        F.col("id").cast("string").alias("subject"), (F.col("id") == 3).alias("is_admin"),
        F.when(F.col("id") % 2 == 0, "read").otherwise("discover").alias("action"), F.col("id").cast("string").alias("datasource_id"),
    )
    plan = P.decide(rq, table)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def people(spark):
    return spark.createDataFrame(
        [(1, "Ann", "ann@example.com", "123-45-6789"), (2, "Bob", "bob@example.com", "987-65-4321")],
        "id int, name string, email string, ssn string",
    )


@pytest.fixture
def session(spark, tmp_path):
    table = policies(spark, ("m", "deny", "*", ["read"], ["*"], ["ssn"]), ("b", "deny", "crm", ["read"], ["blocked"], []))
    people(spark).write.parquet(str(tmp_path / "people"))
    governed = GovernedSession(spark, table, audit_path=str(tmp_path / "audit"))
    governed.register("crm", {"people": lambda s: s.read.parquet(str(tmp_path / "people"))})
    return governed


def test_governed_query_masks_redacts_and_counts(spark, session):
    result = session.query("crm", "SELECT * FROM people WHERE email = 'ann@example.com'", Identity("k"))
    rows = result.dataframe.collect()
    assert [r.asDict() for r in rows] == [{"id": 1, "name": "Ann", "email": "[REDACTED:email]"}]
    assert result.record() == {"email": 1}
    assert result.lineage["policy"] == {"masked_columns": ["ssn"]}
    assert "ann@" not in result.lineage["request"]["sql"]
    log = spark.read.parquet(session.audit_path)
    assert sorted(r.action for r in log.collect()) == ["query", "query_result"]


def test_redactions_are_read_from_a_session_log(spark, session):
    result = session.query("crm", "SELECT * FROM people", Identity("k"))
    result.dataframe.collect()
    assert result.record() == {"email": 2}
    log = spark.read.parquet(session.audit_path)
    assert [tuple(r) for r in audit.redactions_by_type(log).collect()] == [("email", 2)]
    older = spark.createDataFrame([("query", '{"pii_counts":{"email":3,"phone":1}}')], "action string, details string")
    both = audit.redactions_by_type(older.unionByName(log.select("action", "details")))
    assert sorted(tuple(r) for r in both.collect()) == [("email", 5), ("phone", 1)]


def test_governed_refusals(session):
    with pytest.raises(AccessDenied):
        session.query("crm", "SELECT id FROM people", Identity("blocked"))
    with pytest.raises(AccessDenied):
        session.query("crm", "SELECT ssn AS x FROM people", Identity("k"))
    with pytest.raises(NotReadOnly):
        session.query("crm", "DROP TABLE people", Identity("k"))
    with pytest.raises(NotReadOnly):
        session.query("crm", "SELECT 1; SELECT 2", Identity("k"))
    with pytest.raises(AccessDenied):
        session.query("crm", "SELECT id FROM people", Identity("k"), include_pii=True)


def test_files_cannot_be_named_from_sql(session, tmp_path):
    with pytest.raises(NotReadOnly, match="unknown relation"):
        session.query("crm", f"SELECT * FROM parquet.`{tmp_path}/people`", Identity("k")).dataframe.collect()


def test_view_mode_redacts_before_predicates(session):
    sql = "SELECT count(*) AS n FROM people WHERE email = 'ann@example.com'"
    assert session.query("crm", sql, Identity("k")).numbers().first().n == 1
    assert session.query("crm", sql, Identity("k"), mode="view").numbers().first().n == 0


def test_admin_raw_view(session):
    out = session.query("crm", "SELECT email, ssn FROM people ORDER BY id", Identity("root", True), include_pii=True)
    assert out.dataframe.first().email == "ann@example.com" and out.record() == {}


@pytest.mark.parametrize("sql", [
    "WITH a AS (SELECT * FROM people) INSERT OVERWRITE DIRECTORY '{path}' USING json SELECT * FROM a",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x FROM people",
    "SELECT * FROM global_temp.hidden", "SELECT * FROM default.people", "SELECT * FROM hidden_table",
    "SELECT id FROM people WHERE id IN (SELECT id FROM global_temp.hidden)",
    "SELECT (SELECT max(id) FROM global_temp.hidden) AS m FROM people",
    "SELECT * FROM IDENTIFIER('global_temp.hidden')", "SELECT * FROM json.`{path}`",
    "WITH a AS (SELECT java_method('java.lang.Math', 'abs', 1) AS x) SELECT * FROM a",
])
def test_only_reads_of_registered_views(spark, session, tmp_path, sql):
    spark.range(3).createOrReplaceGlobalTempView("hidden")
    with pytest.raises(NotReadOnly):
        session.query("crm", sql.replace("{path}", str(tmp_path / "out")), Identity("k"))
    assert not (tmp_path / "out").exists()
    log = spark.read.parquet(session.audit_path).collect()
    assert [(r.action, r.success) for r in log] == [("query", False)]


def test_reads_of_every_shape_pass(session):
    for sql in (
        "WITH a AS (SELECT id FROM people), b AS (SELECT id FROM a) SELECT count(*) AS n FROM b GROUP BY id HAVING count(*) > 0 ORDER BY n LIMIT 3",
        "SELECT id, row_number() OVER (ORDER BY id) AS k FROM people UNION ALL SELECT 1, 2",
        "SELECT p.id FROM people p LEFT JOIN people q ON p.id = q.id WHERE EXISTS (SELECT 1 FROM people r WHERE r.id = p.id)",
        "SELECT upper(name) AS u, x FROM people LATERAL VIEW explode(array(1, 2)) t AS x", "SELECT id FROM range(3)",
    ):
        session.query("crm", sql, Identity("k")).dataframe.collect()


def test_equal_names_and_bytes_and_variants(session):
    result = session.query("crm", "SELECT * FROM people p JOIN people q ON p.id = q.id", Identity("k"))
    rows = result.dataframe.collect()
    assert result.dataframe.columns.count("email") == 2 and rows and all("@" not in str(r) for r in rows)
    sql = """SELECT CAST(email AS BINARY) AS b, parse_json(to_json(struct(email))) AS v, array(CAST(email AS BINARY)) AS a,
        named_struct('v', parse_json(to_json(struct(email)))) AS s FROM people WHERE email IS NOT NULL"""
    result = session.query("crm", sql, Identity("k"))
    rows = result.dataframe.collect()
    assert rows and all("example.com" not in str(r) for r in rows)
    assert result.record()["email"] == 4 * len(rows)


def test_first_query_under_a_cap(session):
    session.monthly_cap = 1
    session.query("crm", "SELECT id FROM people", Identity("k"))
    with pytest.raises(QuotaExceeded):
        session.query("crm", "SELECT id FROM people", Identity("k"))


def test_monthly_quota(spark, session):
    session.query("crm", "SELECT id FROM people", Identity("k"))  # logged without a call by the user
    session.monthly_cap = 1
    with pytest.raises(QuotaExceeded):
        session.query("crm", "SELECT id FROM people", Identity("k"))
    session.licensed = True
    session.query("crm", "SELECT id FROM people", Identity("k"))
    overage = spark.read.parquet(session.audit_path).filter("action = 'license_overage'")
    assert overage.count() == 1


def test_metric_and_question_flow(spark, session):
    spec = "array<struct<name:string,type:string,default:string,has_default:boolean>>"
    metrics = spark.createDataFrame(
        [("m1", "people_by_name", "Number of people with a name", "crm", """{"sql": "SELECT id, email FROM people WHERE name = '{name}'"}""",
          [("name", "string", None, False)], "approved")],
        f"id string, name string, description string, datasource_id string, template string, params {spec}, status string",
    )
    result = session.run_metric(metrics, "m1", {"name": "Ann"}, Identity("k"))
    assert [r.id for r in result.dataframe.collect()] == [1]
    with pytest.raises(ValueError, match="disallowed"):
        session.run_metric(metrics, "m1", {"name": "a'b"}, Identity("k"))
    answered, routed = session.ask(metrics, "how many people by name 'Bob'?", Identity("k"))
    assert routed["answered"] and [r.id for r in answered.dataframe.collect()] == [2]
    nothing, why = session.ask(metrics, "weather tomorrow?", Identity("k"))
    assert nothing is None and why["reason"] == "no approved metric matches this question"


def test_card_numbers_of_a_result_are_redacted_row_by_row(spark, session):
    sql = "SELECT id, CASE WHEN id = 1 THEN 4532015112830366 ELSE id + 10 END AS account FROM people ORDER BY id"
    result = session.query("crm", sql, Identity("k"))
    got = [r.account.toPython() for r in result.dataframe.collect()]
    assert got[0] == "[REDACTED:credit_card]" and got[1:] == [r + 10 for r in range(2, 2 + len(got) - 1)]
    assert result.record() == {"credit_card": 1}
    assert [r.account for r in session.query("crm", sql, Identity("k")).numbers().collect()] == [None, *got[1:]]
    assert result.numbers().schema["account"].dataType == result.schema["account"].dataType
