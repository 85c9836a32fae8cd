"""Files, payloads, gates and JDBC options."""

import json
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lakewarden.sources import drive, files, jdbc, records, rest, sqltext, tickets, wiki


def test_ragged_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,age\nAnn,30\nBob\nCid,40,x,"y\nz"\n\n"Q ""q""",\n')
    rows = files.read_csv_rows(spark, str(tmp_path)).collect()
    got = {r.name: (r.age, r._extra) for r in rows}
    assert got == {"Ann": ("30", None), "Bob": (None, None), "Cid": ("40", ["x", "y\nz"]), 'Q "q"': ("", None)}


def test_listing_and_text(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "note.md").write_text("hello\nworld")
    (tmp_path / "b.csv").write_text("x\n1\n")
    (tmp_path / "c.bin").write_text("?")
    listed = files.list_files(spark, str(tmp_path))
    assert [(r.name, r.kind) for r in listed.collect()] == [("b.csv", "csv"), ("c.bin", None), ("sub/note.md", "text")]
    assert [r.table for r in files.document_tables(listed).collect()] == ["b.csv", "sub/note.md"]
    assert files.read_text_documents(spark, str(tmp_path / "sub"), max_chars=5).first().content == "hello"


@pytest.mark.parametrize(("path", "inside"), [("a/b", True), ("../x", False), ("a/../../x", False), ("../srv2", False), ("../data/x", True), ("/etc", False), ("/srv/data", True)])
def test_root_guard(spark, path, inside):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(files.inside_root("p", "/srv/data")).first()[0] is inside


def test_rich_text(spark):
    node = {"type": "doc", "content": [
        {"type": "paragraph", "content": [{"type": "text", "text": "Water the ferns."}]},
        {"type": "paragraph", "content": [{"type": "text", "text": "Contact a@b.co."}, {"type": "rule"}]},
    ]}
    df = spark.createDataFrame([(json.dumps(node),), (None,)], "d string")
    assert [r[0] for r in df.select(tickets.rich_text("d")).collect()] == ["Water the ferns.\nContact a@b.co.", ""]


def test_markup(spark):
    df = spark.createDataFrame([("<p>Water the <ac:x>ferns</ac:x>.</p><p>Salt &amp; pepper.</p>",)], "m string")
    assert df.select(wiki.markup_text("m")).first()[0] == "Water the\nferns\n.\nSalt & pepper."


def test_pages_match_recomputation(spark, sf_dir):
    class Reader(HTMLParser):
        def handle_data(self, data):
            out.append(data)

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("html", wiki.markup_text("html", max_chars=None).alias("t")).collect()
    for r in rows:
        out = []
        reader = Reader(convert_charrefs=True)
        reader.feed(r.html)
        reader.close()
        assert r.t == "\n".join(x.strip() for x in out if x.strip())


@pytest.mark.parametrize(
    ("sql", "reads", "single"),
    [
        ("SELECT 1", True, True), ("  /* x */ -- y\n((select 1))", True, True), ("drop table t", False, True), ("select 1; drop table t", True, False),
        ("select ';' ;", True, True), ("select [a;b] /* ; /* ; */ ; */", True, True), ("/*! select */ select 1", False, True), ("with a as (select 1) select 1;;", True, False),
        ("select 'it''s; fine' -- ; end", True, True), ("selectx", False, True), ("select 1 ; -- done", True, True), ("select 'open ; ", True, True),
    ],
)
def test_statement_gates(spark, sql, reads, single):
    row = sqltext.gate_statements(spark.createDataFrame([(sql,)], "sql string")).first()
    assert (row.is_select, row.single_statement) == (reads, single)


def test_payload_rows(spark):
    bodies = ['[{"a":1},2,"x",null]', '{"a":3}', "oops", "5"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, payload string")
    rows = rest.payload_rows(df).select("i", "position", F.col("item").cast("string").alias("t")).collect()
    assert sorted((r.i, r.position, json.loads(r.t) if r.t.startswith("{") else r.t) for r in rows) == [
        (0, 0, {"a": 1}), (0, 1, {"value": 2}), (0, 2, {"value": "x"}), (0, 3, {"value": None}), (1, 0, {"a": 3}), (2, 0, {"content": "oops"}), (3, 0, "5"),
    ]


def test_folder_walk_refuses_cycles(spark):
    listing = spark.createDataFrame([("a", "root", "A", drive.FOLDER_MIME), ("b", "a", "B", drive.FOLDER_MIME), ("a", "b", "A", drive.FOLDER_MIME)],
                                    "id string, parent_id string, name string, mime string")
    with pytest.raises(ValueError, match="deeper"):
        drive.walk_folders(listing, "root", max_depth=5)


def test_page_ceiling(spark):
    pages = spark.createDataFrame([("s", i, "t", [json.dumps({"id": i})]) for i in range(4)], "source string, page_no int, next_token string, records array<string>")
    assert records.assemble_pages(pages, "$.id", max_pages=2).count() == 2
    assert records.assemble_pages(pages, "$.id").count() == 4


def test_jdbc_options():
    pg = jdbc.query_options("jdbc:postgresql://h/db", "SELECT 1 ;")
    assert pg["query"] == "SELECT 1" and pg["driver"] == "org.postgresql.Driver"
    ms = jdbc.query_options("jdbc:sqlserver://h", "WITH a AS (SELECT 1 x) SELECT * FROM a")
    assert ms["prepareQuery"] == "WITH a AS (SELECT 1 x)" and ms["query"] == "SELECT * FROM a"
    assert jdbc.table_options("jdbc:oracle:thin:@h", "T", "ID", 1, 9, 4)["numPartitions"] == "4"
    assert set(jdbc.CATALOG) == set(jdbc.DRIVERS)
    with pytest.raises(ValueError):
        jdbc.dialect_of("jdbc:other:x")


def test_texts_are_whole_by_default(spark, tmp_path):
    long = "y" * 150_000
    (tmp_path / "a.txt").write_text(long)
    assert files.read_text_documents(spark, str(tmp_path)).first().content == long
    df = spark.createDataFrame([(f"<p>{long}</p>", json.dumps({"type": "text", "text": long}), long)], "m string, d string, p string")
    row = df.select(wiki.markup_text("m").alias("m"), tickets.rich_text("d").alias("d")).first()
    assert row.m == long and row.d == long
    assert rest.payload_rows(df.select("p"), "p").select(F.variant_get("item", "$.content", "string")).first()[0] == long


def test_csv_suffix_in_any_case(spark, tmp_path):
    (tmp_path / "b.CSV").write_text("x\n1\n")
    assert [r.x for r in files.read_csv_rows(spark, str(tmp_path)).collect()] == ["1"]


def test_plain_and_broken_descriptions(spark):
    df = spark.createDataFrame([("just words",), ("{broken",), ('"quoted"',)], "d string")
    assert [r[0] for r in df.select(tickets.rich_text("d")).collect()] == ["just words", "{broken", "quoted"]


def test_strings_that_look_like_objects(spark):
    df = spark.createDataFrame([('{"a": "{urgent} fix", "b": {"link": "l", "value": "v"}, "c": {"link": "l"}, "d": null, "e": 7}',)], "payload string")
    assert records.flatten_json_records(df).first().record == {"a": "{urgent} fix", "b": "v", "c": "", "d": None, "e": "7"}


def test_records_without_an_id_are_all_kept(spark):
    pages = spark.createDataFrame(
        [("s", 0, "n", ['{"k": 1}', '{"id": 5}', '{"k": 2}']), ("s", 1, "", ['{"k": 1}', '{"id": 5}'])],
        "source string, page_no int, next_token string, records array<string>",
    )
    got = records.assemble_pages(pages, "$.id").collect()
    assert sorted((r.id or "", r.page_no, r.position) for r in got) == [("", 0, 0), ("", 0, 2), ("", 1, 0), ("5", 0, 1)]
