import base64
import hashlib

from lakewarden.llm import warc
from lakewarden.llm.common import shared_folder
from lakewarden.llm.queries import QUERIES

EXTRA = "page_id long, url string, html string, sha256 string, slot string, copies string, header string"


def expected(rows, min_bytes=0):
    last = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        last[body] = max(last.get(body, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        lead = last[body] == page_id or len(body) < min_bytes
        out.append((page_id, len(body), digest, "response" if lead else "revisit", None if lead else last[body]))
    return sorted(out)


def said(df):
    return sorted(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def archive(spark, rows, **options):
    path = shared_folder(spark, "test-warc")
    frame = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], EXTRA)
    warc.write_archive(frame, path, **options)
    return path


def test_op3(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert said(QUERIES["op3_warc"](spark, sf_dir)) == expected(rows)


def test_messy_pages(spark):
    rows = [(1, "http://a", "<p>é</p>"), (9, "http://b", "<p>é</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "c", "z" * 200_000), (6, "d", "z" * 200_000)]
    path = archive(spark, rows)
    assert said(warc.page_records(spark, path)) == expected(rows)
    small = archive(spark, rows, min_bytes=100)
    assert said(warc.page_records(spark, small)) == expected(rows, 100)


def test_line_ends_in_urls_make_no_header(spark):
    ends = ["\u2028", "\u2029", "\x85", "\r", "\n", "\x0b", "\x0c"]
    lines = ["WARC-Refers-To: <urn:lakewarden:page:7>", "WARC-Payload-Digest: sha1:AAAA", "WARC-Type: revisit", "WARC-Record-ID: <urn:lakewarden:page:99>"]
    rows = [(100 + i, f"http://a/{e}{line}", f"body {i}") for i, (e, line) in enumerate((e, line) for e in ends for line in lines)]
    path = archive(spark, rows)
    assert said(warc.page_records(spark, path)) == expected(rows)
    urls = {r["page_id"]: r["target_uri"] for r in warc.read_headers(spark, path).collect()}
    assert urls == {p: u.replace("\r", "%0D").replace("\n", "%0A") for p, u, _ in rows}


def test_records_are_rebuilt(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c", "other\r\n\r\n")]
    path = archive(spark, rows)
    assert spark.read.parquet(f"{path}/payloads").count() == 2
    for r in warc.read_records(spark, path).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        page = {p: (u, h) for p, u, h in rows}[r["page_id"]]
        assert bytes(r["payload"]) == page[1].encode() and r["target_uri"] == page[0]
        block = page[1].encode() if r["record_type"] == "response" else b""
        assert rest == block + b"\r\n\r\n" and f"Content-Length: {len(block)}".encode() in head


def test_repeated_rows_and_ids(spark):
    path = archive(spark, [(7, "u", "p"), (7, "u", "p"), (7, "v", "p"), (None, "u", "p"), (None, None, "q")])
    got = said_unsorted(warc.page_records(spark, path))
    assert got.count((7, "response", None)) == 1 and got.count((7, "revisit", 7)) == 2
    assert got.count((None, "revisit", 7)) == 1 and got.count((None, "response", None)) == 1
    assert spark.read.parquet(f"{path}/payloads").count() == 2


def said_unsorted(df):
    return [(r["page_id"], r["record_type"], r["refers_to"]) for r in df.collect()]


def test_no_pages(spark):
    assert warc.page_records(spark, archive(spark, [])).count() == 0
