import pytest

#: Columns whose names helpers of the operators use as well.
CLASHING = ["row", "score", "key", "tie", "doc", "part", "bucket", "id", "h", "n", "text_key", "spans", "lang_pred", "words", "slot", "first"]


@pytest.fixture(scope="session")
def messy(spark):
    """Builds documents with nulls, empty texts, repeated rows and clashing columns."""

    def build(rows, **more):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        names = [c for c in CLASHING if c not in more]
        rows = [(*r, "en", None, None)[:5] if len(r) < 5 else r for r in rows]
        rows = [(*r, *([None] * len(names))) for r in rows]
        return spark.createDataFrame(rows, schema + "".join(f", `{c}` string" for c in names))

    return build


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """(doc_id, text) of the smallest documents table, by id."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return dict(sorted((r["doc_id"], r["text"]) for r in rows))
