"""The corpus pipeline: documents in, packed sequences out.

Each stage reads what the one before kept, written as Parquet in shared storage. All
columns of documents, and any others, pass through up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import decontaminate, near_dups, packing, secrets, toxicity
from lakewarden.llm.common import discard, scratch, shared_folder, stored, table, without
from lakewarden.llm.queries import tokenizer_path, toxicity_model


def _whole(docs: DataFrame, **beside: Column) -> DataFrame:
    """Rows as one struct, so that helper columns never clash with those of the input."""
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    return docs.select(doc, *(c.alias(name) for name, c in beside.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    score = toxicity.score_of(toxicity_model(spark, docs, sf_dir), spark)
    return _whole(docs, score=score(F.col("text"))).filter("score < 0.5").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that with the smallest doc_id (rows
    without one come last). Rows are told apart by an id of their own, so rows that repeat
    a doc_id, or have none, go only as near copies; texts without words all stay."""
    own = _whole(docs, row=F.monotonically_increasing_id(), tie=F.xxhash64("text"))
    rows = stored(own, "pipeline-rows")  # written once, so that every use sees the same ids
    keyed = rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))
    groups = near_dups.near_duplicates(keyed, percent=80).select(F.col("doc_id").alias("row"), "component_id")
    doc_id = F.col("doc.doc_id").cast("long")
    order = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), "tie", "row")
    leads = groups.join(rows.select("row", order.alias("order")), "row").groupBy("component_id").agg(F.min("order").alias("lead"))
    leads = stored(leads.select("lead.row"), "leads")
    # ids alone say which rows go, so that texts of the others stay where they are
    dropped = stored(rows.select("row").join(leads, "row", "left_anti"), "dropped-rows")
    return without(rows, dropped, "row").select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; that depends on the text alone,
    so texts are met by their hash and rows that share a doc_id are judged each on its own."""
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = decontaminate.hits(keyed, table(spark, sf_dir, "benchmark"))
    leaked = stored(found.filter("contaminated").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return without(_whole(docs, key=F.xxhash64("text")), leaked, "key").select("doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document cut and packed into sequences of 1024 ids."""
    # a smaller word cache than a job of its own has: the workers have served other stages before
    return packing.pack(docs, tokenizer_path(), cache_size=100_000, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]
#: Stages learn models and cut token ids, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again. Once it is, the
    tables that led to it are deleted, those of the stage and the result before."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = shared_folder(spark, name.replace(" ", "-"))
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(folder)
        docs = spark.read.schema(result.schema).parquet(folder)
        if before is not None:
            discard(spark, before)
        before = folder
    return docs
