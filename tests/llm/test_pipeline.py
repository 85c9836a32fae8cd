import os
from urllib.parse import urlparse

import corpus_pipeline
from lakewarden.llm import common
from pyspark.sql import functions as F


def test_rows_are_parted_by_a_bitmap(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("k"), F.lit("t").alias("text"))
    keys = spark.range(0, 2000, 7).select(F.col("id").alias("k")).filter("k % 10 > 0")
    wanted = {r["k"] for r in keys.collect()}
    for bits in (1 << 12, 1 << 26):  # a full bitmap lets rows through by chance, and loses none
        maybe, clear = ([r["k"] for r in part.collect()] for part in common.parted(rows, keys, "k", bits))
        assert len(maybe) + len(clear) == 2000 and wanted <= set(maybe) and not wanted & set(clear) and clear.count(None) == 200
    left = [r["k"] for r in common.without(rows, keys, "k").collect()]
    assert sorted(x or -1 for x in left) == sorted([x for x in range(2000) if x % 10 and x not in wanted] + [-1] * 200)
    assert common.without(rows, keys.limit(0), "k").count() == 2000


def test_only_rows_that_a_bitmap_hits_are_shuffled(spark, tmp_path):
    rows = spark.range(1000).withColumn("text", F.lit("t"))
    rows.write.parquet(str(tmp_path / "rows"))
    _, clear = common.parted(spark.read.parquet(str(tmp_path / "rows")), spark.range(5), "id")
    plan = clear._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Python" not in plan


def test_a_run_leaves_its_result_only(spark, sf_dir):
    root = urlparse(os.path.dirname(common.shared_folder(spark, "probe"))).path
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    rows = corpus_pipeline.run(spark, sf_dir)
    made = {x for x in os.listdir(root) if x not in before}
    assert len(made) == 1 and next(iter(made)).startswith("packing-")
    assert rows.count() and "ids" not in rows.columns
