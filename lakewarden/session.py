"""Session helpers shared by tests, the benchmark and jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, **extra: str) -> SparkSession:
    """A small local session with the settings a cluster job would carry."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lakewarden")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors reach. Only a local
    session without the setting gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            named = tempfile.mkdtemp(prefix="lakewarden-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so a result read by several branches is computed
    once and survives lost executors."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def use_all_cores(df: DataFrame) -> DataFrame:
    """Spread rows when the input has fewer splits than there are cores, for
    work that costs far more than moving its rows. Large inputs pass through."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
