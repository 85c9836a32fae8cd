"""What the corpus operators share: inputs, shared storage and fixed-size bitmaps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, and every ASCII byte that is no letter or digit to a space.
PLAIN_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)
#: A-Z to a-z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made within each ``scratch`` that is open, the innermost last.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders of ``shared_folder`` made inside are deleted at the end: what is to stay is
    written to a folder made before."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
        for folder in made:
            discard(spark, folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete one folder that ``shared_folder`` made."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors reach. Only
    a local session may lack the setting; it gets a temporary folder."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="lakewarden-llm-")
        context.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to shared storage and read again: computed once, cut
    from their lineage, and safe when executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits (a power of two) with the bit of every key set,
    as bytes; its size does not depend on the keys. Spark sets the bits: the
    driver receives one 64-bit word per non-empty word of the bitmap at most."""
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = (
        keys.select(slot.alias("slot"))
        .select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, CAST(slot & 63 AS INT))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    out = np.zeros(bits // 64, dtype="<i8")
    for row in words.toLocalIterator():
        out[row["word"]] = row["bits"]
    return out.view(np.uint8)


def in_bitmap(bitmap_bytes: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which keys (unsigned 64-bit) have their bit set."""
    slot = keys & np.uint64(bits - 1)
    return (bitmap_bytes[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def parted(rows: DataFrame, keys: DataFrame, key: str, bits: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` may be among ``keys``, and the rows whose key is not: a few of the
    first for chance, none of the second. Nothing is shuffled but bits of the keys, and a
    null key is not among them. The bitmap is broadcast; its size (8 MB) is fixed by
    ``bits``, a power of two."""
    slot = F.xxhash64(key).bitwiseAND(F.lit(bits - 1))
    words = (
        keys.filter(F.col(key).isNotNull()).select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"))
    )
    filled = F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(63)), "bits")))
    blocks = words.groupBy(F.shiftright("word", 6).alias("__block")).agg(filled.alias("__words"))
    side = F.broadcast(stored(blocks, "key-bits"))  # bits / 4096 rows of 64 words at most
    met = rows.join(side, F.shiftright(slot, 12) == F.col("__block"), "left")
    word = F.col("__words")[F.shiftright(slot, 6).bitwiseAND(F.lit(63))]
    hit = F.coalesce(F.getbit(word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False)) & F.col(key).isNotNull()
    both = met.withColumn("__hit", hit).drop("__block", "__words")
    return both.filter("__hit").drop("__hit"), both.filter("NOT __hit").drop("__hit")


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is not among ``keys``, which hold each key once; only rows that a
    bitmap of the keys hits are shuffled."""
    maybe, clear = parted(rows, keys, key)
    return clear.unionByName(maybe.join(keys, key, "left_anti"))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))
