"""Merkle manifests of a dataset.

Every row is a leaf; the leaves of a group form a tree, and the groups' roots form the
tree above them. A level is computed by window functions over blocks of neighbouring
leaves: a node stands on the row of its first leaf, so its siblings are lag and lead
columns at fixed offsets, masked by the node's slot in its run and by the run's length,
and the row of a run's first child hashes the parent. A block is a whole subtree, so one
shuffle serves all levels inside it; the blocks' tops are the leaves of the next climb.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewarden.llm.common import shared_folder, stored

#: Columns of a leaf, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "struct<before:string,after:string>"
#: Levels inside one block.
LEVELS = 10


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """Digest of a row; ``changed`` columns stand in for its own."""
    return digest(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)))


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``at``, the place in their group (0, 1, ...) by ``order``, and ``total``,
    the size of the group. A range shuffle lays the groups out in order, so a group may
    span any number of files; places are counted per file and group and added up."""
    path = shared_folder(rows.sparkSession, name)
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"file": F.spark_partition_id(), "line": F.monotonically_increasing_id()})
    laid.write.parquet(path)
    laid = rows.sparkSession.read.schema(laid.schema).parquet(path)
    parts = laid.groupBy(group, "file").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))
    parts = stored(parts, f"{name}-parts")
    # One row a file and group; a group's rows are as many as the files that it spans.
    here = Window.partitionBy(group)
    before = F.sum("n").over(here.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(
        F.col(group).alias("its_group"), F.col("file").alias("its_file"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(here).alias("total"),
    )
    met = laid.join(starts, (F.col("file") == F.col("its_file")) & F.col(group).eqNullSafe(F.col("its_group")))
    return met.withColumn("at", F.col("line") + F.col("shift")).drop("file", "line", "its_group", "its_file", "shift")


def climb(nodes: DataFrame, arity: int, levels: int = LEVELS) -> DataFrame:
    """``levels`` levels up from ``nodes`` (tree, at, total, node; other columns stay).

    Adds ``block`` (the subtree of arity^levels nodes that a row is in), ``steps`` (at
    each level the digests before and after the row's ancestor in its run, joined) and, on
    the first row of a block, ``top``, the block's node. Levels above a tree's root have
    no step, and the root stays as it is."""
    size = arity**levels
    rows = nodes.withColumn("block", F.floor(F.col("at") / size)).withColumn("node_0", F.col("node"))
    line = Window.partitionBy("tree", "block").orderBy("at")
    for level in range(levels):
        step, node = arity**level, F.col(f"node_{level}")
        count = F.ceil(F.col("total") / step)
        index = F.floor(F.col("at") / step)
        slot = index % arity
        run = F.least(F.lit(arity), count - (index - slot))
        before = [F.when(slot >= d, F.lag(node, d * step).over(line)) for d in range(arity - 1, 0, -1)]
        after = [F.when(slot + d < run, F.lead(node, d * step).over(line)) for d in range(1, arity)]
        met = F.struct(*(F.concat(*(F.coalesce(c, F.lit("")) for c in side)).alias(n) for n, side in (("before", before), ("after", after))))
        rows = rows.withColumn(f"step_{level}", F.when((F.col("at") % step == 0) & (count > 1), met))
        parent = F.when(slot == 0, digest(F.concat(node, F.col(f"step_{level}.after"))))
        rows = rows.withColumn(f"node_{level + 1}", F.when(F.col("at") % (step * arity) == 0, F.when(count > 1, parent).otherwise(node)))
    # every leaf takes the step of its ancestor, the last node that began at it or before
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = [F.last(f"step_{level}", ignorenulls=True).over(so_far) for level in range(levels)]
    made = [f"{n}_{level}" for level in range(levels + 1) for n in ("node", "step")]
    return rows.withColumn("steps", F.array_compact(F.array(*steps))).withColumn("top", F.col(f"node_{levels}")).drop(*made)


def trees(nodes: DataFrame, arity: int, name: str, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (tree, at, total, node; other columns stay) with ``root``, that of their
    tree, and ``steps`` up to it. Tops of blocks climb on until every tree is one block; each
    climb has arity^levels times fewer rows, and its steps are met by (tree, block)."""
    climbed, size, at = [], arity**levels, 0
    while True:
        nodes = stored(climb(nodes, arity, levels), f"{name}-{at}")
        climbed.append(nodes)
        tops = nodes.filter(F.col("top").isNotNull()).select("tree", F.col("block").alias("at"), F.ceil(F.col("total") / size).alias("total"), F.col("top").alias("node"))
        if tops.filter("total > 1").isEmpty():
            break
        nodes, at = tops, at + 1
    # Above the last climb every block is a tree.
    above = tops.select("tree", F.col("at").alias("block"), F.col("node").alias("root"), F.array().cast(f"array<{STEP}>").alias("more"))
    for level in reversed(climbed):
        level = level.drop("top").join(above, ["tree", "block"]).withColumn("steps", F.concat("steps", "more")).drop("more", "block")
        above = level.select("tree", F.col("at").alias("block"), "root", F.col("steps").alias("more"))
    return level


def manifest(docs: DataFrame, arity: int = 2, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, source, lang, n_chars, text; other columns
    are ignored): doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    A group is a value of lang, null among them. Its leaves ascend by doc_id, null first;
    rows that share a doc_id ascend by their leaf, and equal rows are leaves of their own.
    Groups ascend by lang, null first. An empty table gives no rows. ``tampered`` marks
    rows (by doc_id) whose root is folded from a leaf with n_chars one higher; a null
    n_chars stays, so that row still verifies. Proofs come from the rows as they are."""
    spoiled = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_of().alias("node"),
        F.when(spoiled, leaf_of(n_chars=F.col("n_chars") + 1)).alias("spoiled"),
        F.monotonically_increasing_id().alias("row"),  # parts equal rows, so that many of them need not share a task
    )
    # Texts are read and hashed once; from here on a row is its digests.
    leaves = placed(stored(leaves, "merkle-leaves"), "lang", ["doc_id", "node", "row"], "merkle-order")
    keyed = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))).drop("lang", "row")
    low = trees(keyed, arity, "merkle-climb", levels)
    low = stored(low.withColumnRenamed("root", "subroot"), "merkle-low")
    groups = low.filter("at = 0").select(F.when(F.col("tree") != "-", F.substring("tree", 2, 2**31 - 1)).alias("lang"), F.col("subroot").alias("node"))
    groups = placed(groups.withColumn("all", F.lit(0)), "all", ["lang"], "merkle-groups")
    high = trees(groups.select(F.lit("").alias("tree"), "at", "total", "node", "lang"), arity, "merkle-top", levels)
    high = stored(high.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"), "root", F.col("steps").alias("more")), "merkle-high")
    steps = F.concat("steps", "more")
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    folded = F.aggregate("steps", F.coalesce("spoiled", "node"), lambda node, s: digest(F.concat(s["before"], node, s["after"])))
    every = low.join(high, "tree").withColumn("steps", steps)
    return every.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", digest(siblings).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_rows() -> Column:
    """Rows of the check: 7 divides the CRC-32 of the decimal doc_id."""
    return F.crc32(F.col("doc_id").cast("long").cast("string")) % 7 == 0
