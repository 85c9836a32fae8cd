"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import stored

#: Edges that one task contracts by itself before the tasks' results meet.
EDGES_PER_TASK = 1_000_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges as stars: each node with the smallest node it reaches here."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    out = [(x, find(x)) for x in root]
    u, v = zip(*((x, y) for x, y in out if x != y), strict=True) if any(x != y for x, y in out) else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of
    ``edges`` (a, b; loops are left out). Tasks first turn their share of the edges, a
    fixed number, into stars; where there is more than one task, rounds of large and
    small stars follow, which link a node's larger, then its smaller, neighbours to its
    smallest one, until nothing changes. The number of rounds grows with the logarithm
    of the largest component; each is written to shared storage, and only counts come to
    the driver. A hot node's neighbours are folded by partial aggregates and met in a
    plain join, which can be split."""
    pairs = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    tasks = -(-pairs.count() // EDGES_PER_TASK) or 1
    pairs, last = stored(pairs.repartition(tasks).mapInArrow(_contracted, "u long, v long"), "stars"), None
    while tasks > 1:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        # large star: neighbours above u go to u's least
        larger = pairs.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").filter("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v"))
        larger = stored(larger.distinct(), "large-star")
        # small star: u and its neighbours below go to the least of them
        lows = stored(larger.groupBy("u").agg(F.min("v").alias("m")), "least")
        smaller = larger.join(lows, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = stored(smaller.filter("u <> v").distinct(), "small-star")
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
