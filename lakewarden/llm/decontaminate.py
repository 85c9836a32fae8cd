"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item (10 words, or the whole of a shorter item) is a set of word
shingles that must all be in a document that holds the window. The shingles are ordered
by how often they occur in the corpus; since all must be there, the rarest one is the
necessary prefix. Documents send only places whose shingle may be such a prefix. After
the join on that shingle, positional bounds align window and document, and the words
around it are compared one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewarden.llm.common import PLAIN_WORDS, bitmap, in_bitmap, stored

#: Words in a shingle; items with fewer words have one of that many.
SHINGLE = 3
#: Bits of the bitmaps of shingles that are sent to the tasks: 2 MB, whatever the benchmark's size.
BITS = 1 << 24

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(PLAIN_WORDS).split()


def codes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words, as signed integers."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    x = sum(codes[j : j + n] * _ODD[j] for j in range(size)) + np.uint64(size)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _around(words: list[bytes], at: int, size: int, window: int) -> tuple[list[bytes], list[bytes]]:
    """Words before a shingle, nearest first, and from it on, as far as a window reaches."""
    return words[max(0, at - window + size) : at][::-1], words[at : at + window]


_CONTEXT = "before array<binary>, after array<binary>"


def item_shingles(benchmark: DataFrame, window: int) -> DataFrame:
    """Every shingle of every item: entry (a row of the benchmark), item_id, length of the
    item's windows, size and place of the shingle, hash h, and the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                entry += 1
                words = words_of(text.as_py())
                size = min(SHINGLE, len(words))
                if words:
                    for at, h in enumerate(shingles(codes_of(words), size).tolist()):
                        rows.append((entry, item_id, min(window, len(words)), size, len(words), at, h, *_around(words, at, size, window)))
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            names = ["entry", "item_id", "length", "size", "n_words", "at", "h", "before", "after"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "entry long, item_id string, length int, size int, n_words int, at int, h long, " + _CONTEXT
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, schema)


def corpus_counts(docs: DataFrame, wanted: np.ndarray, sizes: list[int]) -> DataFrame:
    """(h, n): occurrences in all documents of the shingles whose bit is set. Tasks add up
    their batches, Spark adds up the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                codes = codes_of(words_of(text.as_py()))
                for size in sizes:
                    h = shingles(codes, size)
                    found.append(h[in_bitmap(shared.value, h.view(np.uint64), BITS)])
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def prefixes(items: DataFrame, counts: DataFrame) -> DataFrame:
    """The places that some window of their item has as its rarest shingle. Windows with a
    shingle that no document has are left out: they occur nowhere."""
    ranked = items.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_place = Window.partitionBy("entry").orderBy("at")
    reach = F.col("length") - F.col("size")
    best = None
    for width in ranked.select(reach.alias("reach")).distinct().collect():  # at most the words in a window
        ahead = by_place.rowsBetween(0, width["reach"])
        rarest = F.when(reach == width["reach"], F.min(F.struct("n", "h", "at")).over(ahead))
        best = rarest if best is None else F.coalesce(best, rarest)
    if best is None:
        return ranked.filter("false").drop("n")
    windows = ranked.withColumn("best", best).filter((F.col("at") <= F.col("n_words") - F.col("length")) & (F.col("best.n") > 0))
    chosen = windows.select("entry", F.col("best.at").alias("at")).distinct()
    return ranked.join(chosen, ["entry", "at"], "left_semi").drop("n")


def places(docs: DataFrame, wanted: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """One row for each document (row, doc_id, n_words; the others null), and one for each
    place whose shingle has its bit set: row, at, h and the words around it."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row += 1
                words = words_of(text.as_py())
                codes = codes_of(words)
                rows.append((row, doc_id, len(words), None, None, None, None))
                for size in sizes:
                    h = shingles(codes, size)
                    for at in np.flatnonzero(in_bitmap(shared.value, h.view(np.uint64), BITS)).tolist():
                        rows.append((row, None, None, at, int(h[at]), *_around(words, at, size, window)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            names = ["row", "doc_id", "n_words", "place", "h", "before", "after"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "row long, doc_id long, n_words long, place int, h long, " + _CONTEXT
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _agreeing(a: str, b: str) -> Column:
    """How many leading elements of two arrays are equal."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1).cast("int")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are ignored): doc_id,
    n_words, n_hit, n_items, items_sha256 and contaminated.

    ``benchmark`` has item_id and text. A word is hit if it lies in an occurrence of a
    window of ``window`` consecutive item words (the whole item if it has fewer). A null
    text has no words, and an item without words no window. Items that repeat an item_id
    count as one item with several texts; an item without an id hits words but is not
    counted or listed. Rows that repeat a doc_id, or have none, are answered each on its own."""
    items = stored(item_shingles(benchmark, window), "item-shingles")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # 1 to SHINGLE
    counts = corpus_counts(docs, bitmap(items, "h", BITS), sizes)
    index = stored(prefixes(items, counts), "item-prefixes")
    found = stored(places(docs, bitmap(index, "h", BITS), sizes, window), "document-places")
    theirs = index.select("h", "item_id", "length", "size", F.col("before").alias("item_before"), F.col("after").alias("item_after"))
    matched = (
        found.filter("place IS NOT NULL").select("row", "place", "h", "before", "after")
        .join(theirs, "h")
        .select(
            "row", "item_id", "length", "size", "place",
            _agreeing("before", "item_before").alias("back"), _agreeing("after", "item_after").alias("ahead"),
        )
        .filter((F.col("ahead") >= F.col("size")) & (F.col("back") + F.col("ahead") >= F.col("length")))
        .select("row", "item_id", (F.col("place") - F.col("back")).alias("from"), (F.col("place") + F.col("ahead")).alias("to"))
    )
    so_far = Window.partitionBy("row").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("to") - F.greatest(F.col("from"), F.coalesce(F.max("to").over(so_far), F.lit(0))))
    listed = F.array_join(F.array_sort(F.collect_set("item_id")), ",")
    by_row = (
        matched.distinct()
        .withColumn("fresh", fresh)
        .groupBy("row")
        .agg(F.sum("fresh").alias("n_hit"), F.count_distinct("item_id").alias("n_items"), listed.alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        found.filter("n_words IS NOT NULL").select("row", "doc_id", "n_words")
        .join(by_row, "row", "left")
        .select(
            "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.encode(F.coalesce("items", F.lit("")), "utf-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        )
    )
