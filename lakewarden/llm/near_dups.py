"""Near-duplicate documents by odd sketches of MinHash samples.

Documents with the same set of word shingles are one class from the start. Each class
has MinHash samples: bands of them make candidate buckets, and all of them are folded
into a parity bitmap, whose exclusive or with another's tells their similarity closely
when it is high. Pairs that the bitmaps cannot rule out are confirmed on full sets.

Two rounds find all links that matter to the classes: first the most similar pairs that
join up a bucket (a spanning forest by estimate) are confirmed, then, in buckets that still
hold more than one component, every pair across components that the bitmaps leave open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import LOWER, bitmap, in_bitmap, stored
from lakewarden.llm.components import components

SAMPLES = 256
#: Bits of the odd sketch.
SKETCH = 1024
#: Members of a bucket that one task compares with each other at once.
CHUNK = 512
#: Bits of the bitmap that tells which texts to read again: 1 MB, whatever the input.
READ_BITS = 1 << 23

_rng = np.random.default_rng(20240229)
_FLIP = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_MIX = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; a shorter text is one."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(words))
    n = len(words) - size + 1
    sums = sum(codes[j : j + n] * _MIX[j] for j in range(size)) + np.uint64(size)
    return np.unique(mixed(sums))


def samples(hashes: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that is not empty."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 1024):
        np.minimum(out, ((high[at : at + 1024, None] ^ _FLIP) * _TIMES).min(0), out=out)
    return out


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Bit h is set if an odd number of (position, sample) pairs hash to h."""
    keys = mixed(sample.astype(np.uint64) | (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)))
    counts = np.bincount((keys & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return np.packbits((counts & 1).astype(np.uint8))


def estimate(differing_bits: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing bits of two sketches."""
    share = np.minimum(2 * differing_bits / SKETCH, 0.999)
    return 1 + SKETCH / 2 * np.log1p(-share) / (2 * SAMPLES)


def open_from(threshold: float) -> float:
    """The least estimate of a pair that may reach the threshold: five deviations below."""
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / SAMPLES)


def bands_for(threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the fewest bands, with rows as long as can be, that miss a pair at
    the threshold with a probability of ``miss`` at most and use half the samples."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
        if bands * rows <= SAMPLES // 2:
            return bands, rows
    return SAMPLES // 2, 1


def profiles(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set; null if empty), sketch, buckets."""
    salt = mixed(np.arange(bands, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sketches, buckets = [], [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), k)
                n.append(len(found))
                if not len(found):
                    keys.append(None), sketches.append(None), buckets.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                sample = samples(found)
                sketches.append(odd_sketch(sample).tobytes())
                band = sample[: bands * rows].reshape(bands, rows).astype(np.uint64)
                code = salt.copy()
                for j in range(rows):
                    code = mixed(code ^ band[:, j])
                buckets.append(code.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "sketch", "buckets"],
            )

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch binary, buckets array<long>")


def _members(classes: DataFrame) -> DataFrame:
    """(bucket, size, id, n, sketch, buckets) of all buckets of two classes or more."""
    placed = classes.select("id", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # both sides of the join are plain shuffles, so that a hot bucket can be split
    found = placed.join(stored(shared, "shared-buckets"), "bucket").select("bucket", "size", "id")
    return stored(found.join(classes.select("id", "n", "sketch", "buckets"), "id"), "bucket-members")


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """100 * |A and B| >= percent * |A or B| for sorted sets."""
    if len(one) > len(two):
        one, two = two, one
    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
    common = int((two[at] == one).sum())
    return 100 * common >= percent * (len(one) + len(two) - common)


def _blocks(members: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Pairs (a, b) across components, a spanning forest of each block.

    ``members``: bucket, id, n, sketch, component, part, and block (the rows compared with
    each other); one of a pair has part 1. Pairs that the sketches rule out are passed
    over, and the others are taken by falling estimate, unless they are joined up by then.
    If ``exact``, rows have their sets (hashes) and all their buckets as well: a pair is
    looked at in the first bucket that it shares, and joined only if its sets are linked,
    so that every pair of different components is decided and only links leave the task."""
    threshold = percent / 100
    least = open_from(threshold)
    names = ["id", "n", "sketch", "component", "part", *(["buckets", "hashes"] if exact else [])]

    def compare(bucket: int, group: dict) -> list[tuple[int, int]]:
        bits = np.frombuffer(b"".join(group["sketch"]), np.uint64).reshape(len(group["id"]), -1)
        n, part, comp = (np.array(group[c]) for c in ("n", "part", "component"))
        every = np.array(group["buckets"]) if exact else None
        found = []
        for i in range(len(n) - 1):
            rest = slice(i + 1, None)
            good = (comp[rest] != comp[i]) & ((part[rest] | part[i]) == 1)
            good &= np.minimum(n[rest], n[i]) >= threshold * np.maximum(n[rest], n[i])
            j = np.flatnonzero(good) + i + 1
            if len(j):
                guess = estimate(np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64))
                keep = guess >= least
                if exact:
                    band = int(np.flatnonzero(every[i] == bucket)[0])
                    keep &= (every[j] == every[i]).argmax(1) == band
                found += zip((-guess[keep]).tolist(), [i] * int(keep.sum()), j[keep].tolist(), strict=True)
        root, out = {}, []

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        sets = {}
        for _, i, j in sorted(found):
            x, y = find(group["component"][i]), find(group["component"][j])
            if x == y:
                continue
            if exact:
                for m in (i, j):
                    if m not in sets:
                        sets[m] = np.frombuffer(group["hashes"][m], np.uint64)
                if not _linked(sets[i], sets[j], percent):
                    continue
            root[x] = y
            out.append((min(group["id"][i], group["id"][j]), max(group["id"][i], group["id"][j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, {}

        def out():
            pairs = compare(at[0], group) if group and len(group["id"]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for bucket, block, *row in zip(*columns, strict=True):
                if (bucket, block) != at:
                    yield out()
                    at, group = (bucket, block), {c: [] for c in names}
                for c, v in zip(names, row, strict=True):
                    group[c].append(v)
        yield out()

    return (
        members.select("bucket", "block", *names)
        .repartition("bucket", "block")
        .sortWithinPartitions("bucket", "block")
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def _slot(bucket: str, parts: Column) -> Column:
    """Which of ``parts`` chunks of its bucket a row is in; another one in each bucket."""
    return F.pmod(F.xxhash64(bucket, "id"), parts).cast("int")


def _first_round(members: DataFrame, percent: int) -> DataFrame:
    chunks = F.ceil(F.col("size") / CHUNK)
    rows = members.withColumns({"block": _slot("bucket", chunks), "component": F.col("id"), "part": F.lit(1)})
    return _blocks(rows, percent, exact=False)


def _second_round(members: DataFrame, labels: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links across components: the rows outside a bucket's largest component, in chunks,
    against all its rows, in chunks."""
    named = members.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    named = stored(named, "bucket-components")
    sizes = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n_rows"), F.first("size").alias("size"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n_rows", "component")).alias("top"), F.first("size").alias("size"))
    mixed_up = stored(
        # the one pair of a bucket of two was confirmed or ruled out in the first round
        largest.filter("top.n_rows < size AND size > 2").select(
            "bucket", F.col("top.component").alias("top"), F.ceil(F.col("size") / CHUNK).cast("int").alias("all_chunks"),
            F.ceil((F.col("size") - F.col("top.n_rows")) / CHUNK).cast("int").alias("rest_chunks"),
        ),
        "mixed-buckets",
    )
    rows = stored(named.drop("size").join(mixed_up, "bucket").withColumn("outside", F.col("component") != F.col("top")), "mixed-members")
    sets = shingle_sets(rows.select("id"), docs, k)
    # Cell (i, j) holds chunk i of the rows outside (part 1) and chunk j of all rows (part 0; those outside as part 1).
    cell = lambda i, j: F.concat_ws("/", i.cast("string"), j.cast("string"))
    mine, ours = _slot("bucket", F.col("all_chunks")), _slot("bucket", F.col("rest_chunks"))
    as_all = F.transform(F.sequence(F.lit(0), F.col("rest_chunks") - 1), lambda i: cell(i, mine))
    as_rest = F.transform(F.sequence(F.lit(0), F.col("all_chunks") - 1), lambda j: cell(ours, j))
    cells = F.when(F.col("outside"), F.array_distinct(F.concat(as_all, as_rest))).otherwise(as_all)
    rows = rows.withColumn("part", F.col("outside").cast("int")).withColumn("block", F.explode(cells))
    return _blocks(rows.join(sets, "id"), percent, exact=True)


def shingle_sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, hashes) of the documents with the given ids, and of a few others: texts are read
    again, but only those that a bitmap of the ids lets through."""
    wanted = bitmap(ids.select(F.xxhash64("id").alias("h")), "h", READ_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(shared.value, batch.column(1).to_numpy().view(np.uint64), READ_BITS)
            part = batch.filter(pa.array(hit))
            sets = [shingle_set(t.as_py(), k).tobytes() for t in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "hashes"])

    doc_id = F.col("doc_id").cast("long")
    texts = docs.filter("doc_id IS NOT NULL").select(doc_id.alias("id"), F.xxhash64(doc_id).alias("h"), "text")
    return stored(texts.mapInArrow(run, "id long, hashes binary"), "shingle-sets")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B| on full shingle sets."""
    sets = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                _linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent)
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = lambda side: sets.select(F.col("id").alias(side), F.col("hashes").alias(f"set_{side}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, n_shingles, component_id and kept.

    Linked are documents with 100 * |A and B| >= percent * |A or B| of their sets of
    k-word shingles (a shorter text is one shingle). A null or empty text, or one of
    white space, has an empty set and is linked with nothing. doc_id identifies a
    document: rows that repeat one are the same document, which is compared by the text
    whose set has the smallest digest; each row counts its own shingles.
    A row whose doc_id is null is linked with nothing, has a null component_id and is
    kept. No bucket or group has a limit."""
    bands, rows = bands_for(percent / 100)
    every = stored(profiles(docs, k, bands, rows), "profiles")
    classes = every.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("id"))
    classes = stored(classes, "classes")
    facts = every.select(F.col("doc_id").alias("id"), "set_key", F.col("n_shingles").alias("n"), "sketch", "buckets").join(
        classes.withColumnRenamed("set_key", "own_key"), "id"
    )
    # rows that repeat a doc_id: the set with the smallest digest
    one = facts.filter("set_key = own_key").groupBy("id").agg(F.min(F.struct("set_key", "n", "sketch", "buckets")).alias("x"))
    facts = stored(one.select("id", "x.n", "x.sketch", "x.buckets"), "class-profiles")
    members = _members(facts)
    links = stored(confirmed(stored(_first_round(members, percent), "pairs"), docs, k, percent), "links")
    labels = stored(components(links), "components-1")
    more = _second_round(members, labels, docs, k, percent)
    labels = stored(components(links.unionByName(more)), "components-2")
    component = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("component")
    )
    component = stored(component, "class-components")
    return (
        every.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
        .join(component, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
