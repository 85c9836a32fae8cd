"""Homomorphic document fingerprints, in DataFrame functions only.

Each paragraph is hashed to a wide vector, and a document's fingerprint is the sum of
its paragraphs' vectors modulo 2^32 a lane. The order of paragraphs does not matter,
and a paragraph is put in or taken out by adding or subtracting its vector. Lanes are of
two kinds: EQUAL lanes are sums of hash words of whole paragraphs and tell whether two
documents have the same paragraphs; LIKE lanes are sums of hash bits of the paragraph's
phrases, whose differences estimate how many phrases two documents do not share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewarden.llm.common import shuffle_partitions, stored

EQUAL, LIKE = 6, 64
#: Lanes: EQUAL paragraph lanes, the number of phrases, LIKE phrase lanes.
LANES = EQUAL + 1 + LIKE
#: A phrase ends at a mark or after a word with one of these last letters, so that an edit moves no other phrase.
PHRASE = r"(?<=[entENT.,;:!?])\s+"
_LOW = "4294967295L"


def _sums() -> list[Column]:
    """Aggregates over exploded phrases: two 32-bit sums share one 64-bit sum for LIKE."""
    first = "IF(phrase_no = 0, {}, 0L)"
    equal = []
    for k in range(EQUAL // 2):
        h = f"xxhash64(paragraph, {k})"
        equal += [F.expr("sum(" + first.format(f"{h} & {_LOW}") + ")"), F.expr("sum(" + first.format(f"shiftrightunsigned({h}, 32)") + ")")]
    like = [F.expr(f"sum(shiftrightunsigned(h, {j}) & 4294967297L)") for j in range(LIKE // 2)]
    return [*(c.alias(f"e{i}") for i, c in enumerate(equal)), F.count(F.lit(1)).alias("n"), *(c.alias(f"l{j}") for j, c in enumerate(like))]


def _vector() -> Column:
    """The lanes as one array, each modulo 2^32."""
    low = lambda name: F.expr(f"{name} & {_LOW}")
    lanes = [*(low(f"e{i}") for i in range(EQUAL)), low("n")]
    for j in range(LIKE // 2):
        lanes += [low(f"l{j}"), F.expr(f"shiftrightunsigned(l{j}, 32)")]
    return F.array(*lanes)


def vectors(texts: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``vector`` for rows of (keys, text); rows with equal keys are added
    up. Phrases are added within the task that reads them before anything is shuffled."""
    return (
        texts.select(*keys, F.explode(F.split("text", "\n", -1)).alias("paragraph"))
        .select(*keys, "paragraph", F.posexplode(F.split("paragraph", PHRASE, -1)).alias("phrase_no", "phrase"))
        .withColumn("h", F.xxhash64("phrase"))
        .groupBy(*keys)
        .agg(*_sums())
        .select(*keys, _vector().alias("vector"))
    )


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector with b's paragraphs put in (sign 1) or taken out (sign -1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(2**32)))


def printed(vector: Column) -> Column:
    """The vector as text, eight hex digits a lane."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal multisets of phrases, about 0 for unrelated ones: one minus the
    estimated squared distance over the sum of squared sizes. Each LIKE lane, doubled
    and less the number of phrases, is a random projection of the phrase counts."""
    n = EQUAL
    sides = F.zip_with(
        F.slice(a, EQUAL + 2, LIKE), F.slice(b, EQUAL + 2, LIKE),
        lambda x, y: F.named_struct(F.lit("x"), 2.0 * x - F.get(a, F.lit(n)), F.lit("y"), 2.0 * y - F.get(b, F.lit(n))),
    )
    total = lambda f: F.aggregate(sides, F.lit(0.0), lambda acc, s: acc + f(s))
    apart, sizes = total(lambda s: (s["x"] - s["y"]) * (s["x"] - s["y"])), total(lambda s: s["x"] * s["x"] + s["y"] * s["y"])
    # the sums of squares of unlike texts scatter: what is no nearer than that is unlike
    return F.when(F.slice(a, 1, LANES) == F.slice(b, 1, LANES), 1.0).when(sizes == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / sizes))


def neighbours(docs: DataFrame) -> DataFrame:
    """For each distinct (doc_id, tie) of ``docs``: the next one in ascending order (nulls
    first; after the last, the first), the previous one's length, and the copies. Sorted
    by ranges; only the first and last row of each range meet in one task, two rows a
    range at most."""
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = (
        docs.groupBy("doc_id", "tie", "n_chars")
        .agg(F.count(F.lit(1)).alias("copies"))
        .repartitionByRange(shuffle_partitions(spark), *order)
        .withColumn("range", F.spark_partition_id())
    )
    ranged = stored(ranged, "document-order")
    me = F.struct("doc_id", "tie", "n_chars").alias("me")
    within = Window.partitionBy("range").orderBy(*order)
    rows = ranged.select("range", "doc_id", "tie", "n_chars", "copies", F.lead(me).over(within).alias("after"), F.lag(me).over(within).alias("prior"))
    ends = ranged.groupBy("range").agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie", "n_chars")).alias("low"),
        F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie", "n_chars")).alias("high"),
    )
    every = Window.orderBy("range")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "range",
        F.coalesce(F.lead("low").over(every), F.first("low").over(whole)).alias("next_low"),
        F.coalesce(F.lag("high").over(every), F.last("high").over(whole)).alias("prior_high"),
    )
    return rows.join(F.broadcast(ends), "range").select(
        "doc_id", "tie", "copies",
        F.when(F.col("after").isNull(), F.struct("next_low.doc_id", "next_low.tie")).otherwise(F.struct("after.doc_id", "after.tie")).alias("next"),
        F.when(F.col("prior").isNull(), F.struct("prior_high.doc_id", "prior_high.tie", "prior_high.n_chars"))
        .otherwise(F.struct("prior.doc_id", "prior.tie", "prior.n_chars"))
        .alias("prior"),
    )


def _slot(doc_id: str, tie: str) -> Column:
    """The pair as one key, without nulls."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(tie).cast("string"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last quarter, rounded down,
    replaced by as many first code points of the next document), with their likeness and
    that to the next document. ``docs`` needs doc_id and text; other columns are ignored.
    A null text is empty. Documents are ordered by doc_id (null first), those that repeat
    a doc_id by a hash of the text; rows equal in both are one document in that order and
    give equal result rows. A single document is its own next one."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "tie", F.xxhash64("text")
    )
    links = stored(neighbours(base.select("doc_id", "tie", F.length("text").cast("long").alias("n_chars"))), "document-neighbours")
    # Rows equal in doc_id and text: one of them stands for all. The texts' shuffle has no other
    # columns, so that both uses of ``one`` share it; a lag keeps the join's partitioning.
    one = (
        base.select(_slot("doc_id", "tie").alias("slot"), "text")
        .join(links.select(_slot("doc_id", "tie").alias("slot"), "doc_id", "copies", "next", "prior"), "slot")
        .withColumn("before", F.lag("slot").over(Window.partitionBy("slot").orderBy("slot")))
        .filter("before IS NULL")
        .select("slot", "doc_id", "text", "copies", _slot("next.doc_id", "next.tie").alias("next_slot"), "prior")
    )
    need = F.floor(F.col("prior.n_chars") / 4).cast("int")
    heads = one.select(_slot("prior.doc_id", "prior.tie").alias("slot"), F.substring("text", F.lit(1), need).alias("head"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n - quarter), F.substring("head", F.lit(1), quarter)
    )
    both = (
        one.join(heads, "slot")
        .withColumn("edited", edited)
        .select(
            "slot", "doc_id", F.col("next_slot"), "copies", n.cast("long").alias("n_chars"),
            F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
            F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("text")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text")))).alias("x"),
        )
        .select("slot", "doc_id", "next_slot", "copies", "n_chars", "edited_sha256", "x.is_edited", "x.text")
    )
    prints = stored(vectors(both, "slot", "doc_id", "next_slot", "copies", "n_chars", "edited_sha256", "is_edited"), "fingerprints")
    texts = prints.filter("NOT is_edited").drop("is_edited")
    edits = prints.filter("is_edited").select("slot", F.col("vector").alias("edited_vector"))
    following = texts.select(F.col("slot").alias("next_slot"), F.col("vector").alias("next_vector"))
    return (
        texts.join(edits, "slot")
        .join(following, "next_slot")
        .select(
            "doc_id", "n_chars", "edited_sha256", printed(F.col("vector")).alias("fingerprint"),
            printed(F.col("edited_vector")).alias("edited_fingerprint"),
            likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
            likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
            F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        )
        .drop("copy")
    )
