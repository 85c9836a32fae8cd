"""Phrase collocation mining, one size of phrases after the other.

A phrase that occurs often enough has only words and shorter phrases that do. So words are
counted first, then pairs of frequent words, then longer phrases whose first and last words
may each be a frequent shorter phrase, as a bitmap of fixed size says.

Nearly all of the shuffle is phrases that are counted. The most frequent words, a fixed
number of them, have a code, and three codes fill one long. A frequent word without a code
is spelled beside it, so that every count is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewarden.llm.common import shuffle_partitions, stored

#: Characters that end a piece of text.
ENDS = ".,;:!?\n\x0b\x0c\r"
CAPS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of a bitmap of frequent words or phrases (8 MB).
SLOTS = 1 << 26
#: Codes of words lie below; each group of words with one hash has its share of them.
CODES = 1 << 18
GROUPS = 256
#: Bytes of a word and its lang up to which the word may have a code.
CODED_BYTES = 64
#: Bits of a code, and codes in a long.
CODE_BITS, IN_A_LONG = 21, 3


def windows(docs: DataFrame, size: int) -> DataFrame:
    """(lang, w0, w1, ...): a row for each run of ``size`` words of a piece. They are shifted
    copies of the piece's array of words, so nothing is shuffled."""
    # one translation: A-Z to a-z, a tab to a space and every end of a piece to a line break
    plain = F.translate(F.coalesce("text", F.lit("")), CAPS + "\t" + ENDS, CAPS.lower() + " " + "\n" * len(ENDS))
    pieces = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(plain, "\n")).alias("piece"))
    words = pieces.select("lang", F.array_remove(F.split("piece", " "), "").alias("words")).filter(F.size("words") >= size)
    leads = [F.slice("words", 1 + i, F.size("words") - (size - 1)).alias(f"w{i}") for i in range(size)]
    return words.select("lang", F.inline(F.arrays_zip(*leads)))


def word_counts(docs: DataFrame, least: int, codes: int) -> DataFrame:
    """(lang, size, phrase, f, code): the words with f >= least, size 1, and with size 0 the
    number of words of each lang. The most frequent words of each group have a code from
    ``GROUPS`` up to ``codes``; other words, and words so long that a fixed number of them
    is no fixed size, have a null."""
    counts = windows(docs, 1).groupBy("lang", "w0").agg(F.count(F.lit(1)).alias("f"))
    often = counts.filter(F.col("f") >= least).withColumn("group", F.pmod(F.xxhash64("lang", "w0"), F.lit(GROUPS)))
    often = often.withColumn("long", F.octet_length("lang") + F.octet_length("w0") > CODED_BYTES)
    rank = F.row_number().over(Window.partitionBy("group").orderBy("long", F.desc("f"), "lang", "w0"))
    often = often.withColumn("code", rank.cast("long") * GROUPS + F.col("group"))
    code = F.when(~F.col("long") & (F.col("code") < min(codes, 1 << CODE_BITS)), F.col("code")).alias("code")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("f"))
    totals = totals.select("lang", F.lit(0).alias("size"), F.lit("").alias("phrase"), "f", F.lit(None).cast("long").alias("code"))
    return totals.unionByName(often.select("lang", F.lit(1).alias("size"), F.col("w0").alias("phrase"), "f", code))


def _slot(hashed: Column, slots: int) -> Column:
    return hashed.bitwiseAND(F.lit(slots - 1))


def slot_bits(keys: DataFrame) -> DataFrame:
    """(block, words): a bitmap with the bit of every ``slot`` of the keys set, as rows of 64
    words of 64 bits. Its size does not depend on the data."""
    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    words = keys.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    filled = F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(63)), "bits")))
    blocks = words.groupBy(F.shiftright("word", 6).alias("block")).agg(filled.alias("filled"))
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), lambda i: F.coalesce(F.col("filled")[i], F.lit(0).cast("long")))
    return blocks.select("block", whole.alias("words"))


def _marked(found: DataFrame, bits: DataFrame, slot: Column, name: str) -> tuple[DataFrame, Column]:
    """The rows with a block of the bitmap beside them, and whether the bit of ``slot`` is
    set; keys that share a slot with others may be hit for nothing."""
    # at most slots / 4096 rows of 64 longs
    side = F.broadcast(bits.select(F.col("block").alias(f"block_{name}"), F.col("words").alias(f"words_{name}")))
    met = found.join(side, F.shiftright(slot, 12) == F.col(f"block_{name}"), "left")
    word = F.element_at(f"words_{name}", (F.shiftright(slot, 6).bitwiseAND(F.lit(63)) + 1).cast("int"))
    return met, F.coalesce(F.getbit(word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))


def _key(first: int, size: int) -> list[Column]:
    """The phrase of ``size`` words from c and u of word ``first`` on: its codes, packed, and
    the words without one (null if there are none)."""
    packed = []
    for at in range(0, size, IN_A_LONG):
        codes = [F.shiftleft(f"c{first + i}", CODE_BITS * (IN_A_LONG - 1 - i % IN_A_LONG)) for i in range(at, min(size, at + IN_A_LONG))]
        packed.append(sum(codes[1:], codes[0]).alias(f"k{at // IN_A_LONG}"))
    spelled = [F.col(f"u{first + i}") for i in range(size)]
    return [*packed, F.when(F.coalesce(*spelled).isNotNull(), F.struct(*(c.alias(f"u{i}") for i, c in enumerate(spelled)))).alias("spelled")]


def _key_names(size: int) -> list[str]:
    return [*(f"k{i}" for i in range((size - 1) // IN_A_LONG + 1)), "spelled"]


def longer_counts(docs: DataFrame, size: int, coded: DataFrame, others: DataFrame, shorter: DataFrame | None, least: int, slots: int) -> DataFrame:
    """The keys and f of all phrases of ``size`` words with f >= least. ``coded`` has words
    and their codes, ``others`` and ``shorter`` are the bitmaps of frequent words without one
    and of frequent phrases of a word less. A window is dropped as soon as a part of it is
    too rare for any phrase of ``least`` occurrences to hold it."""
    found = windows(docs, size)
    for i in range(size):
        side = F.broadcast(coded.select(F.col("lang").alias(f"lang_{i}"), F.col("phrase").alias(f"word_{i}"), F.col("code").alias(f"code_{i}")))  # fewer than CODES rows
        found = found.join(side, (F.col("lang") == F.col(f"lang_{i}")) & (F.col(f"w{i}") == F.col(f"word_{i}")), "left")
        code = F.col(f"code_{i}")
        found, hit = _marked(found, others, F.when(code.isNull(), _slot(F.xxhash64("lang", f"w{i}"), slots)), str(i))
        found = found.filter(code.isNotNull() | hit)
    # a word has no space, so that the last one parts it from its lang
    spelled = [F.when(F.col(f"code_{i}").isNull(), F.concat_ws(" ", "lang", f"w{i}")).alias(f"u{i}") for i in range(size)]
    found = found.select(*(F.coalesce(f"code_{i}", F.lit(0).cast("long")).alias(f"c{i}") for i in range(size)), *spelled)
    if shorter is not None:
        for first in (0, 1):
            found, hit = _marked(found, shorter, _slot(F.xxhash64(*_key(first, size - 1)), slots), str(first))
            found = found.filter(hit)
    return found.select(*_key(0, size)).groupBy(*_key_names(size)).agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") >= least)


def spelled_out(counts: DataFrame, size: int, coded: DataFrame) -> DataFrame:
    """(lang, size, phrase, f) of counted keys."""
    words = []
    for i in range(size):
        code = F.shiftright(f"k{i // IN_A_LONG}", CODE_BITS * (IN_A_LONG - 1 - i % IN_A_LONG)).bitwiseAND(F.lit((1 << CODE_BITS) - 1))
        side = F.broadcast(coded.select(F.col("code").alias(f"code_{i}"), F.col("lang").alias(f"lang_{i}"), F.col("phrase").alias(f"word_{i}")))  # fewer than CODES rows
        counts = counts.join(side, code == F.col(f"code_{i}"), "left")
        words.append(F.coalesce(f"word_{i}", F.substring_index(f"spelled.u{i}", " ", -1)))
    first = F.col("spelled.u0")
    lang = F.coalesce("lang_0", first.substr(F.lit(1), F.length(first) - F.length(words[0]) - 1))
    return counts.select(lang.alias("lang"), F.lit(size).alias("size"), F.concat_ws(" ", *words).alias("phrase"), "f")


def phrase_counts(docs: DataFrame, order: int, least: int, slots: int = SLOTS, codes: int = CODES) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of up to ``order`` words with f >= least, and
    with size 0 the number of words of each lang. ``slots`` (a power of two) and ``codes``
    (at most 2^21) say what is kept small, not what is counted."""
    words = stored(word_counts(docs, least, codes), "word-counts")
    coded = words.filter(F.col("code").isNotNull())
    others = words.filter((F.col("size") == 1) & F.col("code").isNull()).select(_slot(F.xxhash64("lang", "phrase"), slots).alias("slot"))
    others, shorter = stored(slot_bits(others), "frequent-words"), None
    counts = words.select("lang", "size", "phrase", "f")
    for size in range(2, order + 1):
        found = stored(longer_counts(docs, size, coded, others, shorter, least, slots), f"phrases-{size}")
        counts = counts.unionByName(spelled_out(found, size, coded))
        if size < order:
            shorter = stored(slot_bits(found.select(_slot(F.xxhash64(*_key_names(size)), slots).alias("slot"))), f"frequent-{size}")
    return counts


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a^2 / (l r)), exact: products are decimals of up to 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    up = (F.lit(1_000_000).cast("decimal(7,0)") * wide(a)).cast("decimal(27,0)") * wide(a)
    return F.call_function("div", up.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)")).cast("long")


def _top(rows: DataFrame, per: str, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each ``per`` with their rank. A part of a group keeps its
    own first rows before the parts meet, so no task sees a whole group."""
    parts = shuffle_partitions(rows.sparkSession)
    salted = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy(per, "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order)))
    return ranked.filter(F.col("rank") <= top)


def collocations(docs: DataFrame, order: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000, slots: int = SLOTS, codes: int = CODES) -> DataFrame:
    """The ``top`` phrases of each lang of ``docs`` (text, lang; other columns are ignored):
    lang, rank, phrase, a, l, r, n and score.

    A null or empty text has no words; a null lang counts as ``und``, together with the
    lang of that name. Repeated rows count as often as they stand. Candidates have 2 to
    ``order`` words and occur ``least`` times or more; one is dropped if it stands inside
    a longer candidate with at least ``inside_percent`` percent of its count. Ties of
    score and count go by the bytes of the phrase. A table without words gives no rows."""
    counts = stored(phrase_counts(docs, order, least, slots, codes), "phrase-counts")
    several = counts.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    span = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    size = F.col("size")
    # Each cut is a row; a part occurs at least as often as its phrase, so it is among the counts.
    cut = several.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cut = cut.select("*", span(F.lit(1), F.col("k")).alias("first"), span(F.col("k") + 1, size - F.col("k")).alias("rest"))
    part = lambda name, f: counts.filter("size > 0").select(F.col("lang").alias(f"{f}_lang"), F.col("phrase").alias(f"{f}_{name}"), F.col("f").alias(f))
    met = cut.join(part("first", "l"), (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_first")))
    met = met.join(part("rest", "r"), (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_rest")))
    scored = met.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("low")
    scored = scored.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    # every phrase inside a longer candidate, with the largest count of one that holds it
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: span(at, n)))))
    holders = several.filter("size > 2").select(F.col("lang").alias("its_lang"), inner.alias("inner"), F.col("a").alias("longer"))
    holders = holders.groupBy("its_lang", "inner").agg(F.max("longer").alias("longer"))
    held = scored.join(holders, (F.col("lang") == F.col("its_lang")) & (F.col("phrase") == F.col("inner")), "left")
    free = held.filter(F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True))).drop("its_lang", "inner", "longer")
    ranked = _top(free, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    totals = counts.filter("size = 0").select(F.col("lang").alias("its_lang"), F.col("f").alias("n"))
    # at most ``top`` rows a lang meet one row of it
    return ranked.join(totals, F.col("lang") == F.col("its_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
