"""Entity resolution between two name columns, in tiers of confidence.

Every tier is an equi-join against a right side with one row per key, so no
group of names is ever paired with itself. Values are folded to distinct
spellings first, then to distinct normalised names.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.text import col, strip
from lakewarden.operators.skew import ROWS_PER_SALT, salted_join
from lakewarden.session import cut_lineage

# Words without identity, words with little, and thresholds.
LEGAL_FORMS = r"(?U)\b(?:INC|LLC|L\.?L\.?C|CORP|CORPORATION|INCORPORATED|CO|COMPANY|LTD|LIMITED)\.?\b"
DESCRIPTIVE = [
    "GROUP", "SERVICE", "SERVICES", "ENTERPRISE", "ENTERPRISES",
    "HOLDING", "HOLDINGS", "INTERNATIONAL", "AMERICA", "AMERICAS",
    "ASSOCIATE", "ASSOCIATES", "PARTNER", "PARTNERS", "SOLUTION",
    "SOLUTIONS", "TECHNOLOGY", "TECHNOLOGIES", "CONSULTING", "MANAGEMENT",
]
PUNCTUATION = r"""[.,;:!@#$%^&*()_\-+=\[\]{}|\\/<>~`"']"""
REDACTED = "[REDACTED"
MIN_NORM, MIN_TOKEN, MIN_OVERLAP = 3, 4, 2

_NOT_ASCII = r"[^\x00-\x7F]"
_BLANKS = r"(?U)[\s\x1c-\x1f]+"
# Name pairs with up to this many shared-vocabulary words each are matched by
# word subsets (at most 57 per name); longer ones by rarest-words prefixes.
SUBSET_WORDS = 6
HEAVY_WORDS = 256


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def _fold_name(name: Column) -> Column:
    plain = F.regexp_replace(strip(F.upper(name)), LEGAL_FORMS, "")
    return strip(F.regexp_replace(F.regexp_replace(plain, PUNCTUATION, " "), _BLANKS, " "))


def with_norm(df: DataFrame, name: str, norm: str = "norm") -> DataFrame:
    """Adds the normalised name. Only rows with non-ASCII letters visit Python
    for compatibility folding; Spark has no such function."""
    c = col(name)
    ascii_rows = df.filter(~c.rlike(_NOT_ASCII)).withColumn(norm, _fold_name(c))
    other_rows = df.filter(c.rlike(_NOT_ASCII)).withColumn(norm, _fold_name(_nfkc(c)))
    return ascii_rows.unionByName(other_rows)


def entity_variants(
    values: DataFrame, column: str, *, position: str | None = None, max_chars: int | None = None
) -> DataFrame:
    """(norm, spelling, first_position): every usable spelling of every entity.

    Copies of a spelling are folded by partial aggregation before the shuffle.
    `position` orders spellings by first appearance; without it they are
    ordered by text.
    """
    name = strip(col(column).cast("string"))
    if max_chars is not None:
        name = F.substring(name, 1, max_chars)
    place = F.col(position) if position else F.lit(0)
    spelled = (
        values.select(name.alias("spelling"), place.alias("place"))
        .filter((F.col("spelling") != "") & ~F.col("spelling").contains(REDACTED))
        .groupBy("spelling")
        .agg(F.min("place").alias("first_position"))
    )
    named = with_norm(spelled, "spelling")
    return named.filter((F.length("norm") >= MIN_NORM) & F.col("norm").rlike(r"\p{L}"))


def distinct_entities(variants: DataFrame) -> DataFrame:
    """(norm, value, n_variants): the first spelling stands for the entity."""
    order = F.struct("first_position", "spelling")
    return variants.groupBy("norm").agg(
        F.min_by("spelling", order).alias("value"), F.count(F.lit(1)).alias("n_variants")
    )


def _words(norm: Column | str) -> Column:
    return F.split(col(norm), " ")


def word_bag(norm: Column | str) -> Column:
    return F.array_join(F.array_sort(_words(norm)), " ")


def core_name(norm: Column | str) -> Column:
    return F.array_join(F.filter(_words(norm), lambda w: ~w.isin(DESCRIPTIVE)), " ")


def significant_words(norm: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(_words(norm), lambda w: F.length(w) >= MIN_TOKEN)))


def _needed(n: Column, k: Column) -> Column:
    """Fewest shared words that pass: two, and over 60% of the shorter name."""
    return F.greatest(F.lit(MIN_OVERLAP), F.floor(F.least(n, k) * 3 / 5).cast("int") + 1)


def _subsets(words: Column) -> Column:
    """All subsets of two or more words, each joined to one key."""
    every = F.aggregate(
        words,
        F.array(F.array().cast("array<string>")),
        lambda acc, w: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(w)))),
    )
    return F.filter(every, lambda s: F.size(s) >= MIN_OVERLAP)


def _overlap_matches(left: DataFrame, right: DataFrame, rows_per_salt: int) -> DataFrame:
    """(norm, right_norm, shared) by shared significant words: most words
    first, then the smallest right name.

    Names with equal word sets behave alike, so each side is folded to its
    distinct sets, and words the other side never uses are set aside (they
    count for a set's size only). A common word alone never pairs names: it
    meets its partner rows through (subset, size) keys that hold one row each.
    """
    def sized(df: DataFrame) -> DataFrame:
        words = significant_words("norm")
        return df.select("norm", words.alias("words"), F.size(words).alias("n")).filter(F.col("n") >= MIN_OVERLAP)

    left_names = sized(left).withColumn("bag", F.array_join("words", " "))
    left_sets = left_names.select("bag", "words", "n").distinct()
    right_sets = (
        sized(right)
        .groupBy(F.array_join("words", " ").alias("bag"), "n")
        .agg(F.min("norm").alias("right_norm"))
        .withColumn("words", F.split("bag", " "))
    )

    def vocabulary(sets: DataFrame) -> DataFrame:
        return sets.select(F.explode("words").alias("word")).distinct()

    def shared_words(sets: DataFrame, other: DataFrame, keep: list[str]) -> DataFrame:
        # A set has at most a few dozen words, so regrouping it is bounded.
        return (
            sets.select(*keep, F.explode("words").alias("word"))
            .join(_by_size(vocabulary(other)), "word", "left_semi")
            .groupBy(*keep)
            .agg(F.array_sort(F.collect_list("word")).alias("used"))
            .filter(F.size("used") >= MIN_OVERLAP)
        )

    left_used = cut_lineage(shared_words(left_sets, right_sets, ["bag", "n"]))
    right_used = cut_lineage(
        shared_words(right_sets, left_sets, ["bag", "n", "right_norm"])
        .groupBy("used", F.col("n").alias("k"))
        .agg(F.min("right_norm").alias("right_norm"))
    )
    short = F.size("used") <= SUBSET_WORDS

    left_keys = left_used.filter(short).select("bag", "n", F.explode(_subsets(F.col("used"))).alias("subset"))
    right_keys = (
        right_used.filter(short)
        .select("k", "right_norm", F.explode(_subsets(F.col("used"))).alias("subset"))
        .groupBy("subset", "k")
        .agg(F.min("right_norm").alias("right_norm"))
    )
    # A right key holds one row per set size, so a hot subset on the left adds
    # no output; adaptive execution splits such a partition by its size.
    by_subset = left_keys.join(_by_size(right_keys), "subset").filter(
        F.size("subset") >= _needed(F.col("n"), F.col("k"))
    )
    found = by_subset.select("bag", F.size("subset").alias("shared"), "right_norm")

    if not (left_used.filter(~short).isEmpty() and right_used.filter(~short).isEmpty()):
        found = found.unionByName(_long_overlaps(left_used, right_used, rows_per_salt))
    best = found.groupBy("bag").agg(F.min(F.struct((-F.col("shared")).alias("rank"), "right_norm")).alias("b"))
    best = best.select("bag", (-F.col("b.rank")).alias("shared"), "b.right_norm")
    return left_names.select("norm", "bag").join(_by_size(best), "bag").select("norm", "right_norm", "shared")


def _long_overlaps(left_used: DataFrame, right_used: DataFrame, rows_per_salt: int) -> DataFrame:
    """Pairs where a set has more than SUBSET_WORDS usable words.

    Two sets that share t words also share one among the first (size - t + 1)
    words of each in any fixed order; with the heaviest words ordered last,
    that word is a rare one. Each pair is kept at its first shared word only.
    """
    weights = (
        right_used.select(F.explode("used").alias("word"))
        .groupBy("word").count()
        .orderBy(F.desc("count"), "word").limit(HEAVY_WORDS)
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "count"))).alias("m"))
    )
    heavy = F.coalesce(weights.scalar(), F.create_map().cast("map<string,bigint>"))

    def ordered(df: DataFrame) -> DataFrame:
        weighed = F.transform(
            "used",
            lambda w: F.struct(
                F.coalesce(F.try_element_at("heavy", w), F.lit(0)).alias("weight"), w.alias("word")
            ),
        )
        by_weight = F.transform(F.array_sort(weighed), lambda s: s["word"])
        return df.withColumn("heavy", heavy).withColumn("words", by_weight).drop("heavy", "used")

    a = ordered(left_used).select(
        "bag", "n", F.col("words").alias("l_words"), F.posexplode("words").alias("l_at", "key")
    )
    b = ordered(right_used).select(
        "k", "right_norm", F.col("words").alias("r_words"), F.posexplode("words").alias("r_at", "key")
    )
    long_l, long_r = F.size("l_words") > SUBSET_WORDS, F.size("r_words") > SUBSET_WORDS
    # A short set meets long ones only, so its own prefix is already known.
    fewest = F.lit(MIN_OVERLAP)
    a = a.filter(F.col("l_at") <= F.size("l_words") - fewest)
    b = b.filter(F.col("r_at") <= F.size("r_words") - fewest)
    needed = _needed(F.col("n"), F.col("k"))
    pairs = salted_join(a, b, "key", spread_by=["bag"], rows_per_salt=rows_per_salt).filter(
        (long_l | long_r)
        & (F.col("l_at") <= F.size("l_words") - needed)
        & (F.col("r_at") <= F.size("r_words") - needed)
    )
    common = F.array_intersect("l_words", "r_words")
    return (
        pairs.withColumn("common", common)
        .filter((F.get("common", F.lit(0)) == F.col("key")) & (F.size("common") >= needed))
        .select("bag", F.size("common").alias("shared"), "right_norm")
    )


def match_entities(left: DataFrame, right: DataFrame, *, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Best right match of every left entity (inputs from `distinct_entities`).

    Columns: tier, normalized, right_normalized, left_value, left_variants,
    right_value, right_variants (variant counts), match_type, confidence,
    rationale. Order by (tier, normalized) for a best-first report.
    """
    return _match(*_sides(left, right), rows_per_salt)


def match_with_stats(left: DataFrame, right: DataFrame, *, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """`resolution_stats` of `match_entities`; each side is normalised once for both."""
    left, right = _sides(left, right)
    return resolution_stats(_match(left, right, rows_per_salt), left, right)


def _sides(*sides: DataFrame) -> list[DataFrame]:
    return [cut_lineage(side.select("norm", "value", "n_variants")) for side in sides]


def _by_size(side: DataFrame) -> DataFrame:
    """A side that grows with the names. What was written keeps the size that the planner
    guessed from compressed files, so it is never broadcast."""
    return side.hint("merge")


def _match(left: DataFrame, right: DataFrame, rows_per_salt: int) -> DataFrame:
    by_bag = right.groupBy(word_bag("norm").alias("bag")).agg(F.min("norm").alias("bag_match"))
    core = core_name("norm")
    by_core = (
        right.select(core.alias("core"), "norm").filter(F.length("core") >= MIN_NORM)
        .groupBy("core").agg(F.min("norm").alias("core_match"))
    )
    # A name without a core gets a key of its own that matches nothing.
    own_core = F.when(F.length(core) >= MIN_NORM, core).otherwise(F.concat(F.lit("\n"), F.col("norm")))
    looked = (
        left.select("norm")
        .join(_by_size(right.select("norm", F.col("norm").alias("exact_match"))), "norm", "left")
        .withColumns({"bag": word_bag("norm"), "core": own_core})
        .join(_by_size(by_bag), "bag", "left")
        .join(_by_size(by_core), "core", "left")
    )
    first = F.coalesce("exact_match", "bag_match", "core_match")
    tier = F.when(F.col("exact_match").isNotNull(), 0).when(F.col("bag_match").isNotNull(), 1).otherwise(2)
    looked = cut_lineage(looked.select("norm", first.alias("right_norm"), tier.alias("tier"), F.lit(0).alias("shared")))
    direct = looked.filter(F.col("right_norm").isNotNull())
    rest = looked.filter(F.col("right_norm").isNull()).select("norm")
    by_words = _overlap_matches(rest, right, rows_per_salt).select("norm", "right_norm", F.lit(3).alias("tier"), "shared")

    both = direct.unionByName(by_words)
    ignored = F.array_sort(
        F.array_distinct(F.filter(F.concat(_words("norm"), _words("right_norm")), lambda w: w.isin(DESCRIPTIVE)))
    )
    t = F.col("tier")
    rationale = (
        F.when(t == 0, F.lit("identical after normalization"))
        .when(t == 1, F.lit("same words, different order"))
        .when(t == 2, F.concat(F.lit("same name ignoring descriptive words ("), F.array_join(ignored, ", "), F.lit(")")))
        .otherwise(F.concat(F.col("shared").cast("string"), F.lit(" significant tokens shared")))
    )
    match_type = F.when(t == 0, "exact").when(t == 1, "token_set").when(t == 2, "core").otherwise("token_overlap")
    confidence = F.when(t == 0, "high").when(t == 1, "medium").otherwise("low")
    lv = left.select("norm", F.col("value").alias("left_value"), F.col("n_variants").alias("left_variants"))
    rv = right.select(F.col("norm").alias("right_norm"), F.col("value").alias("right_value"),
                      F.col("n_variants").alias("right_variants"))
    return (
        both.join(_by_size(lv), "norm")
        .join(_by_size(rv), "right_norm")
        .select(
            "tier", F.col("norm").alias("normalized"), F.col("right_norm").alias("right_normalized"), "left_value",
            "left_variants", "right_value", "right_variants", match_type.alias("match_type"),
            confidence.alias("confidence"), rationale.alias("rationale"),
        )
    )


def resolution_stats(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: distinct entities per side, matches, matches by confidence."""
    counted = matches.agg(
        F.count(F.lit(1)).alias("matches"),
        *[F.count_if(F.col("confidence") == c).alias(f"{c}_confidence") for c in ("high", "medium", "low")],
    )
    # One-row frames side by side.
    sides = left.agg(F.count(F.lit(1)).alias("left_distinct")), right.agg(F.count(F.lit(1)).alias("right_distinct"))
    return counted.withColumns({"left_distinct": sides[0].scalar(), "right_distinct": sides[1].scalar()})
