"""License scans by diagonal voting, in DataFrame functions only.

Every word k-gram of every text is joined to the k-grams of the license templates. A
match at document word p and template word t votes for the diagonal p - t: the word
where the whole template would begin. Template places are kept by diagonal, and each
diagonal begins a span with the neighbouring ones (words put in or left out) that are not
too far from it. A span counts by itself if enough of the template's k-grams are in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words in a k-gram.
K = 3

#: Phrases that must stand word for word, and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: License notices that may be reworded a little, and their labels.
NOTICES = [
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
]


def words(text: Column) -> Column:
    """Words of the lower-cased text. Two letters whose lower case would become ASCII
    are set aside first, so that only A-Z count as ASCII capitals."""
    lowered = F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("κ")), F.lit("İ"), F.lit("ι")))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def templates(spark: SparkSession) -> DataFrame:
    """k-grams of all templates: a fixed table of a few hundred rows."""
    rows = [(i, t, label, i < len(PHRASES)) for i, (t, label) in enumerate(PHRASES + NOTICES)]
    return (
        spark.createDataFrame(rows, "template int, phrase string, label string, exact boolean")
        .withColumn("w", F.split("phrase", " "))
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.size("w") - K)))
        .select(
            "template", "label", "exact", "t", (F.size("w") - K + 1).alias("grams"),
            F.concat_ws(" ", F.slice("w", F.col("t") + 1, F.lit(K))).alias("gram"),
        )
        .withColumn("h", F.xxhash64("gram"))
    )


def scan(docs: DataFrame, coverage: float = 0.7, slack: int = 3) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    ``spans``, the verified spans with first and last word. ``score`` is the largest
    share of a template's k-grams found in one place. Null and empty texts have no
    words and no labels; rows that repeat are answered each on its own."""
    spark = docs.sparkSession
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        words(F.coalesce("text", F.lit(""))).alias("w"),
    )
    at = lambda i: F.get("words", F.col("pos") + i)
    # Position 0 is a mark that keeps every document; words count from 1 here.
    grams = (
        base.select("row", "doc_id", F.concat(F.array(F.lit("\0")), F.col("w")).alias("words"))
        .select("row", "doc_id", "words", F.posexplode("words").alias("pos", "word"))
        .select(
            "row", "doc_id", "pos", F.when(F.col("pos") == 0, F.size("words") - 1).alias("n_words"),
            F.concat_ws(" ", "word", at(1), at(2)).alias("gram_here"),
        )
        .withColumn("h", F.xxhash64("gram_here"))
    )
    known = F.broadcast(templates(spark))  # fixed size
    votes = (
        grams.join(known, "h", "left")
        .filter((F.col("pos") == 0) | (F.col("gram") == F.col("gram_here")))
        .withColumn("diagonal", F.col("pos") - 1 - F.col("t"))
        .groupBy("row", "doc_id", "template", "label", "exact", "grams", "diagonal")
        .agg(
            F.bit_or(F.expr("shiftleft(1L, t)")).alias("places"), F.min(F.col("diagonal") + F.col("t")).alias("at0"),
            F.max(F.col("diagonal") + F.col("t") + K - 1).alias("at1"), F.max("n_words").alias("n_words"),
        )
    )
    of = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(of) > slack, F.lit(True))
    chains = votes.withColumn("starts", apart.cast("int")).withColumn("chain", F.sum("starts").over(of))
    near = Window.partitionBy("row", "template", "chain").orderBy("diagonal")

    def span(drift: int) -> Column:
        """The span of a diagonal and those up to ``drift`` after it; its share is of distinct places."""
        on = near.rangeBetween(0, drift)
        share = F.bit_count(F.bit_or("places").over(on)) / F.col("grams")
        return F.struct(share.alias("share"), F.lit(-drift).alias("drift"), F.min("at0").over(on).alias("first"), F.max("at1").over(on).alias("last"))

    # The best span from each diagonal, the tightest of equals; a phrase has one diagonal only.
    spans = F.array(*map(span, range(2 * slack + 1)))
    merged = (
        chains.withColumn("spans", spans)
        .withColumn("x", F.when(F.col("exact"), F.col("spans")[0]).otherwise(F.array_max("spans")))
        .select("row", "doc_id", "template", "label", "exact", "chain", "diagonal", "n_words", "x.share", "x.first", "x.last")
        # of spans that begin on near diagonals, the best
        .withColumn("around", F.max("share").over(near.rangeBetween(-2 * slack, 2 * slack)))
        .filter("exact OR template IS NULL OR share = around")
        # of templates found in one place (versions of a license), the best
        .withColumn("best", F.max("share").over(Window.partitionBy("row", "first")))
    )
    # A phrase is there only with all of its k-grams on one diagonal; a notice with enough in a span.
    whole = F.col("exact") & (F.col("share") == 1)
    good = whole | (~F.col("exact") & (F.col("share") >= coverage) & (F.col("share") == F.col("best")))
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return (
        merged.groupBy("row", "doc_id")
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.count(F.when(whole, 1)).alias("n_base"),
            F.min(F.when(whole, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(whole, F.col("diagonal"))).cast("long").alias("last_word"),
            labels(whole).alias("base_labels"),
            labels(good).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(good, F.struct("first", "last", "label")))).alias("spans"),
        )
        .drop("row")
    )
