"""Secret scans in DataFrame functions only.

Three kinds have fixed patterns. Other long runs of key characters go through a battery
of randomness tests over the alphabet that the run's encoding would have: chi-squared
uniformity, runs above and below the middle of the alphabet, and serial correlation. A
run that passes as random is a finding if its mixture of digits and letter cases is too
improbable for plain writing; the limit on that probability comes, for each class of
lengths, from the Benjamini-Hochberg rule over all runs of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewarden.llm.common import parted, stored

#: The patterns of the base kinds, in order of listing.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "[0-9a-f]{24,}+"
#: Runs that the test battery looks at.
RUN = "[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ["assign", "access", "hex", "random"]
_PATTERNS = [ASSIGN, ACCESS, HEX, RUN]

#: Alphabets by encoding, in index order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Share of places in plain writing where a run changes between digit, capital, small letter and other.
PLAIN_CHANGES = 0.08
LEVELS = 64


def _found(kind: int) -> Column:
    """Matches of a kind as (kind, i, gap, length, match), where gap is the number of
    characters between the match before, or the text's start, and this one."""
    pattern = F.lit(_PATTERNS[kind])
    matches, between = F.regexp_extract_all("text", pattern, F.lit(0)), F.split("text", _PATTERNS[kind], -1)
    rows = F.transform(
        F.arrays_zip(matches.alias("m"), F.slice(between, F.lit(1), F.size(matches)).alias("b")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(x["b"]).alias("gap"), F.length(x["m"]).alias("length"),
            x["m"].alias("match"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,length:int,match:string>>")
    return F.when(F.col("text").rlike(_PATTERNS[kind]), rows).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for the normal distribution, by a logistic approximation."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _battery(runs: DataFrame) -> DataFrame:
    """p-values of the tests for each run: ``p_random`` is the least of three two-sided
    values times three, ``p_plain`` that of the plain-writing null."""
    body = F.regexp_replace("match", "=+$", "")
    hexes, base32, letters = (F.col("s").rlike(f"^{r}$") for r in ("([0-9a-f]+|[0-9A-F]+)", "[A-Z2-7]+", "[A-Za-z]+"))
    encoding = F.when(hexes, "hex").when(base32, "base32").when(letters, "letters").otherwise("base64")
    alphabet = F.coalesce(*(F.when(F.col("encoding") == e, F.lit(a)) for e, a in ALPHABETS.items()))
    plain = F.translate(F.when(F.col("encoding") == "hex", F.lower("s")).otherwise(F.col("s")), "-_", "+/")
    chars_of = F.filter(F.split(plain, ""), lambda c: c != "")
    n, m = F.col("n"), F.col("m")
    values = F.transform("chars", lambda c: F.call_function("locate", c, F.col("alphabet")).cast("double"))
    classes = F.transform("chars", lambda c: F.when(c.between("0", "9"), 0).when(c.between("A", "Z"), 1).when(c.between("a", "z"), 2).otherwise(3))
    squares = F.aggregate(
        F.array_distinct("chars"), F.lit(0.0),
        lambda a, c: a + F.pow(F.size(F.filter("chars", lambda x: x == c)).cast("double"), F.lit(2.0)),
    )
    runs = runs.withColumn("s", body).withColumn("encoding", encoding)
    runs = _computed(runs.withColumns({"alphabet": alphabet, "chars": chars_of}))
    runs = _computed(runs.withColumns({"v": values, "class": classes, "n": F.size("chars").cast("double"), "m": F.length("alphabet").cast("double")}))
    runs = _computed(runs.withColumns({
        "mean": _sum("v") / n, "squares": squares, "middle": (m + 1) / 2, "changes": _changes("class"), "df": m - 1, "usual": (n - 1) * PLAIN_CHANGES,
    }))
    runs = _computed(runs.withColumns({
        "up": F.transform("v", lambda x: F.when(x > F.col("middle"), 1.0).otherwise(0.0)),
        "d": F.transform("v", lambda x: x - F.col("mean")),
        "chi": F.greatest(m / n * F.col("squares") - n, F.lit(0.0)),
    }))
    lagged = F.zip_with(F.slice("d", F.lit(1), F.size("d") - 1), F.slice("d", F.lit(2), F.size("d") - 1), lambda x, y: x * y)
    runs = _computed(runs.withColumns({
        "ups": _sum("up"), "runs": 1.0 + _changes("up"),
        "var": F.aggregate("d", F.lit(0.0), lambda a, x: a + x * x), "lagged": F.aggregate(lagged, F.lit(0.0), lambda a, x: a + x),
    }))
    mu, df, usual = 1 + 2 * F.col("ups") * (n - F.col("ups")) / n, F.col("df"), F.col("usual")
    # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is about normal
    z_chi = (F.pow(F.col("chi") / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    z_runs = F.when(mu <= 2, F.lit(9.0)).otherwise((F.col("runs") - mu) / F.sqrt((mu - 1) * (mu - 2) / (n - 1)))
    z_serial = F.when(F.col("var") == 0, F.lit(9.0)).otherwise((F.col("lagged") / F.col("var") + 1 / n) * F.sqrt(n))
    z_plain = (F.col("changes") - 0.5 - usual) / F.sqrt(usual * (1 - PLAIN_CHANGES))
    least = F.least(_normal_tail(z_chi), 2 * _normal_tail(F.abs(z_runs)), 2 * _normal_tail(F.abs(z_serial)))
    return runs.withColumns({"p_random": F.least(F.lit(1.0), 3 * least), "p_plain": _normal_tail(F.least(z_plain, F.lit(12.0)))})


def _computed(df: DataFrame) -> DataFrame:
    """Columns so far as plain columns: a later use inside a function over an array would
    otherwise be the whole expression again, for each element."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("x")).select("x.*")


def _sum(name: str) -> Column:
    return F.aggregate(name, F.lit(0.0), lambda a, x: a + x)


def _changes(name: str) -> Column:
    """How often neighbours in an array differ."""
    pairs = F.zip_with(F.slice(name, F.lit(1), F.size(name) - 1), F.slice(name, F.lit(2), F.size(name) - 1), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x).cast("double")


def text_key(text: Column) -> Column:
    return F.concat_ws(":", F.xxhash64(text).cast("string"), F.xxhash64(text, F.lit(1)).cast("string"))


def findings(docs: DataFrame, false_share: float = 0.01, least_random: float = 0.001) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are ignored): doc_id,
    ``text_key`` (two hashes of the text), and ``spans``, an array
    of (start, kind_no, end, kind) in code points, end exclusive, by start and then kind
    as listed. Null and empty texts have no spans."""
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("text_key"),
    )
    every = F.concat(*(_found(k) for k in range(len(KINDS))))
    matches = stored(base.select("row", "doc_id", "text_key", F.explode_outer(every).alias("x")).select("row", "doc_id", "text_key", "x.*"), "secret-matches")
    earlier = Window.partitionBy("row", "kind").orderBy("i")
    placed = (
        matches.withColumn("start", F.sum("gap").over(earlier) + F.sum("length").over(earlier) - F.col("length"))
        .withColumn("end", F.col("start") + F.col("length"))
    )
    known = (F.col("kind") != 0) | (F.length(F.regexp_extract("match", ASSIGN, 2)) >= 6)
    tested = _battery(matches.filter("kind = 3")).filter(F.col("p_random") >= least_random)
    tested = stored(
        tested.select(
            "row", "i", F.floor(F.log2("n")).cast("int").alias("size"),
            F.least(F.lit(LEVELS - 1), F.floor(-F.log2("p_plain"))).cast("int").alias("level"),
        ),
        "secret-runs",
    )
    # Benjamini-Hochberg by counts: LEVELS rows a class of lengths, so a fixed table of at most 32 x LEVELS rows.
    by_level = tested.groupBy("size", "level").agg(F.count(F.lit(1)).alias("n"))
    down, whole = Window.partitionBy("size").orderBy(F.desc("level")), Window.partitionBy("size")
    # classes of lengths are those of the tested runs, that is without the padding at the end
    padded = F.length(F.regexp_extract("match", "=*$", 0))
    tests = matches.filter("kind = 3").groupBy(F.floor(F.log2(F.col("length") - padded)).cast("int").alias("size")).agg(F.count(F.lit(1)).alias("tests"))
    limits = (
        by_level.withColumn("found", F.sum("n").over(down))
        .join(tests, "size")
        .filter(F.pow(F.lit(2.0), -F.col("level").cast("double")) * F.col("tests") <= false_share * F.col("found"))
        .groupBy("size")
        .agg(F.min("level").alias("limit"))
    )
    random = tested.join(F.broadcast(limits), "size").filter("level >= limit").select("row", "i", F.lit(3).alias("kind"), F.lit(True).alias("chosen"))
    kept = (
        placed.join(random, ["row", "i", "kind"], "left")
        .withColumn("good", F.col("kind").isNotNull() & known & ((F.col("kind") != 3) | F.coalesce("chosen", F.lit(False))))
        .filter(F.col("good") | F.col("i").isNull() | (F.col("i") == 0))
    )
    # A random run inside a span of a base kind says nothing new.
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("good") & (F.col("kind") < 3), F.col("end"))).over(before)
    inside = (F.col("kind") == 3) & (F.coalesce(reach, F.lit(0)) >= F.col("end"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("kind").alias("kind_no"), F.col("end").cast("long").alias("end"), name.alias("kind"))
    return (
        kept.withColumn("new", F.col("good") & ~inside)
        .groupBy("row", "doc_id", "text_key")
        .agg(F.array_sort(F.collect_list(F.when(F.col("new"), span))).alias("spans"))
        .drop("row")
    )


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (as text) of ``findings``."""
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(F.encode(said(base), "utf-8"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))



def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``findings`` in its text replaced by ``mark``; spans that
    touch or overlap are replaced once. Other columns stay as they are, whatever their
    names. Null and empty texts stay. Spans depend on the text alone, so they meet their
    rows by two hashes of it, and copies of a text share one row of spans."""
    found = findings(docs.select(F.lit(None).cast("long").alias("doc_id"), "text")).filter(F.size("spans") > 0)
    spans = stored(found.groupBy("text_key").agg(F.first("spans").alias("spans")), "secret-spans")
    doc = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), text_key(F.col("text")).alias("text_key"))
    text, last = F.col("doc.text"), F.element_at("merged", -1)
    merged = F.aggregate(
        "spans", F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["start"]), F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.named_struct(F.lit("start"), F.get(done, F.size(done) - 1)["start"], F.lit("end"), F.greatest(F.get(done, F.size(done) - 1)["end"], s["end"]))),
        )).otherwise(F.concat(done, F.array(F.named_struct(F.lit("start"), s["start"], F.lit("end"), s["end"])))),
    )
    before = F.transform("merged", lambda s, i: F.substring(
        text, F.coalesce(F.get("merged", i - 1)["end"], F.lit(0)).cast("int") + 1,
        (s["start"] - F.coalesce(F.get("merged", i - 1)["end"], F.lit(0))).cast("int"),
    ))
    rest = F.substring(text, last["end"].cast("int") + 1, F.length(text))
    clean = F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.array_join(before, mark), F.lit(mark), rest))
    # texts without spans stay where they are
    maybe, clear = parted(doc, spans, "text_key")
    joined = maybe.join(spans, "text_key", "left").withColumn("merged", merged)
    names = docs.columns
    changed = joined.select(*((clean if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in names))
    return clear.select("doc.*").union(changed)
