"""Questions in plain words matched to catalog metrics."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.pii import redact_text
from lakewarden.functions.text import col
from lakewarden.operators.metrics import render_requests

# Words that carry no signal, score threshold, shortlist size,
# caps, quote folding and binding patterns.
STOPWORDS = [
    "the", "a", "an", "of", "for", "in", "on", "by", "to", "and", "or", "is",
    "are", "was", "were", "what", "which", "who", "how", "many", "much",
    "show", "me", "list", "give", "get", "per", "with", "all", "from", "our",
]
CONFIDENT_SCORE = 3
SHORTLIST = 5
QUOTES = {"“": '"', "”": '"', "‘": "'", "’": "'"}
PAIR = r"\b(\w+)\s*[:=]\s*(?:\"([^\"]*)\"|'([^']*)'|([\w.@-]+))"
QUOTED = r"(?<!\w)\"([^\"]+)\"(?!\w)|(?<!\w)'([^']+)'(?!\w)"
NUMBER = r"(?<![\w.])-?\d+(?:\.\d+)?(?![\w.])"


def words(text: Column | str) -> Column:
    """Distinct signal words, plural forms folded."""
    found = F.regexp_extract_all(F.lower(F.translate(col(text), "_-", "  ")), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS))

    def fold(w: Column) -> Column:
        size = F.length(w)
        return (
            F.when(w.endswith("ies") & (size > 4), F.concat(F.substring(w, F.lit(1), size - 3), F.lit("y")))
            .when(w.endswith("s") & ~w.endswith("ss") & (size > 3), F.substring(w, F.lit(1), size - 1))
            .otherwise(w)
        )

    return F.array_sort(F.array_distinct(F.transform(kept, fold)))


def _rank_sets(questions: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bag, used) for every distinct word set of `questions` that shares a word with a
    metric, and (bag, metric_id, name, score, rank) for every distinct `used`, as bag.

    Words that no metric has (numbers, quoted values) score nothing, so word sets that
    differ in them only are scored once: what is scored grows with the catalog's words,
    not with the questions.
    """
    bags = questions.select(words("question").alias("bag")).distinct()
    weighed = metrics.select("id", "name", F.explode(words("name")).alias("word"), F.lit(2).alias("weight")).unionByName(
        metrics.select("id", "name", F.explode(words("description")).alias("word"), F.lit(1).alias("weight"))
    )
    index = weighed.groupBy("word", "id", "name").agg(F.sum("weight").alias("weight"))
    used = (
        bags.select("bag", F.explode("bag").alias("word"))
        .join(weighed.select("word").distinct(), "word", "left_semi")
        .groupBy("bag")
        .agg(F.array_sort(F.collect_list("word")).alias("used"))
    )
    scored = (
        used.select(F.col("used").alias("bag")).distinct()
        .select("bag", F.explode("bag").alias("word"))
        .join(index, "word")
        .groupBy("bag", F.col("id").alias("metric_id"), "name")
        .agg(F.sum("weight").alias("score"))
    )
    # One group holds at most the catalog's metrics.
    order = Window.partitionBy("bag").orderBy(F.desc("score"), "name", "metric_id")
    return used, scored.withColumn("rank", F.row_number().over(order))


def _per_bag(used: DataFrame, of_sets: DataFrame) -> DataFrame:
    """What was found for sets of catalog words, for every word set that uses them."""
    return used.join(of_sets.withColumnRenamed("bag", "used"), "used").drop("used")


def rank_metrics(questions: DataFrame, metrics: DataFrame) -> DataFrame:
    """(bag, metric_id, name, score, rank) for every distinct word set of
    `questions` (column question). Join back on `bag = words(question)`.

    A name word counts two and a description word one; ties rank by name.
    Questions with equal catalog words are scored once.
    """
    return _per_bag(*_rank_sets(questions, metrics))


def shortlist(ranked: DataFrame) -> DataFrame:
    """(bag, top, candidates, confident): best metric, up to five names, and
    whether the best clearly wins."""
    best = ranked.filter(F.col("rank") <= SHORTLIST)
    folded = best.groupBy("bag").agg(
        F.array_sort(F.collect_list(F.struct("rank", "metric_id", "name", "score"))).alias("best")
    )
    first, second = F.col("best")[0], F.get("best", F.lit(1))
    clear = second.isNull() | (first["score"] > second["score"])
    return folded.select(
        "bag",
        first.alias("top"),
        F.transform("best", lambda b: b["name"]).alias("candidates"),
        ((first["score"] >= CONFIDENT_SCORE) & clear).alias("confident"),
    )


def _parsed(text: str) -> int | float:
    return float(text) if "." in text else int(text)


def bind_words(question: str, specs: list[dict]) -> dict[str, str]:
    """Parameter values a question spells out, as JSON texts by name."""
    text = question.translate(str.maketrans(QUOTES))
    used = bytearray(len(text))
    bound: dict[str, str] = {}

    def take(m: re.Match) -> None:
        used[m.start():m.end()] = b"\x01" * (m.end() - m.start())

    def free(pattern: str) -> list[re.Match]:
        return [m for m in re.finditer(pattern, text) if not any(used[m.start():m.end()])]

    def open_specs(kind: str) -> list[dict]:
        return [s for s in specs if s["type"] == kind and s["name"] not in bound]

    for m in re.finditer(PAIR, text):
        take(m)
        said = next(v for v in m.groups()[1:] if v is not None)
        wanted = m[1].lower()
        spec = next((s for s in specs if s["name"].lower() == wanted and s["name"] not in bound), None)
        if spec is None:
            continue
        try:
            bound[spec["name"]] = json.dumps(_parsed(said) if spec["type"] == "number" else said)
        except ValueError:
            continue
    literals = free(QUOTED)
    for m in literals:
        take(m)
    for spec, m in zip(open_specs("string"), literals):
        bound[spec["name"]] = json.dumps(m[1] or m[2])
    for spec, m in zip(open_specs("number"), free(NUMBER)):
        bound[spec["name"]] = json.dumps(_parsed(m[0]))
    return bound


@F.pandas_udf(T.StringType())
def _bind(questions: pd.Series, specs: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(bind_words(q, json.loads(s))) for q, s in zip(questions, specs)])


def bind_parameters(matched: DataFrame) -> DataFrame:
    """Adds `bound` (map of JSON texts) and `missing` (names) to rows with a
    question and its metric's params. Span bookkeeping is Python's job; only
    matched rows with parameters get here."""
    none = F.create_map().cast("map<string,string>")
    plain = matched.filter(F.size("params") == 0).withColumn("bound", none)
    spelled = matched.filter(F.size("params") > 0).withColumn(
        "bound", F.from_json(_bind(F.col("question"), F.to_json("params")), "map<string,string>")
    )
    missing = F.filter(
        "params", lambda p: ~p["has_default"] & ~F.array_contains(F.map_keys("bound"), p["name"])
    )
    return spelled.unionByName(plain).withColumn("missing", F.transform(missing, lambda p: p["name"]))


def route_questions(questions: DataFrame, metrics: DataFrame, *, max_chars: int | None = None) -> DataFrame:
    """Decide every question: the request to run, or why there is no answer.

    Questions: question_id, question. `metrics` are those the asker may see;
    only approved ones are considered. Columns: question_id, question
    (redacted), answered, metric_id, metric, bound, request, reason,
    candidates (up to five names).
    """
    approved = metrics.filter(F.col("status") == "approved")
    if max_chars is not None:
        questions = questions.withColumn("question", F.substring("question", 1, max_chars))
    used, ranked = _rank_sets(questions, approved)
    chosen = _per_bag(used, shortlist(ranked))
    looked = questions.withColumn("bag", words("question")).join(chosen, "bag", "left")
    specs = approved.select(F.col("id").alias("__id"), "template", "params", "status")
    sure = looked.filter(F.col("confident")).join(specs, F.col("top.metric_id") == F.col("__id"))
    tried = render_requests(bind_parameters(sure))
    lacks = F.size("missing") > 0
    only_top = F.array(F.col("top.name"))
    needs = F.concat(
        F.lit("metric '"), F.col("top.name"), F.lit("' matches but needs parameters: ['"),
        F.array_join("missing", "', '"), F.lit("']"),
    )
    runs = ~lacks & F.col("error").isNull()
    decided = tried.select(
        "question_id", "question", runs.alias("answered"),
        F.when(~lacks, F.col("top.metric_id")).alias("metric_id"), F.when(~lacks, F.col("top.name")).alias("metric"),
        F.when(runs, F.col("bound")).alias("bound"), F.when(runs, F.col("request")).alias("request"),
        F.when(lacks, needs).when(~runs, redact_text("error")).alias("reason"),
        F.when(runs, F.array().cast("array<string>")).otherwise(only_top).alias("candidates"),
    )
    n = F.size("candidates")
    unsure = looked.filter(~F.coalesce("confident", F.lit(False))).select(
        "question_id", "question", F.lit(False).alias("answered"), F.lit(None).cast("string").alias("metric_id"),
        F.lit(None).cast("string").alias("metric"), F.lit(None).cast("map<string,string>").alias("bound"),
        F.lit(None).cast("string").alias("request"),
        F.when(F.col("top").isNull(), "no approved metric matches this question")
        .when(n == 1, F.concat(F.lit("metric '"), F.col("top.name"), F.lit("' matches only weakly — not executing")))
        .otherwise("no clear best match among the candidate metrics")
        .alias("reason"),
        F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"),
    )
    return decided.unionByName(unsure).withColumn("question", redact_text("question"))
