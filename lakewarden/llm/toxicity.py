"""Toxicity by a weighted grammar of clauses.

Words become symbols (insult with a weight class, threat, target, negation, reported
speech). Small transducers follow negation, reported speech and target through a
clause; their composition scores each insult or threat by the state it meets, and, as a
target may follow, by the state at the clause's end. The
insult lexicon and the weight of each kind of match are learned from labels.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import held_out, stored

OTHER, END, NEGATION, REPORT, TARGET, THREAT, INSULT = 0, 1, 2, 3, 4, 5, 16
#: Insults have the symbols INSULT to INSULT + LEVELS - 1, by weight.
LEVELS = 16

#: Function words of the grammar.
NEGATIONS = "not no never none isn't wasn't don't nicht kein keine nie pas jamais non nunca jamás"
REPORTS = "said says say called calls wrote writes quoted sagte sagt nannte dit écrit appelé dijo dice llamó escribió"
TARGETS = "you your yours u he she him her they them du dich dein ihr sie tu toi vous ton tú usted te ti"
THREATS = "kill hurt destroy burn shoot stab töten umbringen tuer frapper matar golpear"

#: Letters in lower case, clause ends as byte 1, other ASCII but the apostrophe as spaces.
CLAUSES = bytes(
    b + 32 if 65 <= b <= 90 else 1 if b in b".!?;\n" else b if b >= 128 or 97 <= b <= 122 or b == 39 else 32 for b in range(256)
)
#: All but "negated" and "reported" count what is neither; "targeted" and "threat" have their target before them, "aimed" and "aimed_threat" anywhere in the clause.
FEATURES = ("plain", "negated", "reported", "targeted", "threat", "strongest", "count", "aimed", "aimed_threat")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(CLAUSES).replace(b"\1", b" \1 ").split()


# A transducer: start state, {state: {symbol: state}}; other symbols keep the state.
NEGATING = ("plain", {"plain": {NEGATION: "negated"}, "negated": {END: "plain"}})
REPORTING = ("own", {"own": {REPORT: "reported"}, "reported": {END: "own"}})
TARGETING = ("none", {"none": {TARGET: "targeted"}, "targeted": {END: "none"}})


def compose(*machines) -> tuple[tuple, dict[tuple, dict[int, tuple]]]:
    """The product of transducers that read the same symbols."""
    start = tuple(m[0] for m in machines)
    table, todo = {}, [start]
    symbols = {s for _, moves in machines for edges in moves.values() for s in edges}
    while todo:
        state = todo.pop()
        if state in table:
            continue
        table[state] = {}
        for symbol in symbols:
            after = tuple(m[1].get(at, {}).get(symbol, at) for m, at in zip(machines, state, strict=True))
            if after != state:
                table[state][symbol] = after
                todo.append(after)
    return start, table


class Symbols(dict):
    """Word to symbol; the lexicon has whole words and stems (their first letters).
    Words met are kept, ``size`` of them at most."""

    def __init__(self, lexicon: dict[bytes, float], size: int = 300_000):
        self.lexicon, self.size = lexicon, size
        self.fixed = {b"\1": END}
        for symbol, words in ((NEGATION, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS), (THREAT, THREATS)):
            self.fixed |= {w.encode(): symbol for w in words.split()}

    def __missing__(self, word: bytes) -> int:
        symbol = self.fixed.get(word, OTHER)
        if symbol != END:
            weight = max((self.lexicon.get(f, 0.0) for f in features_of(word)), default=0.0)
            if weight > 0:
                symbol = INSULT + min(LEVELS - 1, int(weight * 2))
        if len(self) >= self.size:
            self.clear()
        self[word] = symbol
        return symbol


def features_of(word: bytes) -> list[bytes]:
    """The word, and its stems of 4 to 6 letters (written with a trailing hyphen)."""
    if len(word) < 5:
        return [word]
    letters = word.decode("utf-8", "replace")
    return [word, *((letters[:n] + "-").encode() for n in (4, 5, 6) if len(letters) > n)]


@dataclass
class Model:
    lexicon: dict[bytes, float]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.symbols = Symbols(self.lexicon)
        self.grammar = compose(NEGATING, REPORTING, TARGETING)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("lexicon", "weights", "bias")}

    def __setstate__(self, state):
        self.__init__(**state)

    def matches(self, text: str | None) -> np.ndarray:
        """Sums over the matched clauses, in the order of FEATURES."""
        out = np.zeros(len(FEATURES))
        marks = bytes(map(self.symbols.__getitem__, words_of(text)))
        if not marks or max(marks) < THREAT:
            return out
        start, table = self.grammar
        for clause in marks.split(b"\1"):
            if not clause or max(clause) < THREAT:
                continue
            state, insults, threats = start, 0.0, 0
            for symbol in clause:
                state = table[state].get(symbol, state)
                if symbol < THREAT:
                    continue
                negated, reported, targeted = (a != b for a, b in zip(state, start, strict=True))
                meant = not (negated or reported)
                if symbol == THREAT:
                    out[4] += targeted and meant
                    threats += meant
                    continue
                weight = (symbol - INSULT + 1) / 2
                out[1 if negated else 2 if reported else 0] += weight
                if not meant:
                    continue
                out[3] += weight * targeted
                out[5] = max(out[5], weight)
                out[6] += 1
                insults += weight
            if state[-1] != start[-1]:
                out[7] += insults
                out[8] += threats
        out[:5] = np.log1p(out[:5])
        out[6:] = np.log1p(out[6:])
        return out

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.matches(text) @ self.weights + self.bias, -30, 30))))


def fit(
    docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = 20_000, entries: int = 512, least: int = 5
) -> Model:
    """A model from at most ``sample`` labelled rows, those with the smallest hash of
    doc_id among the labels where ``may_learn`` holds; their whole texts are read. A
    doc_id labelled twice is toxic if either label is. The lexicon has at most
    ``entries`` entries, each in ``least`` toxic documents or more. Without toxic or
    without clean rows nothing is learned and every score is the share of toxic rows
    (0 if there are none)."""
    rows = (
        labels.filter(may_learn & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # ``sample`` rows of 12 bytes at most: the broadcast is bounded.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")
    texts = stored(texts.select("text", "toxic"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[toxic > 0].update({f for w in set(words_of(text.as_py())) for f in features_of(w)})
        both = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(both, pa.binary()), *(pa.array([c[f] for f in both], pa.int64()) for c in seen)], ["feature", "clean", "toxic"]
        )

    totals = {bool(r["toxic"]): r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_clean:
        return Model({}, np.zeros(len(FEATURES)), 30.0 if n_toxic else -30.0)
    odds = F.log(((F.col("toxic") + 0.5) / n_toxic) / ((F.col("clean") + 0.5) / n_clean))
    stats = texts.mapInArrow(count, "feature binary, clean long, toxic long").groupBy("feature")
    lexicon = {
        bytes(r["feature"]): r["odds"]
        for r in stats.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("toxic") >= least)
        .withColumn("odds", odds)
        .filter(F.col("odds") > math.log(8))
        .orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "feature")
        .limit(entries)
        .collect()
    }
    bare = Model(lexicon, np.zeros(len(FEATURES)), 0.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [bare.matches(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in rows], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    found = texts.mapInArrow(measure, "x array<double>, y int").groupBy("x", "y").count().collect()  # sample rows at most
    x, y = np.array([r["x"] for r in found]), np.array([r["y"] > 0 for r in found], float)
    return Model(lexicon, *_logistic(x, y, np.array([r["count"] for r in found], float)))


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (times * (p - y)) + penalty * w
        curve = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def score_of(fitted: Model, spark: SparkSession):
    """A column function from text to score (0 to 1; a null or empty text counts as one
    without matches)."""
    shared = spark.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        found = shared.value
        return pd.Series([found.score(t) for t in texts], dtype="float64")

    return score


def predictions(docs: DataFrame, fitted: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text; other
    columns are ignored); a null or empty text has a score as well; repeated rows are answered
    each on its own, and a null doc_id is held out."""
    doc_id = F.col("doc_id").cast("long")
    scores = docs.select(doc_id.alias("doc_id"), score_of(fitted, docs.sparkSession)("text").alias("score"))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
