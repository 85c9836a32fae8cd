"""Language identification with error-correcting output codes.

Every language has a codeword of +1/-1 bits; one binary n-gram classifier per bit
separates the languages whose codeword has +1 from the others. Decoding sums, over
the bits, the loss of each codeword against the classifiers' margins, weighted by
how well a bit separates the training languages, and takes the nearest codeword.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import held_out

#: Letters in lower case, other ASCII as spaces; bytes of other letters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
UNKNOWN = "und"


def gram_counts(text: str, buckets: int) -> np.ndarray:
    """Counts of the text's byte 3-grams by bucket (a power of two)."""
    b = np.frombuffer(b" " + text.encode("utf-8", "replace").translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    keys = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    slots = (keys * np.uint32(2654435761)) >> np.uint32(32 - (buckets.bit_length() - 1))
    return np.bincount(slots, minlength=buckets)


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """Rows of +1/-1 for each class. Few classes get every split of them once; more
    get 10 log2(classes) random bits, the draw with the largest least distance."""
    if classes <= 1:
        return np.ones((classes, 1), np.int8)
    if classes <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=classes - 1) if -1 in s]
        return np.array([(1, *s) for s in splits], np.int8).T
    bits, rng, best, apart = math.ceil(10 * math.log2(classes)), np.random.default_rng(seed), None, -1
    for _ in range(50):
        draw = rng.choice(np.array([1, -1], np.int8), size=(classes, bits))
        near = draw.astype(int) @ draw.T.astype(int)
        np.fill_diagonal(near, -bits)
        least = (bits - near.max()) // 2
        if least > apart and (np.abs(draw.sum(0)) < classes).all():
            best, apart = draw, least
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, in units of the bit's usual margin
    trust: np.ndarray  # weight of each bit in decoding

    def predict(self, text: str | None, min_gap: float = 0.1) -> tuple[str, float, bool]:
        """Language, score in 0 to 1, and whether the two nearest codewords are close."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        counts = gram_counts(text, len(self.weights))
        n = counts.sum()
        margins = counts @ self.weights / n
        loss = (self.trust * np.log1p(np.exp(-2 * self.codes * np.clip(margins, -8, 8)))).sum(1) / self.trust.sum()
        order = np.argsort(loss, kind="stable")
        gaps = loss - loss[order[0]]
        score = 1 / np.exp(-gaps * min(30.0, 4 + n / 4)).sum()
        ambiguous = len(order) > 1 and gaps[order[1]] < min_gap
        return self.languages[order[0]], float(score), bool(ambiguous)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(docs: DataFrame, may_learn: Column, buckets: int = 4096, max_languages: int = 1024) -> Model:
    """A model from the rows where ``may_learn`` is true and text and lang are not
    null. Each task sums its rows to one count vector a language, and Spark adds
    those; the driver receives at most ``max_languages`` (the most frequent ones)
    times ``buckets`` sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if has_letter(text := text.as_py()):
                    total = sums.setdefault(lang, np.zeros(buckets + 1, np.int64))
                    total[:-1] += gram_counts(text, buckets)
                    total[-1] += 1
        for lang, total in sums.items():
            slots = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(slots)), pa.array(slots.astype(np.int32)), pa.array(total[slots])],
                ["lang", "slot", "n"],
            )

    rows = docs.filter(may_learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    sums = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    by_lang = sums.groupBy("lang").agg(
        F.max(F.when(F.col("slot") == buckets, F.col("n"))).alias("docs"), F.collect_list(F.struct("slot", "n")).alias("counts")
    )
    found = by_lang.orderBy(F.desc("docs"), "lang").limit(max_languages).collect()
    found.sort(key=lambda r: r["lang"])
    return model([r["lang"] for r in found], _matrix(found, buckets))


def _matrix(rows, buckets: int) -> np.ndarray:
    out = np.zeros((len(rows), buckets))
    for at, row in enumerate(rows):
        for slot, n in row["counts"]:
            if slot < buckets:
                out[at, slot] = n
    return out


def model(languages: list[str], counts: np.ndarray) -> Model:
    """Bit classifiers from the languages' n-gram counts: log ratios of the mean
    smoothed frequencies on the two sides."""
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((counts.shape[1], 1)), np.ones(1))
    codes = codewords(len(languages)).astype(float)
    shares = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    up, down = np.maximum(codes, 0), np.maximum(-codes, 0)
    high = shares.T @ (up / np.maximum(up.sum(0), 1))
    low = shares.T @ (down / np.maximum(down.sum(0), 1))
    weights = np.where(low > 0, np.log(np.maximum(high, 1e-12) / np.maximum(low, 1e-12)), 1.0)
    # where the languages themselves stand: margins are centred between the sides and scaled to about 1
    stand = shares @ weights
    top = np.where(codes > 0, stand, np.inf).min(0)
    bottom = np.where(codes < 0, stand, -np.inf).max(0)
    single = ~np.isfinite(bottom)
    centre = np.where(single, 0.0, (top + np.where(single, 0, bottom)) / 2)
    scale = np.where(single, 1.0, np.maximum(np.abs(top - np.where(single, 0, bottom)) / 2, 1e-6))
    trust = np.where(single, 1.0, np.clip(top - np.where(single, 0, bottom), 1e-3, None))
    return Model(languages, codes, (weights - centre) / scale, trust)


def identify(docs: DataFrame, fitted: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``ambiguous`` for each
    row of ``docs`` (doc_id, text; other columns are ignored). Text that is null or
    has no letter is ``und`` with score 0, as is every text when no language was
    learned. Rows that repeat are answered each on its own; a null doc_id is held out."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            rows = [found.predict(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )
