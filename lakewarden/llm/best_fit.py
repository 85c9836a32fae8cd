"""Best-fit packing by sums of squares.

A document goes into a sequence as a whole; only one longer than the capacity is cut. Each
worker keeps, for every residual gap, how many of its open sequences have that gap. A piece
goes where the sum of the squares of these counts becomes smallest, be it an open sequence
or a new one: no gap is left in many copies, so that there is nearly always one that the
next piece fills. Among equal sums the tightest sequence is taken. A place is final at
once, so pieces stream through, nothing is shuffled and only open sequences are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.tokens import token_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
_NAMES = [c.split()[0] for c in PIECES.split(", ")]
#: Rows of one Arrow batch handed back.
BATCH = 8192
_TAKEN = np.iinfo(np.int64).max


class Bins:
    """Sequences of one worker. ``counts[g]`` is the number of open ones with a gap of g;
    full and untouched sequences have no part in the sum."""

    def __init__(self, capacity: int, first_sequence: int = 0):
        self.capacity, self.next = capacity, first_sequence
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}

    def _gap_for(self, length: int) -> int:
        """The gap to use, ``capacity`` for a new sequence."""
        used, left = self.counts[length:], self.counts[: self.capacity + 1 - length]
        # (left + 1)^2 - left^2 + (used - 1)^2 - used^2
        change = 2 * (left - used) + 2
        change[0] -= 1  # a sequence that gets full adds no gap
        change[-1] -= 1  # a new one takes none away
        change[:-1][used[:-1] == 0] = _TAKEN
        return length + int(np.argmin(change))

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of 1 to ``capacity`` ids."""
        gap = self.capacity if length == self.capacity else self._gap_for(length)
        if gap == self.capacity:
            sequence = self.next
            self.next += 1
        else:
            self.counts[gap] -= 1
            sequence = self.open[gap].pop()
        if gap > length:
            self.counts[gap - length] += 1
            self.open.setdefault(gap - length, []).append(sequence)
        return sequence, self.capacity - gap


def pack_whole(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, cache_size: int = 300_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty text is the
    end id alone. A document of more than ``capacity`` ids is cut into whole sequences but
    for its first piece, which may be shorter; all others have one piece. Rows that repeat
    a doc_id, or have a null one, are documents of their own. An empty table gives no rows.
    ``sequence_id`` is unique, with the worker's partition in the upper bits. A recomputed
    task reads the same rows of a table in the same order and packs them alike."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, bins = token_ids(tokenizer, cache_size), Bins(capacity, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, _NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(ids_of(text.as_py()) + end)
                total, start, piece = len(ids) // 4, 0, 0
                while start < total:
                    length = (total - start - 1) % capacity + 1 if start == 0 else capacity
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((doc_id, piece, start, length, crc, *bins.place(length)))
                    start, piece = start + length, piece + 1
                if len(rows) >= BATCH:
                    yield out()
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)
