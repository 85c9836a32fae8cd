"""Harmonic packing of token sequences.

A document is cut into pieces whose lengths are reciprocals of the capacity: whole
sequences, then capacity/2, /4, ... down to ``grain``, then one tail shorter than
``grain``. All pieces of one length form a class; a bin of a class takes exactly
floor(capacity / length) of them. Each worker fills the bins of its own partition,
so nothing is shuffled and no worker waits for another. Pieces of a worker's
unfinished bins are joined end to end and cut at the capacity, so a worker leaves
one short sequence at most, and power-of-two bins leave no padding.
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

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)
_TYPES = [pa.int64()] * 7 + [pa.binary()]
_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def cut_lengths(n: int, capacity: int, grain: int) -> list[int]:
    """Piece lengths of a document of n ids: all capacity / 2^j, but for the tail."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= grain and rest >= grain:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] if rest else out


class Packer:
    """Bins of one worker. ``place`` yields pieces of full bins, ``finish`` the rest."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def place(self, piece: tuple) -> Iterator[tuple]:
        length = len(piece[3]) // 4
        held = self.open.setdefault(length, [])
        held.append(piece)
        if len(held) == self.capacity // length:
            yield from self._close(held)
            held.clear()

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc_id, start, doc_tokens, ids in pieces:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, self.next, at, ids
            at += len(ids) // 4
        self.next += 1

    def finish(self) -> Iterator[tuple]:
        held, room = [], self.capacity
        for length in sorted(self.open, reverse=True):
            for doc_id, start, doc_tokens, ids in self.open[length]:
                while ids:
                    part, ids = ids[: 4 * room], ids[4 * room :]
                    held.append((doc_id, start, doc_tokens, part))
                    start += len(part) // 4
                    room -= len(part) // 4
                    if not room:
                        yield from self._close(held)
                        held, room = [], self.capacity
        if held:
            yield from self._close(held)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, grain: int = 16, cache_size: int = 300_000, with_ids: bool = True) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers, which
    stay in the worker unless ``with_ids`` asks for them.

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty text
    is the end id alone. Rows that repeat a doc_id, or have a null one, are packed
    as documents of their own. An empty table gives no rows. ``sequence_id`` is
    unique; it has the worker's partition in the upper bits. A recomputed task
    packs the same rows in the same order."""
    end = np.array([end_id], "<u4").tobytes()
    columns = PIECES.split(", ") if with_ids else PIECES.split(", ")[:-1]
    types, names = _TYPES[: len(columns)], _NAMES[: len(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = token_ids(tokenizer, cache_size), Packer(capacity, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []

        def out(rows):
            # a shorter list of types leaves out the ids, the last column
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, start = ids_of(text.as_py()) + end, 0
                for length in cut_lengths(len(ids) // 4, capacity, grain):
                    rows.extend(packer.place((doc_id, start, len(ids) // 4, ids[4 * start : 4 * (start + length)])))
                    start += length
                if len(rows) >= 4096:
                    yield out(rows)
                    rows = []
        rows.extend(packer.finish())
        if rows:
            yield out(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(columns))


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences: sequence_id, length, ids. A sequence has ``capacity`` ids at
    most, which bounds the group."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )
