"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A file set is a Parquet folder of blocks. Each block's ``payload`` is one
self-contained binary image: header, Elias-Fano boundaries with select samples,
then the ids of the block's documents. Parquet gives atomic commits on any store
that Spark reaches; the image is the format that a loader maps.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewarden.llm.common import shuffle_partitions
from lakewarden.llm.tokens import token_ids

MAGIC = b"LWT1"
HEADER = "<4sBBIQIII"  # magic, id bytes, low bits, documents, ids, low, high and sample bytes
#: One select sample for so many documents.
SAMPLE = 64

BLOCKS = "part int, block int, before long, n_ids long, doc_ids array<long>, payload binary"
DOCUMENTS = "part int, block int, position int, doc_id long, start long, n_tokens long, ids_crc32 long"
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


class EliasFano:
    """Non-decreasing integers in about 2 + log2(u / n) bits each, with select."""

    def __init__(self, low_bits: int, n: int, low: bytes, high: bytes, samples: bytes):
        self.low_bits, self.n = low_bits, n
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n and values[-1] > 0 else 0
        bits = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(
            low_bits, n, np.packbits(bits.ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes(),
        )

    def select(self, k: int) -> int:
        """The k-th value: a jump to the nearest sample, then a count of set bits."""
        at, left = int(self.samples[k // SAMPLE]), k % SAMPLE
        if left:
            byte = at >> 3
            counts = _POPCOUNT[self.high[byte : byte + 1] >> np.uint8(at & 7)].astype(int)
            left += 1  # the sample's own bit counts
            seen = int(counts[0])
            start = at & 7
            while seen < left:
                left -= seen
                byte, start = byte + 1, 0
                seen = int(_POPCOUNT[self.high[byte]])
            ones = np.flatnonzero((int(self.high[byte]) >> np.arange(start, 8)) & 1)
            at = (byte << 3) + start + int(ones[left - 1])
        value = (at - k) << self.low_bits
        for j in range(self.low_bits):
            bit = k * self.low_bits + j
            value |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << j
        return value

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1) if self.low_bits else 0
        return ((ones - np.arange(self.n)) << self.low_bits) | low

    def size(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


def write_image(parts: list[bytes]) -> bytes:
    """The binary image of documents given as packed 32-bit ids."""
    lengths = np.fromiter((len(p) // 4 for p in parts), dtype=np.int64, count=len(parts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.frombuffer(b"".join(parts), "<u4")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    ef = EliasFano.encode(bounds)
    low, high, samples = ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes()
    head = struct.pack(HEADER, MAGIC, width, ef.low_bits, len(parts), len(ids), len(low), len(high), len(samples))
    return b"".join((head, low, high, samples, ids.astype(f"<u{width}").tobytes()))


def read_image(payload: bytes) -> tuple[EliasFano, np.ndarray]:
    """Boundaries (documents + 1 values) and ids of an image."""
    magic, width, low_bits, n, n_ids, low, high, samples = struct.unpack_from(HEADER, payload)
    if magic != MAGIC:
        raise ValueError("not a token image")
    at = struct.calcsize(HEADER)
    ends = np.cumsum([at, low, high, samples]).tolist()
    ef = EliasFano(low_bits, n + 1, *(payload[a:b] for a, b in zip(ends, ends[1:], strict=False)))
    return ef, np.frombuffer(payload, f"<u{width}", count=n_ids, offset=ends[3])


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_ids: int = 1 << 20, partitions: int | None = None
) -> None:
    """Encode every whole text, append ``end_id``, and write blocks in ascending
    doc_id order under ``path``. ``docs`` needs doc_id and text; other columns are
    ignored. A null or empty text is the end id alone. A null doc_id sorts first;
    rows that repeat a doc_id are documents of their own, ordered by a hash of the
    text (equal rows are interchangeable). An empty table gives an empty folder."""
    n = partitions or shuffle_partitions(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = token_ids(tokenizer), TaskContext.get().partitionId()
        held, ids, size, block, before = [], [], 0, 0, 0

        def flush():
            nonlocal held, ids, size, block, before
            row = [part], [block], [before], [size // 4], pa.array([ids], pa.list_(pa.int64())), [write_image(held)]
            before, block = before + size // 4, block + 1
            held, ids, size = [], [], 0
            names = ["part", "block", "before", "n_ids", "doc_ids", "payload"]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = ids_of(text.as_py()) + end
                held.append(packed)
                ids.append(doc_id)
                size += len(packed)
                if size >= 4 * block_ids:
                    yield flush()
        if held:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(encode, BLOCKS)
        .write.parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it),
    n_tokens and the crc32 of its ids. Sums over blocks of a part are kept in the
    blocks; the running sum over parts has one row per part, a few thousand at most,
    which bounds its one-task window and its broadcast."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ef, ids = read_image(row["payload"])
                bounds, ids = ef.decode(), ids.astype("<u4")
                n = len(row["doc_ids"])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["block"], np.int32)),
                        pa.array(np.arange(n, dtype=np.int32)), pa.array(row["doc_ids"], pa.int64()),
                        pa.array(bounds[:-1] + row["before"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()),
                    ],
                    ["part", "block", "position", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))
    return (
        blocks.select("part", "block", "before", "doc_ids", "payload")
        .mapInArrow(decode, DOCUMENTS)
        .join(F.broadcast(bases), "part")
        .select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "part", "block", "position")
    )
