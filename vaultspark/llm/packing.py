"""Packing tokenised documents into sequences of fixed capacity by best-fit decreasing.

A document is first cut into full windows; each is a sequence of its own. What remains of each document, shorter than a
window, is packed best fit, longest first: a segment tree indexed by remaining capacity (0 to the capacity) holds which
capacities have an open sequence, and the tightest one that fits is found in log(capacity) steps. Every task packs the
documents of its own partition, so nothing is shuffled; a task leaves at most one badly filled sequence per flush.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm.common import table
from vaultspark.llm.tokens import encoder

CAPACITY = 1024
#: A task packs what it holds once it has so many remainders, which bounds its memory.
HELD = 100_000
#: Rows given to Spark at once.
ROWS = 4096


class OpenSequences:
    """Open sequences by remaining capacity, under a segment tree whose leaf r is set if a sequence with r left is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int, on: int) -> None:
        i = room + self.size
        self.tree[i] = on
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def add(self, room: int, sequence: int) -> None:
        heapq.heappush(self.at[room], sequence)
        if len(self.at[room]) == 1:
            self._mark(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The room and number of the tightest open sequence with room for length; it is closed."""
        i = length + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):  # climb until a set subtree lies to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        sequence = heapq.heappop(self.at[room])
        if not self.at[room]:
            self._mark(room, 0)
        return room, sequence


def best_fit_decreasing(lengths: np.ndarray, capacity: int, first: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The sequence and offset of each piece (1 <= length <= capacity), sequences numbered from first, and the next number."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if not len(lengths):
        return sequence, offset, first
    open_ = OpenSequences(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room, number = open_.take(n) or (capacity, first)
        first += number == first
        sequence[i], offset[i] = number, capacity - room
        if room > n:
            open_.add(room - n, number)
    return sequence, offset, first


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids_crc32 (of its ids as little-endian
    unsigned 32-bit integers), doc_tokens (with the end id), sequence_id, offset and, if asked for, ids.

    docs needs doc_id and text. A null or empty text is the end id alone; rows with the same doc_id, null included, are
    documents of their own. sequence_id is the task's number times 2^33 plus a count, so unique but not gapless. An empty
    table gives an empty result.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    end = end_id.to_bytes(4, "little")

    def run(batches):
        enc, number = encoder(path), TaskContext.get().partitionId() << 33
        rest: list[tuple] = []

        def rows(pieces, sequences, offsets):
            for at in range(0, len(pieces), ROWS):
                doc_id, start, length, crc, total, ids = zip(*pieces[at : at + ROWS])
                cols = [doc_id, start, length, crc, total, sequences[at : at + ROWS], offsets[at : at + ROWS]]
                arrays = [pa.array(c, pa.int64()) for c in cols]
                if with_ids:
                    edges = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                yield pa.RecordBatch.from_arrays(arrays, names)

        def flush():
            nonlocal number, rest
            sequences, offsets, number = best_fit_decreasing(np.array([p[2] for p in rest], np.int64), capacity, number)
            yield from rows(rest, sequences, offsets)
            rest = []

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, full = batch.slice(at, 256), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = enc.encode(text or "") + end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        n = len(piece) // 4
                        (full if n == capacity else rest).append((doc_id, start, n, zlib.crc32(piece), total, piece if with_ids else None))
                yield from rows(full, np.arange(number, number + len(full)), np.zeros(len(full), np.int64))
                number += len(full)
                if len(rest) >= HELD:
                    yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, with_ids=False)
