"""Packing token ids into sequences of a fixed capacity by minimum bin slack.

Every task packs the documents of its own partition, window by window. Full
pieces of a long document are sequences of their own. The remaining tails wait
in a pool by length. A sequence starts with the longest tail; the rest of it is
the multiset of tails whose lengths sum closest to the room left, found by
subset-sum dynamic programming over bit sets (bit *s*: sum *s* can be reached)
and read off by backtracking the counts.

Edge cases: a null text is empty and has its end id alone. Repeated rows and
equal ids are packed as often as they come. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import worker_encoder

CAPACITY = 2048
#: Ids that may wait in the pool of a task (4 bytes each); sequences are filled down to half of it.
WINDOW_IDS = 1 << 21
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
NAMES = [c.split()[0] for c in PIECE.split(", ")]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) whose sum is closest to ``room`` without exceeding it."""
    reached, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        layers.append((length, reached))
        left, step = min(counts[length], room // length), 1
        while left:  # counts in powers of two
            step = min(step, left)
            reached |= (reached << (length * step)) & mask
            left, step = left - step, step * 2
        if reached >> room:
            break
    goal, chosen = reached.bit_length() - 1, {}
    for length, before in reversed(layers):
        n = 0
        while not before >> goal & 1:
            goal, n = goal - length, n + 1
        if n:
            chosen[length] = n
    return chosen


class Packer:
    """Fills sequences from a pool of tails; yields pieces (sequence, offset, tail)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.pool, self.counts, self.waiting, self.sequences = capacity, {}, {}, 0, 0

    def add(self, tail: tuple, length: int) -> None:
        self.pool.setdefault(length, []).append(tail)
        self.counts[length] = self.counts.get(length, 0) + 1
        self.waiting += length

    def _take(self, length: int) -> tuple:
        self.counts[length] -= 1
        self.waiting -= length
        tail = self.pool[length].pop()
        if not self.counts[length]:
            del self.counts[length], self.pool[length]
        return tail

    def fill(self, down_to: int = 0) -> Iterator[tuple]:
        while self.waiting > down_to:
            longest = max(self.counts)
            first = self._take(longest)
            offset = 0
            tails = [(longest, first)] + [(n, self._take(n)) for n, k in fullest(self.counts, self.capacity - longest).items() for _ in range(k)]
            for length, tail in tails:
                yield self.sequences, offset, tail
                offset += length
            self.sequences += 1


def _packed(end_id: int, capacity: int, tokenizer: str | None, window_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, out = worker_encoder(tokenizer), Packer(capacity), []
        base = TaskContext.get().partitionId() << 40  # sequence ids of a task follow its base

        def piece(sequence, offset, tail):
            key, ids, start, total = tail
            out.append((key, start, len(ids), zlib.crc32(ids.tobytes()), total, base + sequence, offset))

        def table():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], names=NAMES)
            out.clear()
            return batch

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(keys), 256):
                for key, ids in zip(keys[lo:lo + 256], encoder.encode(texts[lo:lo + 256])):
                    ids = np.append(ids, np.uint32(end_id))
                    whole = len(ids) // capacity * capacity
                    for start in range(0, whole, capacity):
                        piece(packer.sequences, 0, (key, ids[start:start + capacity], start, len(ids)))
                        packer.sequences += 1
                    if whole < len(ids):
                        packer.add((key, ids[whole:].copy(), whole, len(ids)), len(ids) - whole)
                if packer.waiting > window_ids:
                    for found in packer.fill(window_ids // 2):
                        piece(*found)
                yield table()
        for found in packer.fill():
            piece(*found)
        yield table()

    return run


def pack(docs: DataFrame, end_id: int = 1, capacity: int = CAPACITY, tokenizer: str | None = None, window_ids: int = WINDOW_IDS,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids: one pass over the input, without a shuffle."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_packed(end_id, capacity, tokenizer, window_ids), PIECE)


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_sequences, n_ids, n_padding) of packed pieces; a sequence as long as a power of two is not padded."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return per.agg(F.count("*").alias("n_sequences"), F.sum("n").alias("n_ids"), F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))).alias("n_padding"))
