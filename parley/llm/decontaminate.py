"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item of *q* distinct shingles is in a document if at least three quarters
of them are. Whatever those are, the document then has one of any
``q // 4 + 1`` of the item's shingles. The sketch of an item is therefore its
that many smallest shingle hashes (a bottom-k MinHash sketch). Items are
partitioned by size, and within a partition every sketch is as long as its
largest item needs, so the search misses no item. A document of any length
looks up all its shingles in the sketches, and only the items it meets are
verified by exact containment of their shingle sets.

Items are taken in blocks of a bounded number of shingles, whose sketches and
sets are sent to the tasks; the documents are read once for each block and
never shuffled.

An item of fewer than five words is one shingle, its whole word sequence, and
is looked for among the document's runs of as many words.

Edge cases: a null or blank item text has no shingles and is in no document; an
item whose id is null is looked for like any other and comes first in a match list; a null
or blank document has none either. Equal items are all reported. Repeated
documents are reported as often as they come. Empty tables give no matches
(and documents without matches stay as they are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import SHINGLE_WORDS, SIMILAR_PERCENT, ngram_hashes, shingle_set, word_hashes

#: Shingles of the items of a block (8 bytes each, twice); more items make more blocks.
BLOCK_SHINGLES = 1 << 20


def sketch_sizes(sizes: np.ndarray) -> np.ndarray:
    """Sketch length per item: what the largest item of its size partition (powers of two) needs to be found."""
    upper = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    return np.minimum(sizes, upper * (100 - SIMILAR_PERCENT) // 100 + 1)


class Index:
    """Sketches and shingle sets of a block of items, by length of their shingles in words."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]]):
        """items: (item id, words per shingle, sorted distinct shingle hashes)."""
        self.ids = [i for i, _, _ in items]
        self.sets = [s for _, _, s in items]
        self.by_words: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        keep = sketch_sizes(np.array([len(s) for s in self.sets], dtype=np.int64))
        for n in {w for _, w, _ in items}:
            own = [k for k, (_, w, _) in enumerate(items) if w == n]
            hashes = np.concatenate([self.sets[k][:keep[k]] for k in own])
            owner = np.concatenate([np.full(keep[k], k) for k in own])
            order = np.argsort(hashes, kind="stable")
            self.by_words[n] = hashes[order], owner[order]

    def found(self, words: np.ndarray) -> list[tuple[int, float]]:
        """(place of the item, containment) of the items in a document, given the hashes of its words."""
        out = []
        for n, (hashes, owner) in self.by_words.items():
            own = ngram_hashes(words, n)
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            met = own[hashes[at] == own]
            if not len(met):
                continue
            met = np.unique(met)
            lo, hi = np.searchsorted(hashes, met), np.searchsorted(hashes, met, side="right")
            candidates = np.unique(np.concatenate([owner[a:b] for a, b in zip(lo, hi)]))
            own = np.unique(own)
            for k in candidates:
                items = self.sets[k]
                place = np.minimum(np.searchsorted(own, items), len(own) - 1)
                common = int(np.sum(own[place] == items))
                if 100 * common >= SIMILAR_PERCENT * len(items):
                    out.append((int(k), common / len(items)))
        return out


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list]:
    """The items, a bounded number of shingles at a time (read one by one from Spark, never all at once)."""
    held, size = [], 0
    for row in benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where(
            F.col("text").isNotNull()).toLocalIterator():
        words = word_hashes(row["text"])
        if not len(words):
            continue
        held.append((row["item"], min(len(words), SHINGLE_WORDS), shingle_set(row["text"])))
        size += len(held[-1][2])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
            block_shingles: int = BLOCK_SHINGLES, out: str = "__items") -> DataFrame:
    """``docs`` with a column of the benchmark items that each document contains, by item id (of any type), with their
    containment. A column of ``docs`` called as ``out`` is replaced."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kind = T.ArrayType(T.StructType([T.StructField("item_id", benchmark.schema[item].dataType), T.StructField("containment", T.DoubleType())]))
    arrow = to_arrow_type(kind)
    current = inner.withColumn("found", F.expr(f"CAST(array() AS {kind.simpleString()})"))
    place = names.index(text)
    for block in _blocks(benchmark, item, item_text, block_shingles):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        schema = current.schema

        def search(batches: Iterator[pa.RecordBatch], sent=sent, names=tuple(current.columns)) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value)
            for batch in batches:
                before = batch.column(len(names) - 1).to_pylist()
                found = []
                for text, old in zip(batch.column(place).to_pylist(), before):
                    new = [{"item_id": index.ids[k], "containment": c} for k, c in index.found(word_hashes(text))]
                    found.append(sorted(old + new, key=lambda m: (m["item_id"] is not None, m["item_id"] if m["item_id"] is not None else 0)) if new else old)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, arrow)], names=list(names))

        current = current.mapInArrow(search, schema)
    kept = [i for i, n in enumerate(names) if n != out]
    return current.select(*[f"c{i}" for i in kept], "found").toDF(*[names[i] for i in kept], out)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that contain no benchmark item, with all their columns."""
    out = "__items"
    while out in docs.columns:
        out += "_"
    return matches(docs, benchmark, text, out=out).where(F.size(out) == 0).drop(out)
