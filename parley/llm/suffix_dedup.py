"""Removal of repeated byte strings by external sorting of sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier:
in a document with a smaller id, or earlier in the same one.

Induced sorting sorts a sample of the suffixes, chosen by their own content,
and derives the rest from it. Here the sample are the places of the smallest
``GRAM``-byte hash of every ``LENGTH``-byte window (one place in about 35), so
equal windows sample the same place in the same content. Each sampled suffix
stands for the run of windows that chose it. The work is three external sorts
(Spark's, which spill to disk), each over what the one before left open:

1. Sampled suffixes, as tuples of the hash of the sampled bytes, the hash of the
   whole run with its context, and their place, are sorted by these. Of equal
   runs all but the first are repeats throughout; no window of theirs is seen again.
2. Where one sampled string stands in different runs, the first of each run comes
   back with its bytes (at most ``LENGTH`` and the run's own length) and is sorted by
   sampled string and place. Its windows are induced from it: a window whose common
   prefix with an earlier one reaches ``LENGTH`` is a repeat.
3. Repeated stretches are gathered by document and applied to its bytes.

Nothing is ranked in one place and no text is moved for the sorts of the first
step; the second moves only what is ambiguous.

Edge cases: a null text is empty. Texts shorter than ``LENGTH`` lose nothing.
A null id comes first. Rows equal in id and text are one document and lose the
same bytes; rows equal in id alone count as places of one document, by start
and then by a hash of the text. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, written

LENGTH = 100
GRAM = 32
PIECE = 1 << 20  # bytes looked at together; longer texts are taken in overlapping pieces
FILTER_BITS = 26
NULL_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15 | 1


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of the base and of its inverse modulo 2**64, kept per Python worker."""
    state = sys.modules.setdefault("parley_worker_state", types.ModuleType("parley_worker_state"))
    have = state.__dict__.get("powers")
    if have is None or len(have[1]) < n:
        values = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
        up, down = (np.full(n, x, dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = state.powers = values, np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have


class Hashes:
    """Hashes of any stretches of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray):
        values, up, self.down = _tables(max(len(data) + 1, 2 * PIECE))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def rolling(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[:-size]) * self.down[:len(self.sums) - size]


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Lists of (place of the text, offset, bytes) to be looked at together; pieces of a long text overlap by all but one byte of a window."""
    who, offsets, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at:at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            who.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield who, offsets, parts
                who, offsets, parts, size = [], [], [], 0
    if parts:
        yield who, offsets, parts


def sampled(parts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of windows by the place they sample: part, lo (first window), span (windows less one), gram, run (hashes), at (lo in all parts together)."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(lengths)
    hashes = Hashes(data)
    grams = mixed(hashes.rolling(GRAM))
    place_bits = np.uint64(max(1, len(data)).bit_length())
    low = (np.uint64(1) << place_bits) - np.uint64(1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal hashes
    reach, wanted = 1, LENGTH - GRAM + 1
    while 2 * reach <= wanted:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if wanted > reach:
        key = np.minimum(key[:len(key) - (wanted - reach)], key[wanted - reach:])
    chosen = (key & low).astype(np.int64)  # by window
    part = np.repeat(np.arange(len(parts)), lengths)[:len(chosen)]
    whole = np.arange(len(chosen)) + LENGTH <= ends[part]
    first = whole & np.r_[True, (chosen[1:] != chosen[:-1]) | (part[1:] != part[:-1])]
    lo = np.flatnonzero(first)
    # a run ends before the next one, or with the last whole window of its part
    last = np.minimum(np.r_[lo[1:], len(chosen)] - 1, ends[part[lo]] - LENGTH)
    start = chosen[lo]
    run = hashes.of(lo, last + LENGTH) + (start - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (last - lo).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return {"part": part[lo], "lo": lo - (ends - lengths)[part[lo]], "span": last - lo, "gram": grams[start], "run": mixed(run), "at": lo, "data": data}


def _text_mark(text: bytes) -> int:
    return zlib.crc32(text) & 0xFFFF


def _runs(batch: pa.RecordBatch):
    """Per group of pieces: sampled runs with the ids of their documents and packed places (start, mark of the text, span)."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
    keys = np.array([NULL_ID if k is None else k for k in batch.column(0).to_pylist()], dtype=np.int64)
    marks = np.array([_text_mark(t) for t in texts], dtype=np.int64)
    for who, offsets, parts in _pieces(texts):
        s = sampled(parts)
        owner = np.array(who)[s["part"]]
        start = s["lo"] + np.array(offsets)[s["part"]]
        yield s, keys[owner], (start << 24) | (marks[owner] << 8) | s["span"]


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, run, doc, place, more): the first of equal runs of a batch, and (more) repeats that need no sorting."""
    for batch in batches:
        for s, docs, places in _runs(batch):
            order = np.lexsort((places, docs, s["run"], s["gram"]))
            gram, run, doc, place = s["gram"][order].view(np.int64), s["run"][order].view(np.int64), docs[order], places[order]
            again = np.r_[False, (gram[1:] == gram[:-1]) & (run[1:] == run[:-1])]
            same = np.r_[False, again[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])]
            keep = ~same
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (gram, run, doc, place)] + [pa.array(again[keep])], names=["gram", "run", "doc", "place", "more"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (gram, run, doc, place): (doc, place, null) for repeats throughout, (null, null, gram) for grams with several runs."""
    before = None
    for batch in batches:
        known = batch.column(4).to_numpy(zero_copy_only=False)  # repeats within the batch that sampled them
        every = [batch.column(i).to_numpy() for i in range(4)]
        docs, places, several = [every[2][known]], [every[3][known]], np.empty(0, np.int64)
        gram, run, doc, place = (x[~known] for x in every)
        if len(gram):
            if before is None:
                before = [x[:1] - 1 for x in (gram, run, doc, place)]
            shifted = [np.r_[b, x[:-1]] for b, x in zip(before, (gram, run, doc, place))]
            same_gram = gram == shifted[0]
            same_run = same_gram & (run == shifted[1])
            repeat = same_run & ~((doc == shifted[2]) & (place == shifted[3]))  # a repeated row is no repeat of itself
            several = np.unique(gram[same_gram & ~same_run])
            before = [x[-1:] for x in (gram, run, doc, place)]
            docs.append(doc[repeat])
            places.append(place[repeat])
        doc, place = np.concatenate(docs), np.concatenate(places)
        yield pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.array(doc, pa.int64()), pa.nulls(len(several), pa.int64())]),
            pa.concat_arrays([pa.array(place, pa.int64()), pa.nulls(len(several), pa.int64())]),
            pa.concat_arrays([pa.nulls(len(doc), pa.int64()), pa.array(several, pa.int64())])], names=["doc", "place", "gram"])


def _ambiguous(bits):
    """Rows (gram, doc, place, bytes) of the runs whose gram the filter has, the first of equal ones of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, words = bits.value
        table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
        table[places] = words.view(np.uint64)
        for batch in batches:
            for s, docs, at in _runs(batch):
                bit = s["gram"] & np.uint64((1 << FILTER_BITS) - 1)
                pick = np.flatnonzero((table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                order = pick[np.lexsort((at[pick], docs[pick], s["run"][pick], s["gram"][pick]))]
                gram, kind = s["gram"][order], s["run"][order]
                order = order[np.r_[True, (gram[1:] != gram[:-1]) | (kind[1:] != kind[:-1])]] if len(order) else order
                raw = s["data"].tobytes()
                cut = [raw[a:a + n] for a, n in zip(s["at"][order].tolist(), (s["span"][order] + LENGTH).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(s["gram"][order].view(np.int64)), pa.array(docs[order]), pa.array(at[order]), pa.array(cut, pa.binary())],
                                                 names=["gram", "doc", "place", "bytes"])

    return run


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (gram, doc, place): (doc, mark, start, end) of stretches all of whose windows stand earlier under the same gram.

    What is kept from batch to batch are the hashes of the distinct windows of the gram at hand.
    """
    seen, before = np.empty(0, dtype=np.uint64), None
    for batch in batches:
        gram, doc, place = (batch.column(i).to_numpy() for i in range(3))
        if not len(gram):
            continue
        if before is None:
            before = [x[:1] - 1 for x in (gram, doc, place)]
        own = np.any([np.r_[b, x[:-1]] != x for b, x in zip(before, (gram, doc, place))], axis=0)
        if not own.any():  # a repeated row is no repeat of itself
            continue
        gram, doc, place = gram[own], doc[own], place[own]
        goes_on = gram[0] == before[0][0]
        before = [x[-1:] for x in (gram, doc, place)]
        span = place & 0xFF
        data = np.frombuffer(b"".join(x for x, o in zip(batch.column(3).to_pylist(), own) if o), dtype=np.uint8)
        starts = np.cumsum(span + LENGTH) - (span + LENGTH)
        row = np.repeat(np.arange(len(gram)), span + 1)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(span + 1) - (span + 1), span + 1)
        at = starts[row] + inside
        window = mixed(Hashes(data).of(at, at + LENGTH))
        new = np.zeros(len(window), dtype=bool)
        new[np.unique(window, return_index=True)[1]] = True
        if goes_on:
            of_last = gram[row] == gram[0]
            new[of_last] &= ~np.isin(window[of_last], seen)
        tail = window[gram[row] == gram[-1]]
        seen = np.union1d(seen, tail) if goes_on and gram[0] == gram[-1] else np.unique(tail)
        old = np.flatnonzero(~new)
        if not len(old):
            continue
        cut = np.r_[True, (row[old][1:] != row[old][:-1]) | (old[1:] != old[:-1] + 1)]
        first, final = old[cut], old[np.r_[np.flatnonzero(cut)[1:] - 1, len(old) - 1]]
        r = row[first]
        start = (place[r] >> 24) + inside[first]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc[r], (place[r] >> 8) & 0xFFFF, start, (place[r] >> 24) + inside[final] + LENGTH)],
                                         names=["doc", "mark", "start", "end"])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, mark, start, end): stretches of bytes to remove (they may overlap); ``mark`` tells texts of one id apart."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    sample = rows.mapInArrow(_sample, "gram bigint, run bigint, doc bigint, place bigint, more boolean")
    # known repeats need not meet others and are dealt out evenly
    dealt = sample.repartition(F.when(F.col("more"), F.xxhash64("doc", "place")).otherwise(F.col("gram")))
    settled = written(dealt.sortWithinPartitions("gram", "run", "doc", "place").mapInArrow(_settle, "doc bigint, place bigint, gram bigint"), "settled")
    whole = settled.where(F.col("gram").isNull()).select(
        "doc", F.shiftright("place", 8).bitwiseAND(F.lit(0xFFFF)).alias("mark"), F.shiftright("place", 24).alias("start"),
        (F.shiftright("place", 24) + F.col("place").bitwiseAND(F.lit(0xFF)) + LENGTH).alias("end"))

    bit = F.col("gram").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bits = settled.where(F.col("gram").isNotNull()).select(
        F.shiftrightunsigned(bit, 6).alias("place"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    bits = bits.groupBy("place").agg(F.bit_or("bit").alias("word")).toArrow()  # at most one row per 64 bits of the filter
    sent = spark.sparkContext.broadcast((bits["place"].to_numpy(), bits["word"].to_numpy()))
    open_runs = rows.mapInArrow(_ambiguous(sent), "gram bigint, doc bigint, place bigint, bytes binary")
    induced = open_runs.repartition("gram").sortWithinPartitions("gram", "doc", "place").mapInArrow(_induce, "doc bigint, mark bigint, start bigint, end bigint")
    return whole.unionByName(induced)


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            data = (text or "").encode("utf-8", "surrogatepass")
            removed, at, kept, runs = 0, 0, [], 0
            for s in sorted(spans or [], key=lambda x: (x["start"], x["end"])):
                if s["start"] > at or not runs:
                    kept.append(data[at:s["start"]])
                    runs += 1
                    removed += s["end"] - s["start"]
                    at = s["end"]
                elif s["end"] > at:
                    removed += s["end"] - at
                    at = s["end"]
            out.append((key, len(data), removed, runs, b"".join([*kept, data[at:]])))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that stay)."""

    stretches = repeats(docs, key, text).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    marked = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).withColumn(
        "mark", F.crc32(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFF)))
    joined = marked.join(stretches, (F.coalesce("key", F.lit(NULL_ID)) == F.col("doc")) & (marked["mark"] == stretches["mark"]), "left")
    return joined.select("key", "text", "spans").mapInArrow(_apply, RESULT)
