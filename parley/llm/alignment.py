"""Alignment of the tokens that two tokenizers give the same texts.

Each text, with a blank before it, is encoded by a byte-level BPE file (A) and a
sentence-piece model (B). All tokens of both sides are sorted by the byte at
which they start, the running maximum of their ends is taken, and a group ends
where the next start reaches it, that is, where tokens of both sides end. Within
the groups, overlapping byte ranges are expanded to links between an A and a B
token. Over the corpus, the documents that hold a pair of ids linked are counted.

Neither tokenizer joins what stands before and after a blank or line end that
follows another character, or a letter and what is no letter after it, so texts
are cut there and the alignment of a chunk is kept for the next time it comes (a
model with pieces across such places is given whole texts). Long texts are taken in parts that end at such places.

Counts of pairs are joined to the links of every document: the most frequent
pairs by broadcast (``BROADCAST_PAIRS`` of them at most), the others by a
shuffle, in which no pair has more than a small share of the rows.

Edge cases: a null or empty text, or one that the tokens of either side do not
spell byte for byte, has no tokens: its counts are 0 and its digest is empty.
Repeated rows are documents of their own, ids may be null or come twice. Columns
other than the id and the text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .tokens import LETTERS, tokenizer_path

PIECE_FILE = "piece_bpe_32k.model"
#: Chunks kept per Python worker, characters of a part of a text, and texts (or characters of them) taken together.
KEPT_CHUNKS, PART_CHARS, TEXTS, TEXTS_CHARS = 300_000, 1 << 20, 256, 1 << 21
#: Pairs joined by broadcast (some 50 bytes each).
BROADCAST_PAIRS = 1_000_000
#: Letters of the languages at hand; a run of them is a chunk unless another letter follows. Other chunks end before a blank or line end after another character.
CHUNKS = re.compile(rf"[ \n]?[{LETTERS}]+(?![^\W\d_])|\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
#: What no piece may have inside for chunks to be encoded alone.
ACROSS = re.compile(rf"\n|[^▁]▁|[{LETTERS}](?![^\W\d_])(?=.)", re.DOTALL)
CUT = re.compile(r"(?<=\S)(?=[ \n])")


def piece_path() -> str:
    """Place of the default sentence-piece model on this machine."""
    import public_tokenizers

    return public_tokenizers.path(PIECE_FILE)


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    """Aligns the tokens of texts under two tokenizer files."""

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a or tokenizer_path())
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = SentencePieceProcessor(model_file=path_b or piece_path())
        byte = _byte_of_letter()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = b"".join(bytes([byte[c]]) if c in byte else c.encode() for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.cuts = not any(ACROSS.search(p) for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        self.start = self.b.encode("\n")  # what a line end at the start of a text gives
        # ids as text, with what may follow them
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.written = np.array([f"{i}{sep}" for sep in ",|;" for i in range(n)], dtype=object)
        self.size_written = np.array([len(x) for x in self.written], dtype=np.int64)
        self.kept: dict[str, tuple[bytes, bytes, str] | None] = {}

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks as they stand within a text: after a line end, whose ids are left out."""
        return [ids[len(self.start):] for ids in self.b.encode(["\n" + c for c in chunks], num_threads=1)]

    def parts(self, text: str) -> Iterator[list[str]]:
        """Chunks of ``text`` with its blank before it, by parts of bounded length."""
        text, at = " " + text, 0
        while self.cuts and len(text) - at > PART_CHARS:
            cut = CUT.search(text, at + PART_CHARS)
            if not cut:
                break
            yield CHUNKS.findall(text[at:cut.start()])
            at = cut.start()
        yield CHUNKS.findall(text[at:]) if self.cuts else [text]

    def align(self, chunks: list[str]) -> list[tuple[bytes, bytes, str] | None]:
        """Per chunk: its numbers (A and B tokens, groups, links), its links as pair numbers, its groups as text; None if not spelt byte for byte."""
        if not chunks:
            return []
        all_a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        all_b = self.encode_b(chunks) if self.cuts else self.b.encode([c[1:] for c in chunks], num_threads=1)
        data = [c.encode("utf-8", "surrogatepass") for c in chunks]
        spelt = [True] * len(chunks)
        if not all(b"".join([t[i] for i in chain.from_iterable(x)]) == b"".join(data) for t, x in ((self.bytes_a, all_a), (self.bytes_b, all_b))):
            spelt = [b"".join([self.bytes_a[i] for i in a]) == d == b"".join([self.bytes_b[i] for i in b]) for d, a, b in zip(data, all_a, all_b)]
        sides = [[ids for ids, ok in zip(x, spelt) if ok] for x in (all_a, all_b)]
        if not sides[0]:
            return [None] * len(chunks)
        counts = [np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in sides]
        a, b = (np.fromiter(chain.from_iterable(x), dtype=np.int64, count=n.sum()) for x, n in zip(sides, counts))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        start_a, start_b = end_a - self.size_a[a], end_b - self.size_b[b]

        # groups: sorted by start, a token that starts at or after the running maximum of the ends opens a new one
        start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(end[order])
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(np.concatenate([[True], start[order][1:] >= reach[:-1]])) - 1

        # links: of each A token, the B tokens from the first that ends after its start to the last that starts before its end
        first, last = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        many = last - first
        links_a = np.repeat(a, many)
        before = np.cumsum(many) - many
        pairs = links_a * len(self.bytes_b) + b[np.arange(many.sum()) - np.repeat(before - first, many)]

        # text of the groups: by group, A before B, each id with what follows it
        in_text = np.lexsort((side, group))
        next_group, next_side = np.append(group[in_text][1:], -1), np.append(side[in_text][1:], -1)
        sep = np.where(next_group != group[in_text], 2, np.where(next_side != side[in_text], 1, 0))
        which = sep * (len(self.written) // 3) + np.concatenate([a, b])[in_text]
        groups = "".join(self.written[which].tolist())

        bounds_a, bounds_b = (np.concatenate([[0], np.cumsum(c)]) for c in counts)
        bounds_group = np.concatenate([group[bounds_a[:-1]], [group.max() + 1]])
        bounds_link = np.append(before, many.sum())[bounds_a]
        numbers = np.stack([np.diff(x) for x in (bounds_a, bounds_b, bounds_group, bounds_link)], axis=1).tobytes()
        at_link = (8 * bounds_link).tolist()
        at_text = np.concatenate([[0], np.cumsum(self.size_written[which])])[bounds_a + bounds_b].tolist()
        pairs = pairs.tobytes()
        done = iter([(numbers[32 * i:32 * i + 32], pairs[at_link[i]:at_link[i + 1]], groups[at_text[i]:at_text[i + 1] - 1]) for i in range(len(sides[0]))])
        return [next(done) if ok else None for ok in spelt]

    def documents(self, texts: list[str | None]) -> Iterator[tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]]:
        """Per text: its numbers, the digest of its groups, its different pair numbers and how often each is linked."""
        for lo in range(0, len(texts), TEXTS):
            some = texts[lo:lo + TEXTS]
            while some:
                n, chars = 0, 0
                while n < len(some) and (not n or chars < TEXTS_CHARS):
                    chars, n = chars + len(some[n] or ""), n + 1
                yield from self._documents(some[:n])
                some = some[n:]

    def _learn(self, chunks: set[str]) -> None:
        if len(self.kept) > KEPT_CHUNKS:  # those that come again stay
            self.kept = {c: self.kept[c] for c in chunks if c in self.kept}
        new = [c for c in chunks if c not in self.kept]
        self.kept.update(zip(new, self.align(new)))

    def _long(self, text: str) -> Iterator[list]:
        for part in self.parts(text):
            self._learn(set(part))
            yield [self.kept[c] for c in part]

    def _documents(self, texts: list[str | None]):
        none = ((0, 0, 0, 0), "", np.empty(0, np.int64), np.empty(0, np.int64))
        short = [t is not None and 0 < len(t) <= PART_CHARS for t in texts]
        split = [next(self.parts(t)) if s else None for t, s in zip(texts, short)]
        self._learn({c for chunks in split if chunks for c in chunks})
        split = [chunks and [self.kept[c] for c in chunks] for chunks in split]  # before a long text makes others go
        for text, rows in zip(texts, split):
            if not text:
                yield none
                continue
            numbers, digest, found, spelt = np.zeros(4, np.int64), hashlib.sha256(), [], True
            for i, part in enumerate([rows] if rows else self._long(text)):
                if None in part:
                    spelt = False
                    break
                n, pairs, groups = zip(*part)
                numbers += np.frombuffer(b"".join(n), dtype=np.int64).reshape(-1, 4).sum(axis=0)
                digest.update(((";" if i else "") + ";".join(groups)).encode())
                found.append(np.unique(np.frombuffer(b"".join(pairs), dtype=np.int64), return_counts=True))
            if not spelt:
                yield none
                continue
            pairs, times = found[0]
            if len(found) > 1:
                pairs, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                times = np.bincount(at, weights=np.concatenate([f[1] for f in found])).astype(np.int64)
            yield tuple(numbers.tolist()), digest.hexdigest(), pairs, times


def worker_aligner(path_a: str | None = None, path_b: str | None = None) -> Aligner:
    """The aligner of this Python worker, kept from task to task."""
    state = sys.modules.setdefault("parley_worker_state", types.ModuleType("parley_worker_state"))
    aligners = state.__dict__.setdefault("aligners", {})
    if (path_a, path_b) not in aligners:
        aligners[path_a, path_b] = Aligner(path_a, path_b)
    return aligners[path_a, path_b]


def _aligned(path_a: str | None, path_b: str | None):
    names = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = worker_aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                texts = batch.column(1).slice(done, TEXTS).to_pylist()
                numbers, digests, pairs, times = zip(*aligner.documents(texts))
                at = np.cumsum([0, *map(len, pairs)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(at, np.concatenate(x)) for x in (pairs, times)]
                rows = np.arange(row, row + len(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), batch.column(0).slice(done, TEXTS), *[pa.array(c, pa.int64()) for c in zip(*numbers)], pa.array(digests), *lists], names=names)
                row, done = row + len(texts), done + len(texts)

    return run


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document: a row number, its key, the numbers and digest of its alignment, its different ``pairs`` (A id * B ids + B id) and their ``times``."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    longs = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    lists = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("pairs", "times")]
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", rows.schema["key"].dataType), *longs,
                           T.StructField("groups_sha256", T.StringType()), *lists])
    return rows.mapInArrow(_aligned(path_a, path_b), schema)


def pair_counts(aligned: DataFrame, ids_b: int) -> DataFrame:
    """Per pair of ids: the documents that hold it linked, and whether no pair of that A id is in more (``ids_b``: how many ids B has)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / ids_b))  # at most as many rows as B has ids
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def scored(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` without its lists, with n_best and count_sum of every document from the counts of its pairs."""
    sizes = sorted(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect(), reverse=True)  # 64 rows at most
    total, least = 0, 1
    for power, n in sizes:
        total += n
        if total > BROADCAST_PAIRS:
            least = 2 << power
            break
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    frequent = F.broadcast(counts.where(F.col("n") >= least))
    if least == 1:
        found = links.join(frequent, "pair")
    else:
        met = links.join(frequent, "pair", "left")
        rare = met.where("n IS NULL").select("row", "pair", "times").join(counts.where(F.col("n") < least), "pair")
        found = met.where("n IS NOT NULL").unionByName(rare)
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return aligned.drop("pairs", "times").join(sums, "row", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Alignment of all documents, counted over the corpus: row, key, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    from sentencepiece import SentencePieceProcessor

    aligned = written(align(docs, key, text, path_a, path_b), "aligned")
    ids_b = SentencePieceProcessor(model_file=path_b or piece_path()).get_piece_size()
    return scored(aligned, written(pair_counts(aligned, ids_b), "pairs"))
