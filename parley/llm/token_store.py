"""Token ids in blocks of bit planes.

The ids of all documents, in ascending order of their id, form one stream, cut
into shards (range partitions) and within them into blocks of a fixed number of
ids. A block is transposed: plane *j* holds bit *j* of every id. Each plane is
compressed by itself with zstandard, planes of zeros take no room, and the
chunk index (ids and bytes per plane of each block, and the documents in it) is
stored beside the payload, so that it can be read alone. A part of a document
that goes on in other blocks has the number of its ids there beside it: so the
crc32 of the document is the exclusive or of what its parts, each read by
itself, give to it.

Edge cases: a null text is empty and has the end id alone. Equal ids follow by
text; null ids come first. Repeated rows are stored as often as they come. An
empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import worker_encoder

BLOCK_IDS = 1 << 16
DOC_IN_BLOCK = pa.struct([("place", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("length", pa.int32()),
                          ("after", pa.int64())])
ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int32()), ("plane_bytes", pa.list_(pa.int32())),
                   ("payload", pa.binary()), ("docs", pa.list_(DOC_IN_BLOCK))])
STORE = ("shard int, block bigint, n_ids int, plane_bytes array<int>, payload binary, "
         "docs array<struct<place:bigint, doc_id:bigint, at:int, length:int, after:bigint>>")


def to_planes(ids: np.ndarray, level: int = 3) -> list[bytes]:
    """Compressed bit planes of a block, lowest bit first; a plane of zeros is empty."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    top = int(ids.max()).bit_length() if len(ids) else 0
    bits = ids.astype(np.uint16 if top <= 16 else np.uint32)
    planes = [np.packbits((bits & bits.dtype.type(1 << j)) != 0) for j in range(top)]
    return [pack(p.tobytes()) if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block from its compressed planes."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    kind = np.uint16 if len(planes) <= 16 else np.uint32
    ids = np.zeros(n, dtype=kind)
    for j, p in enumerate(planes):
        if p:
            ids |= np.unpackbits(np.frombuffer(unpack(p), dtype=np.uint8), count=n).astype(kind) << kind(j)
    return ids.astype("<u4")


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@cache
def _zeros(k: int) -> list[int]:
    """What 2 ** ``k`` zero bytes after a string do to its crc32, as a matrix over bits."""
    if k:
        return [_times(_zeros(k - 1), x) for x in _zeros(k - 1)]
    power = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit appended
    for _ in range(3):
        power = [_times(power, x) for x in power]
    return power


def joined_crc(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings put together, from the crc32 of each and the length of the second."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            first = _times(_zeros(k), first)
    return first ^ second


def _blocks(end_id: int, tokenizer: str | None, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = worker_encoder(tokenizer), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        docs: list[dict] = []
        filled = block = place = 0

        def row():
            nonlocal held, docs, filled, block
            ids = np.concatenate(held)
            planes = to_planes(ids)
            out = {"shard": shard, "block": block, "n_ids": len(ids), "plane_bytes": [len(p) for p in planes], "payload": b"".join(planes), "docs": docs}
            held, docs, filled, block = [], [], 0, block + 1
            return pa.RecordBatch.from_pylist([out], schema=ARROW)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(keys), 256):
                for key, ids in zip(keys[lo:lo + 256], encoder.encode(texts[lo:lo + 256])):
                    ids, at = np.append(ids, np.uint32(end_id)), 0
                    while at < len(ids):
                        part = ids[at:at + block_ids - filled]
                        at += len(part)
                        docs.append({"place": place, "doc_id": key, "at": filled, "length": len(part), "after": len(ids) - at})
                        held.append(part)
                        filled += len(part)
                        if filled == block_ids:
                            yield row()
                    place += 1
        if filled:
            yield row()

    return run


def write_store(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, block_ids: int = BLOCK_IDS,
                key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id``, and write the stream in ascending order of the key."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_blocks(end_id, tokenizer, block_ids), STORE).write.option("compression", "none").parquet(path)


def _documents(block_ids: int):
    names = ("shard", "place", "doc_id", "at", "length", "crc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = np.cumsum([0, *r["plane_bytes"]])
                ids = from_planes([r["payload"][a:b] for a, b in zip(ends[:-1], ends[1:])], r["n_ids"])
                out = [(r["shard"], d["place"], d["doc_id"], r["block"] * block_ids + d["at"], d["length"],
                        joined_crc(zlib.crc32(ids[d["at"]:d["at"] + d["length"]]), 0, 4 * d["after"])) for d in r["docs"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=list(names))

    return run


def read_documents(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Decode a store; per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Blocks are decoded once, one by one, wherever they lie; a document that spans blocks is put together from the crc32 of its parts.
    """
    store = spark.read.schema(STORE).parquet(path)
    parts = store.mapInArrow(_documents(block_ids), "shard bigint, place bigint, doc_id bigint, at bigint, length bigint, crc bigint")
    docs = parts.groupBy("shard", "place").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("length").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    sizes = store.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per shard
    before = sizes.select(F.col("shard").cast("bigint").alias("shard"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return docs.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
