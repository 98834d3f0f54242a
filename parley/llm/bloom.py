"""Blocked Bloom filters as tables: one row per block in use, its bits in four longs.

A key sets eight bits, two in each long of its block. A filter is sized from the
number of its keys; up to ``BROADCAST_BYTES`` it is broadcast, a larger one is
joined by its block number, through the same plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per key (about one false positive in 200), and bits of a block, held as longs.
BITS_PER_KEY, BLOCK_LONGS = 12, 4
#: Bytes of a block in a hashed relation, and of the largest filter that is broadcast.
BLOCK_ROW_BYTES, BROADCAST_BYTES = 96, 64 << 20


def blocks_for(n_keys: int, bits_per_key: float = BITS_PER_KEY) -> int:
    """How many blocks a filter of so many keys has."""
    return max(1, -int(-n_keys * bits_per_key // (64 * BLOCK_LONGS)))


def block_of(key: Column, n_blocks: int) -> Column:
    """The block of a key."""
    return F.pmod(F.xxhash64(key), F.lit(n_blocks).cast("bigint"))


def hash_of(key: Column) -> Column:
    """The hash of a key that says which bits it sets."""
    return F.xxhash64(key, F.lit(1))


def masks(bits: Column) -> list[Column]:
    """The bits of a key in the longs of its block, two in each, from its ``hash_of``."""
    one = F.lit(1).cast("bigint")

    def bit(i: int) -> Column:  # the six bits of the hash from place 6 * i
        return F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int"))

    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(BLOCK_LONGS)]


def longs(prefix: str = "bits") -> list[str]:
    """Column names of the bits of a filter."""
    return [f"{prefix}{i}" for i in range(BLOCK_LONGS)]


def fold(rows: DataFrame, filters: dict[str, Column | None], key: str = "key") -> DataFrame:
    """Filters of the keys of rows (block, key), side by side: (block, <prefix>0 to 3, ...), each of the keys that its condition lets in."""
    zero = F.lit(0).cast("bigint")
    rows = rows.select("block", *[m.alias(f"mask{i}") for i, m in enumerate(masks(hash_of(F.col(key))))],
                       *[(F.lit(True) if c is None else c).alias(f"in_{p}") for p, c in filters.items()])
    return rows.groupBy("block").agg(*[F.coalesce(F.bit_or(F.when(F.col(f"in_{p}"), F.col(f"mask{i}"))), zero).alias(name)
                                       for p in filters for i, name in enumerate(longs(p))])


def bloom_filter(keys: DataFrame, n_blocks: int, key: str = "key", prefix: str = "bits") -> DataFrame:
    """Filter of the column ``key``: (block, <prefix>0 to 3)."""
    return fold(keys.select(block_of(F.col(key), n_blocks).alias("block"), F.col(key)), {prefix: None}, key)


def sendable(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The table of one filter, marked for broadcast if its size allows it."""
    return F.broadcast(blocks) if n_blocks * BLOCK_ROW_BYTES <= BROADCAST_BYTES else blocks


def may_hold(bits: Column, prefix: str = "bits") -> Column:
    """Whether the filter whose block stands beside ``bits`` (``hash_of`` a key) may hold that key (false where there is no such
    block). Best give it a column made before the join: as an expression it would be computed for each of the eight bits."""
    hits = [F.col(f"{prefix}{i}").bitwiseAND(m) == m for i, m in enumerate(masks(bits))]
    return F.coalesce(reduce(lambda a, b: a & b, hits), F.lit(False))


def _as_array(blocks: DataFrame, n_blocks: int, prefix: str) -> Column:
    """The bits of a filter as one array, block after block: a scalar of ``8 * BLOCK_LONGS * n_blocks`` bytes."""
    zero = F.lit(0).cast("bigint")
    every = blocks.sparkSession.range(n_blocks).withColumnRenamed("id", "block").join(blocks, "block", "left")
    rows = every.select(F.struct("block", F.array(*[F.coalesce(c, zero) for c in longs(prefix)]).alias("bits")).alias("r"))
    return rows.agg(F.flatten(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["bits"]))).scalar()


def passing(rows: DataFrame, key: str, filters: list[tuple[DataFrame, int, str]]) -> DataFrame:
    """The rows whose key is possibly in one of ``filters`` (table, blocks, prefix).

    A filter within the bound is looked up as an array, which costs a row much less than a join; a larger one is joined by
    its block.
    """
    names, conditions = rows.columns, []
    # with a column that is not deterministic, the condition is not pushed below the expression that makes the key
    looked_up = {f"__block{at}": F.slice(_as_array(blocks, n, prefix), (block_of(F.col(key), n) * BLOCK_LONGS).cast("int") + 1, BLOCK_LONGS)
                 for at, (blocks, n, prefix) in enumerate(filters) if 8 * BLOCK_LONGS * n <= BROADCAST_BYTES}
    # each mention of a scalar is a copy of it in the code sent to the tasks, and several in the driver, so it is mentioned once
    rows = rows.select("*", F.spark_partition_id().alias("__task"), *[c.alias(name) for name, c in looked_up.items()])
    for at, (blocks, n, prefix) in enumerate(filters):
        if f"__block{at}" in looked_up:
            hits = [F.get(f"__block{at}", F.lit(i)).bitwiseAND(m) == m for i, m in enumerate(masks(hash_of(F.col(key))))]
            conditions.append(reduce(lambda a, b: a & b, hits))
        else:
            blocks = blocks.select(F.col("block").alias(f"__block{at}"), *longs(prefix))
            rows = rows.withColumns({f"__block{at}": block_of(F.col(key), n), f"__bits{at}": hash_of(F.col(key))}).join(blocks, f"__block{at}", "left")
            conditions.append(may_hold(F.col(f"__bits{at}"), prefix))
    return rows.where(reduce(lambda a, b: a | b, conditions) & (F.col("__task") >= 0)).select(*names)
