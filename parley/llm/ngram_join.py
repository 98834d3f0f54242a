"""N-gram Jaccard join with count-vector R-trees.

A text is its set of distinct five-word shingles; two texts are linked if their
sets' Jaccard similarity is 0.75 or more, and documents are grouped by links.

Equal sets are one node. Linked sets of *n* shingles share one of their
``n - ceil(0.75 n) + 1`` first shingles in any order common to all sets
(prefix filter). The order puts shingles last that a fixed-size count sketch of
the whole corpus finds often. Nodes that share such a shingle meet in a block
around one of them, the hub. Within a block every set becomes a point: its
shingles are hashed to groups and counted. An R-tree over the points bounds the
overlap with all sets below a tree node by the summed minima of the
coordinates and the node's largest ones; surviving pairs are verified on the
shingles themselves. Pairs that links already found put in the same group are
not looked at again.

This is done twice: first on the points alone, which are small, and only nodes
for which the bound leaves a partner, with the node of most partners as the
block's new hub, come back with their texts. With few groups, long sets are
alike in all counts whatever their shingles, so points have more groups the more
shingles there are; the tree holds them folded to ``GROUPS``, and what it leaves
is bounded again on the finer counts. Else long texts would move, and that to
many blocks, the more the larger the corpus is. Blocks connected by common nodes
are then taken as one, as far as they fit, so that most texts move once.

Blocks are bounded. A larger one is cut into chunks that each hold the hub and
compare their own nodes; the nodes of any chunk that are not linked with the
hub's group are then compared with all chunks, as one more set of blocks. No
pair is left out, and a large group of copies costs its size, not its square.

Edge cases: a null, empty or blank text has no shingles and is linked with
nothing. Repeated rows and equal texts are one node. A null id is a member of
its group, which is named by the smallest id that is not null. Texts of fewer
than five words are one shingle. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SIMILAR_PERCENT, shingle_set, written
from .components import connected

SKETCH_BITS = 22  # buckets of the count sketch
SEEN_OFTEN = 4  # a task reports the buckets it counts as often as this, and well above its mean
FILTER_BITS = 26  # bits of the filter that selects the texts of candidate nodes
BLOCK_NODES, BLOCK_SHINGLES = 2000, 2_000_000  # of a block with texts
BLOCK_POINTS = 20_000  # nodes of a block without
GROUPS, FANOUT = 128, 16  # of a point in the tree, and of the tree
GROUP_SHINGLES = 4  # at most so many shingles a group, on average, in the points that are sent


def needed(a, b):
    """Smallest overlap of two sets of these sizes that links them: 100 i >= p (a + b - i)."""
    total = (np.asarray(a) + np.asarray(b)) * SIMILAR_PERCENT
    return -(-total // (100 + SIMILAR_PERCENT))


def point_of(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each group."""
    return np.bincount((shingles & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def fine_point_of(shingles: np.ndarray) -> bytes:
    """The counts with as many groups (a power of two) as the set is large, each in one byte."""
    groups = GROUPS
    while groups * GROUP_SHINGLES < len(shingles):
        groups *= 2
    while (counts := np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)).max() > 255:
        groups *= 2
    return counts.astype(np.uint8).tobytes()


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Points (one a row) with fewer groups: the counts that fall together are added up."""
    if points.shape[1] == groups:
        return points
    return points.reshape(len(points), -1, groups).sum(axis=1, dtype=np.int32)


class CountTree:
    """Packed R-tree over count vectors, whose nodes keep the largest coordinates and the sizes below them."""

    def __init__(self, points: np.ndarray):
        self.points, self.sizes = points, points.sum(axis=1)
        # leaves hold sets of similar size and, within, similar direction
        order = np.lexsort((points.argmax(axis=1), self.sizes))
        self.levels = [(points[order], self.sizes[order], self.sizes[order], order)]
        while len(self.levels[-1][0]) > 4 * FANOUT:
            top, low, high, _ = self.levels[-1]
            cuts = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), None))

    def near(self, i: int) -> np.ndarray:
        """Places of the sets whose bound lets them be linked with set ``i``, itself included."""
        point, size = self.points[i], int(self.sizes[i])
        alive = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high, _ = self.levels[depth]
            fits = (100 * high[alive] >= SIMILAR_PERCENT * size) & (SIMILAR_PERCENT * low[alive] <= 100 * size)
            alive = alive[fits]
            bound = np.minimum(top[alive], point).sum(axis=1)
            alive = alive[bound >= needed(size, np.maximum(low[alive], -(-SIMILAR_PERCENT * size // 100)))]
            if depth:
                alive = (alive[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                alive = alive[alive < len(self.levels[depth - 1][0])]
        return self.levels[0][3][alive]


class Overlaps:
    """Exact overlaps of one set of a block with the others, through the block's shingle postings."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.shingles, self.starts = np.unique(flat[order], return_index=True)
        self.counts = np.diff(np.r_[self.starts, len(flat)])
        self.owners = owner[order]

    def shared(self) -> np.ndarray:
        """Per set, in how many sets of the block its shingles are on average."""
        return np.array([self.counts[np.searchsorted(self.shingles, s)].mean() for s in self.sets])

    def of(self, i: int) -> np.ndarray:
        at = np.searchsorted(self.shingles, self.sets[i])
        n = self.counts[at]
        place = np.repeat(self.starts[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.bincount(self.owners[place], minlength=len(self.sets))


def links_of(sets: list[np.ndarray], asking: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (places) that connect the linked sets of a block; pairs already connected are passed over.

    ``asking``: whether a set is compared with all others; by default all are. Sets whose shingles are the most shared
    ask first, since the others of a group of copies tend to be linked with them.
    """
    if len(sets) < 2:
        return []
    tree, overlaps = CountTree(np.stack([point_of(s) for s in sets])), Overlaps(sets)
    parent = np.arange(len(sets))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, group = [], np.arange(len(sets))
    for i in np.argsort(-overlaps.shared(), kind="stable"):
        if asking is not None and not asking[i]:
            continue
        near = tree.near(i)
        near = near[group[near] != group[i]]
        if not len(near):
            continue
        found = near[overlaps.of(i)[near] >= needed(len(sets[i]), tree.sizes[near])]
        for j in found.tolist():
            a, b = root(int(i)), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(i), j))
        if len(found):
            group = np.array([root(x) for x in range(len(sets))])
    return links


def _node(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def _longs(*columns, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=np.uint64).view(np.int64) if len(c) else np.empty(0, np.int64)) for c in columns], names=list(names))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text hash, node, shingles, bucket, count): one per document, and one per bucket that is counted often."""
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    names = ("key", "text_hash", "node", "n", "bucket", "count")
    for batch in batches:
        n, nodes = [], []
        for text in batch.column(2).to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            nodes.append(_node(s) if len(s) else 0)
            np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        own = pa.array(np.array(nodes, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own, pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], names=list(names))
    mean = counts.mean()
    often = np.flatnonzero(counts >= max(SEEN_OFTEN, mean + 4 * np.sqrt(mean)))
    empty = [pa.nulls(len(often), pa.int64()) for _ in range(4)]
    yield pa.RecordBatch.from_arrays([*empty, pa.array(often), pa.array(counts[often].astype(np.int64))], names=list(names))


DESCRIBED = "key bigint, text_hash bigint, node bigint, n bigint, bucket bigint, count bigint"


def _prefixes(sketch):
    """Rows (shingle, node): the shingles by which a set can meet a linked one, once per node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, counts = sketch.value
        often = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        often[buckets] = np.minimum(counts, (1 << 31) - 1)
        done: set[int] = set()
        for batch in batches:
            shingles, nodes = [], []
            for text in batch.column(0).to_pylist():
                s = shingle_set(text)
                if not len(s):
                    continue
                node = _node(s)
                if node in done:
                    continue
                done.add(node)
                first = len(s) - (-(-SIMILAR_PERCENT * len(s) // 100)) + 1
                seen = often[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                if seen.any():
                    s = s[np.argsort(seen, kind="stable")]  # sorted by hash before: ties keep that order
                shingles.append(s[:first])
                nodes.append(np.full(first, node, dtype=np.uint64))
                if len(done) > 1_000_000:
                    done.clear()
            if shingles:
                yield _longs(np.concatenate(shingles), np.concatenate(nodes), names=("shingle", "node"))

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, node) from rows sorted by (shingle, node): of the nodes with a shingle the first is the hub of the others."""
    last, hub, last_node = None, None, None
    for batch in batches:
        shingle, node = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(shingle):
            continue
        start = np.r_[last is None or shingle[0] != last, shingle[1:] != shingle[:-1]]
        again = np.r_[not start[0] and node[0] == last_node, (node[1:] == node[:-1]) & ~start[1:]]
        at = np.maximum.accumulate(np.where(start, np.arange(len(start)), -1))
        hubs = np.where(at >= 0, node[np.maximum(at, 0)], hub if hub is not None else 0)
        keep = ~start & ~again
        pairs = np.unique(np.stack([hubs[keep], node[keep]]), axis=1) if keep.any() else np.empty((2, 0), np.int64)
        last, hub, last_node = shingle[-1], hubs[-1], node[-1]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["hub", "node"])


def _wanted(bits):
    """Whether a text hash is in the filter (and not met before in this task)."""
    places, words = bits.value
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    table[places] = words
    done: set[int] = set()

    def test(h: int) -> bool:
        bit = h & ((1 << FILTER_BITS) - 1)
        if h in done or not int(table[bit >> 6]) >> (bit & 63) & 1:
            return False
        done.add(h)
        return True

    return test


def _by_node(sets: list[np.ndarray], values: list[bytes], name: str) -> pa.RecordBatch:
    nodes = np.array([_node(s) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(values, pa.binary())], names=["node", name])


def _points(bits):
    """Rows (node, point) of the documents whose text hash the filter has, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _wanted(bits)
        for batch in batches:
            sets = [shingle_set(t) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if wanted(h)]
            yield _by_node(sets, [fine_point_of(s) for s in sets], "point")

    return run


def _chosen(bits):
    """Rows (node, compressed text) of the documents whose text hash the filter has, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        wanted, packed = _wanted(bits), zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            texts = [t for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if wanted(h)]
            yield _by_node([shingle_set(t) for t in texts], [packed((t or "").encode("utf-8", "surrogatepass")) for t in texts], "text")

    return run


def _shared_at_most(points: list[np.ndarray], i: int, others: np.ndarray) -> np.ndarray:
    """By the counts at the finest groups that both have, the most shingles that set ``i`` shares with others of a block."""
    out, groups = np.empty(len(others), dtype=np.int64), np.array([len(points[j]) for j in others])
    for size in np.unique(groups):
        at, common = np.flatnonzero(groups == size), min(int(size), len(points[i]))
        some = folded(np.stack([points[j] for j in others[at]]), common)
        out[at] = np.minimum(some, folded(points[i][None, :], common)).sum(axis=1, dtype=np.int64)
    return out


def _partners(points: list[np.ndarray]) -> np.ndarray:
    """Per set of a block, how many others the tree's bound lets it be linked with; 0 if the finer counts leave none of them."""
    coarse = np.concatenate([folded(p[None, :], GROUPS) for p in points]).astype(np.int32)
    sizes = coarse.sum(axis=1)
    if len(points) > 4 * FANOUT:
        near = CountTree(coarse).near
    else:
        fits = np.minimum(coarse[:, None, :], coarse[None, :, :]).sum(axis=2) >= needed(sizes[:, None], sizes[None, :])
        near = lambda i: np.flatnonzero(fits[i])
    partners, sure = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=bool)
    for i in range(len(points)):
        others = near(i)
        others = others[others != i]
        partners[i] = len(others)
        for lo in range(0, 0 if sure[i] else len(others), 4 * FANOUT):  # one partner is enough
            some = others[lo:lo + 4 * FANOUT]
            found = some[_shared_at_most(points, i, some) >= needed(sizes[i], sizes[some])]
            if len(found):
                sure[i] = sure[found] = True
                break
    return np.where(sure, partners, 0)


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, node), under the node of most partners, of the nodes that the bound leaves a partner; input sorted by (hub, node)."""

    def solved(nodes: list[int], points: list[bytes]) -> pa.RecordBatch:
        partners = _partners([np.frombuffer(p, dtype=np.uint8) for p in points])
        nodes = np.array(nodes, dtype=np.int64)
        stay, hub = nodes[partners > 0], nodes[np.argmax(partners)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(stay), hub)), pa.array(stay)], names=["hub", "node"])

    last, nodes, points = None, [], []
    for batch in batches:
        for hub, node, point in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if hub != last:
                if nodes:
                    yield solved(nodes, points)
                last, nodes, points = hub, [], []
            nodes.append(node)
            points.append(point)
    if nodes:
        yield solved(nodes, points)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, met) from rows sorted by block: links, and (node, null, hub) for nodes not linked with their block's hub.

    Input: block, part (which chunk of a cut block), hub, node, asks, text.
    """
    import zstandard

    names, unpacked = ("u", "v", "unmet_hub"), zstandard.ZstdDecompressor().decompress

    def solved(block):
        hub = block["hub"]
        nodes, sets = list(block["sets"]), list(block["sets"].values())
        links = links_of(sets, np.array([block["asks"][n] for n in nodes]))
        rows = [(nodes[i], nodes[j], None) for i, j in links]
        if block["cut"]:
            parent = {n: n for n in nodes}

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for u, v, _ in rows:
                parent[root(u)] = root(v)
            rows += [(n, None, hub) for n in nodes if root(n) != root(hub)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], names=list(names))

    current = None
    for batch in batches:
        for r in batch.to_pylist():
            mark = (r["hub"], r["part"])
            if current is None or current["mark"] != mark:
                if current is not None:
                    yield solved(current)
                current = {"mark": mark, "hub": r["hub"], "cut": r["cut"], "sets": {}, "asks": {}}
            if r["node"] not in current["sets"]:
                current["sets"][r["node"]] = shingle_set(unpacked(r["text"]).decode("utf-8", "surrogatepass"))
                current["asks"][r["node"]] = r["asks"]
            else:
                current["asks"][r["node"]] |= r["asks"]
    if current is not None:
        yield solved(current)


def _solve(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links within blocks; members: (hub, part, cut, node, asks)."""
    rows = members.join(texts, "node").repartition("hub", "part").sortWithinPartitions("hub", "part", "node")
    return rows.select("hub", "part", "cut", "node", "asks", "text").mapInArrow(_block_links, "u bigint, v bigint, unmet_hub bigint")


def _text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", block_nodes: int = BLOCK_NODES) -> DataFrame:
    """One row per document: the key, ``text_hash``, ``group`` (null without shingles), ``n_shingles``, ``component_id``
    (smallest key reachable by links)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("key"), _text_hash(text), F.col(text).alias("text"))
    described = written(rows.mapInArrow(_describe, DESCRIBED), "shingles")
    nodes = described.where(F.col("bucket").isNull()).select("key", "text_hash", "node", "n")
    # at most one row per bucket of the sketch
    often = described.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("count").alias("count")).toArrow()
    sketch = spark.sparkContext.broadcast((often["bucket"].to_numpy(), often["count"].to_numpy()))

    prefixes = rows.select("text").mapInArrow(_prefixes(sketch), "shingle bigint, node bigint")
    met = prefixes.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(_meetings, "hub bigint, node bigint")
    met = written(met.distinct(), "meetings")

    def filter_of(nodes: DataFrame):
        """The nodes with the hash of one of their texts, and the filter for it: at most one row per 64 of its bits."""
        bit = F.col("text_hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))
        found = written(sources.join(nodes, "node"), "nodes")
        bits = found.select(F.shiftrightunsigned(bit, 6).alias("place"), one.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("word")).toArrow()
        return found, spark.sparkContext.broadcast((bits["place"].to_numpy(), bits["word"].to_numpy()))

    sources = nodes.where("n > 0").groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"))
    members = met.unionByName(met.select("hub", F.col("hub").alias("node")).distinct())
    _, bits = filter_of(members.select("node").distinct())
    points = rows.select("text_hash", "text").mapInArrow(_points(bits), "node bigint, point binary").dropDuplicates(["node"])
    sizes = members.groupBy("hub").agg(F.count("*").alias("size"))
    small, large = sizes.where(F.col("size") <= BLOCK_POINTS), sizes.where(F.col("size") > BLOCK_POINTS)
    placed = members.join(small.select("hub"), "hub").join(points, "node").repartition("hub").sortWithinPartitions("hub", "node")
    left = placed.select("hub", "node", "point").mapInArrow(_survivors, "hub bigint, node bigint")
    members = written(left.unionByName(members.join(large.select("hub"), "hub").select("hub", "node")).distinct(), "members")

    # blocks that share nodes become one where that is small enough, so that a text goes to one block
    together = connected(members.select(F.col("hub").alias("u"), F.col("node").alias("v")))
    fits = together.join(sources, "node").groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    fits = fits.where((F.col("size") <= block_nodes) & (F.col("shingles") <= BLOCK_SHINGLES)).select("root")
    placed = members.join(together.withColumnRenamed("node", "hub"), "hub").join(fits.withColumn("fits", F.lit(True)), "root", "left")
    members = written(placed.select(F.when(F.col("fits"), F.col("root")).otherwise(F.col("hub")).alias("hub"), "node").distinct(), "members")

    source, bits = filter_of(members.select("node").distinct())
    texts = written(rows.select("text_hash", "text").mapInArrow(_chosen(bits), "node bigint, text binary").dropDuplicates(["node"]), "texts")

    sizes = members.join(source.select("node", "n"), "node").groupBy("hub").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    chunks = F.greatest(F.ceil(F.col("size") / block_nodes), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select("hub", chunks.alias("chunks"))
    sized = members.join(sizes, "hub")
    part = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    inside = sized.where("node <> hub").select("hub", part.alias("part"), (F.col("chunks") > 1).alias("cut"), "node", F.lit(True).alias("asks"))
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), (F.col("chunks") > 1).alias("cut"), F.col("hub").alias("node"), F.lit(True).alias("asks"))
    solved = written(_solve(inside.unionByName(hubs), texts), "links")
    links = solved.where(F.col("unmet_hub").isNull()).select("u", "v")

    # nodes of cut blocks that are not linked with the hub's group: compared with every chunk
    unmet = solved.where(F.col("unmet_hub").isNotNull()).select(F.col("unmet_hub").alias("hub"), F.col("u").alias("node"))
    if not unmet.isEmpty():
        counts = unmet.groupBy("hub").agg(F.ceil(F.count("*") / block_nodes).cast("int").alias("askers"))
        ask_part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("askers")).cast("int")
        asking = unmet.join(counts, "hub").join(sizes, "hub").select(
            "hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), ask_part.alias("ask"), "chunks", "node", F.lit(True).alias("asks"))
        asked = sized.join(counts, "hub").select("hub", part.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("ask"), "chunks", "node", F.lit(False).alias("asks"))
        both = asking.unionByName(asked).select("hub", (F.col("ask") * F.col("chunks") + F.col("chunk")).alias("part"), F.lit(False).alias("cut"), "node", "asks")
        links = links.unionByName(_solve(both, texts).select("u", "v"))

    roots = connected(links)
    described_nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = described_nodes.where("n > 0").groupBy("root").agg(F.min("key").alias("component"))
    out = described_nodes.join(names, "root", "left")
    return out.select(F.col("key").alias(key), "text_hash", F.when(F.col("n") > 0, F.col("root")).alias("group"), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component_id"))


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the smallest key of their group (of equal keys, the smallest hash of the text; of repeated rows, one),
    and all documents without shingles, with all their columns."""
    found = components(docs, key, text).withColumnRenamed(key, "__key")
    stay = found.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct("__key", "text_hash")).alias("s")).select("s.*", F.lit(True).alias("__one"))
    empty = found.where("n_shingles = 0").select("__key", "text_hash", F.lit(False).alias("__one")).distinct()
    stay = stay.unionByName(empty).withColumnRenamed("text_hash", "__stay_hash")
    # the row itself is one column, so that its columns may have any name
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").cast("bigint").alias("__own"), _text_hash(text).alias("__hash"))
    kept = marked.join(stay, F.col("__own").eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__stay_hash")))
    nth = F.row_number().over(Window.partitionBy("__key", "__hash").orderBy(F.lit(1)))
    return kept.withColumn("__nth", nth).where(~F.col("__one") | (F.col("__nth") == 1)).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
