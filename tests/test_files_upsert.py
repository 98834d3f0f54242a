"""Positions in files, splits and merges, upserts, request batches, exact tokens, transcripts without strings."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from parley.operators import conversation as conv
from parley.operators import tokens as tk
from parley.operators import transcripts as tr
from parley.operators import udfs
from parley.sources import files, upsert


def folder(name):
    return os.path.join(tempfile.mkdtemp(prefix="parley-test-"), name)


def test_row_positions_over_many_splits(spark):
    rng, path, want = random.Random(1), tempfile.mkdtemp(prefix="parley-test-"), {}
    for name, n in (("a.csv", 4000), ("b.csv", 1), ("c.csv", 0), ("d.csv", 1500)):
        with open(os.path.join(path, name), "w") as f:
            f.write("uid,t\n")
            for i in range(n):
                f.write(f"{i},{'x' * rng.randint(0, 60)}\n")
        want[name] = list(range(n))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        scan = spark.read.schema("uid long, t string").option("header", True).csv(path)
        got = files.row_positions(scan).select(F.element_at(F.split("file_path", "/"), -1).alias("f"), "uid", "row_index").collect()
        splits = spark.read.text(path).select(F.col("_metadata.file_block_start")).distinct().count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert splits > 10 and all(r.uid == r.row_index for r in got)
    assert {n: sorted(r.uid for r in got if r.f == n) for n in want} == want


def test_split_and_merge(spark):
    rows = [(i % 50, f"line {i}\nmore") for i in range(1003)] + [(7, None)] * 2
    df = spark.createDataFrame(rows, "uid long, t string").repartition(6)
    path = folder("s")
    files.sink_split(df, path, 25, ["uid", "t"])
    merged = files.merge_split(spark, path, "uid long, t string")
    got = merged.collect()
    assert [r.position for r in got] == list(range(1005))
    assert [(r.uid, r.t) for r in got] == sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    sizes = [sum(r.piece == k for r in got) for k in range(25)]
    assert max(sizes) - min(sizes) <= 1 and [r.piece for r in got] == sorted(r.piece for r in got)
    # results of the pieces, one of them incomplete, one doubled
    done = spark.read.schema("position long, uid long, t string, piece int").json(path)
    for broken in (done.where("position <> 77"), done.unionByName(done.where("position = 500")), done.where("piece <> 3")):
        results = folder("r")
        broken.write.partitionBy("piece").json(results)
        with pytest.raises(files.LostRows):
            files.merge_split(spark, path, "uid long, t string", results)
    few = folder("few")
    files.sink_split(df.limit(3), few, 25, "uid")
    assert files.merge_split(spark, few, "uid long, t string").count() == 3
    none = folder("none")
    files.sink_split(df.limit(0), none, 4, "uid")
    assert spark.read.json(f"{none}-manifest").agg(F.sum("n_rows")).first()[0] == 0


SCHEMA = "k long, g string, v string, at long"


def test_upserts(spark):
    path = folder("t")
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    upsert.create_table(spark, path, make([]).schema, ["k", "g"], ["at"], n_buckets=5)
    assert upsert.read_table(spark, path).collect() == [] and upsert.upsert(make([]), path) == 0
    want = {}

    def put(rows):
        for k, g, v, at in rows:
            if (k, g) not in want or at >= want[k, g][1]:
                want[k, g] = (v, at)
        return upsert.upsert(make(rows).repartition(3), path)

    def table():
        return {(r.k, r.g): (r.v, r["at"]) for r in upsert.read_table(spark, path).collect()}

    assert put([(i, "a", f"v{i}", 10) for i in range(40)] + [(None, "a", "null key", 1), (3, None, None, 1), (1, "a", "newer", 11), (1, "a", "older", 9)]) == 1
    assert table() == want
    # one key: only its bucket is written again
    before = upsert._Table(spark, path).folders
    put([(5, "a", "again", 12), (5, "a", "too old", 2)])
    after = upsert._Table(spark, path).folders
    assert table() == want and sum(before[b] != after[b] for b in before) == 1
    # a repeated batch, and one that comes late
    put([(5, "a", "again", 12)])
    put([(6, "a", "late", 1)])
    assert table() == want and table()[6, "a"] == ("v6", 10)
    assert [tuple(r) for r in upsert.read_keys(spark, path, make([(5, "a", None, None), (99, "a", None, None)])).collect()] == [(5, "a", "again", 12)]
    with pytest.raises(ValueError, match="columns differ"):
        upsert.upsert(make([]).drop("v"), path)


def test_a_killed_upsert_leaves_the_old_table(spark):
    path = folder("t")
    rows = [(i, "a", f"v{i}", 1) for i in range(30)]
    upsert.create_table(spark, path, spark.createDataFrame([], SCHEMA).schema, ["k"], ["at"], n_buckets=4)
    upsert.upsert(spark.createDataFrame(rows, SCHEMA), path)
    broken = spark.createDataFrame([(i, "a", "new", 2) for i in range(60)], SCHEMA).repartition(6).withColumn(
        "v", F.when(F.col("k") == 59, F.raise_error(F.lit("killed"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        upsert.upsert(broken, path)
    # killed between the rows and the manifest: a folder of rows that nobody names
    t = upsert._Table(spark, path)
    spark.createDataFrame([(0, 1, "a", "new", 2)], "bucket int, " + SCHEMA).write.partitionBy("bucket").parquet(f"{path}/data/v2-dead")
    assert sorted(map(tuple, upsert.read_table(spark, path).collect())) == rows and upsert._Table(spark, path).version == t.version == 1
    assert upsert.upsert(spark.createDataFrame([(i, "a", "new", 2) for i in range(60)], SCHEMA), path) == 2
    assert upsert.read_table(spark, path).where("v = 'new'").count() == 60


def test_request_batches(spark):
    """Requests keep both limits, are carried over Arrow batches, and vectors come back to their texts."""
    rng = random.Random(2)
    texts = ["x" * rng.choice([0, 1, 7, 40, 200, 900]) for _ in range(500)] + [None, "   "]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    embed = udfs.request_embedder(lambda request: [[len(t), len(request), sum(len(x) for x in request)] for t in request], max_items=12, max_tokens=600, count=len)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = [tuple(r) for r in df.select("i", embed(F.col("t")).alias("e")).select("i", F.col("e")[0], F.col("e")[1], F.col("e")[2]).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    sent = [t if t and t.strip() else " " for t in texts]
    want, request = [], []
    for t in [*sent, None]:
        if t is None or request and (sum(map(len, request)) + len(t) > 600 or len(request) >= 12):
            want += [(len(x), len(request), sum(map(len, request))) for x in request]
            request = []
        request.append(t)
    assert [r[1:] for r in sorted(got)] == want
    assert all(n <= 12 and (used <= 600 or n == 1) for _, n, used in want)
    short = udfs.request_embedder(lambda request: [[0.0]])
    with pytest.raises(Exception, match="vectors for a request"):
        df.select(short(F.col("t"))).collect()


def test_exact_tokens_and_tails(spark):
    rng = random.Random(4)
    words = ["the", "Straße", "naïve,", "don't", "12345", "漢字", "x\n\ny", "  ", "\t", "a b", "end.\r\n", "#$%"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["", " ", None, "x" * 500]
    old, tk.PART_CHARS = tk.PART_CHARS, 40
    try:
        v = tk.Vocabulary()
        for t in texts[:-2] + texts[-1:]:
            ids = v.encoding.encode_ordinary(t)
            assert v.count(t) == len(ids), t
            for n in (0, 1, 7, 100):
                assert v.tail(t, n) == (t if len(ids) <= n else v.encoding.decode(ids[len(ids) - n:] if n else [])), (t, n)
            assert "".join(reversed(list(v.parts_from_end(t)))) == t
    finally:
        tk.PART_CHARS = old
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: (r.n, r.tail) for r in df.select("i", tk.count_tokens()(F.col("t")).alias("n"), tk.truncate_tail_tokens(9)(F.col("t")).alias("tail")).collect()}
    for i, t in enumerate(texts):
        ids = v.encoding.encode_ordinary(t or "")
        assert got[i] == (len(ids), None if t is None else " " if not t.strip() else t if len(ids) <= 9 else v.encoding.decode(ids[-9:]))
    # a long context: only its end is encoded
    seen = []
    v.encoding = type("Spy", (), {"encode_ordinary": lambda _, t, e=v.encoding: seen.append(len(t)) or e.encode_ordinary(t), "decode": v.encoding.decode})()
    assert v.tail("a" + " word" * 400_000, 8190).count("word") == 8190 and sum(seen) < 200_000


def test_transcripts_without_strings(spark):
    rng = random.Random(6)
    roles = ["user", "assistant", "system", None]
    rows = [(c, t, rng.choice(roles), None if rng.random() < .05 else "\n".join(rng.choice(["", "hello", "Client: inside", "é" * 9, "Counselor: x y"]) for _ in range(rng.randint(1, 4))))
            for c in range(6) for t in range(rng.randint(1, 30))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    whole = conv.render_transcript(turns)
    lines = tr.transcript_lines(turns, chunk_rows=3)
    want = sorted(map(tuple, conv.turns_from_text(whole).select("conv_id", "line_no", "line", "speaker").collect()), key=repr)
    assert sorted(map(tuple, lines.select("conv_id", "line_no", "line", "speaker").collect()), key=repr) == want
    scanned = conv.speaker_scan(lines)
    text = {r.conv_id: r.conversation + "\n" for r in whole.collect()}
    for size in (1, 5, 64, 100_000):
        got = {}
        for r in sorted(tr.transcript_chunks(scanned, chunk_chars=size).collect()):
            got[r.conv_id] = got.get(r.conv_id, "") + r.text
            assert len(r.text) <= size
        assert got == text
    pairs = conv.history_pairs(conv.speaker_blocks(conv.turns_from_text(whole)), whole).collect()
    for size, most in ((7, 20), (64, 1), (1000, 10_000)):
        got = {(r.conversation_id, r.pair_idx): (r.history_chars, r.history_tail, r.message) for r in tr.history_tails(turns, most, chunk_chars=size, chunk_rows=4).collect()}
        assert got == {(r.conversation_id, r.pair_idx): (len(r.convo_history), r.convo_history[-most:], r.counselor_message) for r in pairs}


def test_a_hot_conversation_is_spread(spark):
    """One conversation of 3000 turns: its lines and chunks are worked on by several tasks, and no step makes its string."""
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                     F.concat(F.lit("turn "), "id").alias("text"))
    df = tr.history_tails(turns, 50, chunk_chars=500, chunk_rows=200)
    assert "conversation#" not in df._jdf.queryExecution().executedPlan().toString()
    scanned = conv.speaker_scan(tr.transcript_lines(turns, chunk_rows=200), chunk_rows=200)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert tr.transcript_chunks(scanned, chunk_chars=500).select(F.spark_partition_id()).distinct().count() > 1
        assert scanned.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    rows = {r.pair_idx: r for r in df.collect()}
    assert len(rows) == 1500 and rows[700].history_tail.endswith("Client: turn 1400") and rows[700].message == "turn 1401"
