"""Selections, grids, manifests, latency rules, template filling, response shapes, salted indexes, scans."""

import random

from pyspark.sql import functions as F

from parley.functions.ranking import group_index, segmented_scan
from parley.functions.text import template_fill
from parley.operators import judge as jg
from parley.operators import latency as lt
from parley.operators import runs as rn


def test_expand_selection_order_and_misses(spark):
    keys = spark.createDataFrame([(k, i) for i, k in enumerate(["anx_1", "anx_2", "dep_1", "anx", "anx_x_3"])],
                                 "key string, key_pos int")
    sel, miss = rn.expand_selection(["dep", "anx", "zzz", "dep_1", "all"], keys)
    got = sorted((r.req_pos, r.sub_order, r.key) for r in sel.collect())
    # 'anx' is itself a key: its exact match wins and suppresses prefix hits; 'all' picks up the rest in key order
    assert [k for _, _, k in got] == ["dep_1", "anx", "anx_1", "anx_2", "anx_x_3"]
    assert [r.request for r in miss.collect()] == ["zzz"]


def test_experiment_grid_and_manifest(spark):
    profiles = spark.createDataFrame([("p1",), ("p2",)], "profile_key string")
    grid = rn.experiment_grid(profiles, {"model": ["a", "b", "c"], "editor": ["", "e"]})
    assert grid.count() == 12 and grid.select("model", "editor").distinct().count() == 6
    results = spark.createDataFrame([("r1", "x", None), ("r2", None, "boom"), ("r9", "y", None)],
                                    "custom_id string, content string, error string")
    manifest = spark.createDataFrame([("r1", "i1"), ("r2", "i2"), ("r3", "i3")], "custom_id string, dataset_item_id string")
    got = {r.custom_id: r.status for r in rn.join_manifest(results, manifest).collect()}
    assert got == {"r1": "ok", "r2": "error", "r9": "unknown_id", "r3": "pending"}


def test_latency_rules(spark):
    obs = [("o1", 1, "generation", "patient-turn-1", 1.0, 1), ("o1", 1, "generation", "patient-turn-1", 9.0, 2),
           ("o2", 1, "generation", "counselor-turn-1", 2.0, 3), ("o3", 1, "span", "rag-embedding-turn-1", 0.5, 4),
           ("o4", 1, "generation", "patient-editor-turn-2", 7.0, 5), (None, 1, "generation", "counselor-turn-2", None, 6),
           (None, 1, "generation", "counselor-turn-2", None, 7), ("o5", 1, "event", "patient-turn-3", 4.0, 8),
           ("o6", 1, "span", "x-embed-turn-4-turn-5", 1.5, 9)]
    o = spark.createDataFrame(obs, "id string, trace_id long, type string, name string, latency double, t long") \
        .withColumn("start_time", F.timestamp_seconds("t")).drop("t")
    traces = spark.createDataFrame([(1, "generated-conversation", ["ds/r"], None, 10.0),
                                    (2, "generated-conversation", ["ds/r"], 3, None),
                                    (3, "other", ["ds/r"], 1, 5.0)],
                                   "trace_id long, name string, tags array<string>, turn_count long, latency double")
    r = lt.latency_metrics(traces, o, "ds").first()
    # trace 1: turn1 = 1.0 + 2.0 + 0.5, turn2 has no numeric latency, turn5 (embedding fallback) = 1.5
    assert r.n_traces == 2 and r.avg_exchange_latency == round((3.5 + 1.5) / 2, 6)
    # counselor turns: trace 1 inferred 3 turns {1, 2, 5}; trace 2 metadata 3 -> mean 3; conversation turns (4 + 6) / 2
    assert r.avg_counselor_turns == 3.0 and r.avg_conversation_turns == 5.0 and r.avg_conversation_latency == 10.0


def test_template_fill_does_not_fill_values(spark):
    df = spark.createDataFrame([("say {id} and {uid} {{x}}", "u7", "7")], "note string, uid string, id string")
    out = df.select(template_fill(F.lit("{note}|{id}{uid}|{other}|{{note}}"), {"note": F.col("note"), "id": F.col("id"), "uid": F.col("uid")}).alias("t"))
    assert out.first().t == "say {id} and {uid} {{x}}|7u7|{other}|{note}"


def test_template_fill_braces(spark):
    df = spark.createDataFrame([("N {x}", "7")], "note string, uid string")
    out = df.select(template_fill(F.lit("{{literal}} {note} for {uid} {id}"),
                                  {"note": F.col("note"), "uid": F.col("uid"), "id": F.col("uid")}).alias("p")).first().p
    assert out == "{literal} N {x} for 7 7"


def test_response_shapes(spark):
    docs = ['{"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]}',
            '{"content": [{"type": "text", "text": "c"}, {"type": "image", "text": "z"}]}',
            '{"completion": "d"}', '{"choices": [{"message": {"content": "e"}}]}', '{"choices": [{"text": "f"}]}', '{}']
    df = spark.createDataFrame([(x,) for x in docs], "j string")
    got = [r.t for r in df.select(jg.response_normalize(F.parse_json("j")).alias("t")).collect()]
    assert got == ["ab", "c", "d", "e", "f", ""]


def test_group_index_hot_group(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", i) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, v long").withColumn("h", F.xxhash64("v"))
    out = group_index(df, ["k"], "h", "v", bucket_size=37).collect()
    for key, n in (("hot", 500), ("cold", 7)):
        assert sorted(r.group_idx for r in out if r.k == key) == list(range(n))


def test_segmented_scan_matches_python(spark):
    rnd = random.Random(2)
    rows = [(k, p, rnd.choice([None, 1, 2, 3])) for k in range(3) for p in range(40)]
    df = spark.createDataFrame(rows, "k long, p long, v long")
    out = segmented_scan(df, ["k"], "p", [("s", "sum", "v", True), ("m", "max", "v", False), ("l", "last", "v", False)],
                         chunk_rows=6).collect()
    got = {(r.k, r.p): (r.s, r.m, r.l) for r in out}
    for k in range(3):
        s, m, last = 0, None, None
        for p in range(40):
            v = rows[k * 40 + p][2]
            assert got[(k, p)][1:] == (m, last)
            s += v or 0
            assert got[(k, p)][0] == s
            if v is not None:
                m = v if m is None else max(m, v)
                last = v
