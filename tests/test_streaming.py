"""Streaming jobs equal their batch twins on inline files."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from parley.operators import latency as lt
from parley.streaming import jobs as st


def _write(spark, rows, schema):
    d = tempfile.mkdtemp(prefix="parley-stream-src-")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(os.path.join(d, "t"))
    return os.path.join(d, "t")


def test_dedupe_stream_matches_batch(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    rows = [("a", 1, "generation", "patient-turn-1", 1.0, t0), ("a", 1, "generation", "patient-turn-1", 2.0, t0 + dt.timedelta(seconds=5)),
            (None, 1, "generation", "counselor-turn-1", 3.0, t0), (None, 1, "generation", "counselor-turn-1", 3.0, t0),
            ("b", 2, "span", "rag-embedding-turn-2", 4.0, t0)]
    schema = "id string, trace_id long, type string, name string, latency double, start_time timestamp"
    path = _write(spark, rows, schema)
    stream = spark.readStream.schema(schema).parquet(path)
    out = st.dedupe_stream(stream, st.stream_root(spark, "test_dedupe"))
    batch = lt.dedupe_observations(spark.read.parquet(path))
    key = lambda df: sorted((r.trace_id, r.id or "", r.name) for r in df.collect())
    assert key(out) == key(batch) and out.count() == 4


def _files(spark, batches, schema):
    """One file per batch, read one per trigger, in order."""
    path = os.path.join(tempfile.mkdtemp(prefix="parley-stream-src-"), "t")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.startswith("part-") and not f.startswith("part-b"):
                os.rename(os.path.join(path, f), os.path.join(path, f"part-b{n:03d}-{f}"))
                os.utime(os.path.join(path, f"part-b{n:03d}-{f}"), (1_700_000_000 + 60 * n,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), path


def test_sessions_over_many_batches(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    batches = [[(7, at(0)), (7, at(10)), (8, at(0))], [(7, at(25)), (7, at(70))], [(7, at(71)), (8, at(300))], [(9, at(305))], [(7, at(10)), (9, at(310))]]
    stream, _ = _files(spark, batches, "user_id long, ts timestamp")
    out = st.dialogue_sessions(stream, st.stream_root(spark, "test_many"), "user_id", "ts")
    got = sorted((r.user_id, r.n_events, r.duration_sec) for r in out.collect())
    # the repeated (7, 10) of the last file is later than the watermark and dropped
    assert got == [(7, 2, 60.0), (7, 3, 1500.0), (8, 1, 0.0), (8, 1, 0.0), (9, 2, 300.0)]


def _turn_twin(rows, gap=30):
    """Sessions of (user, minute, id, role) rows by definition."""
    out = []
    for user in sorted({r[0] for r in rows}):
        session = None
        for _, m, i, role in sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2])):
            if session and m - session[2] < gap:
                session[2], session[3], session[4], session[5] = m, session[3] + 1, session[4] + (role != session[5]), role
            else:
                session = [user, m, m, 1, 1, role]
                out.append(session)
    return sorted((u, n, turns, 60.0 * (b - a)) for u, a, b, n, turns, _ in out)


def test_turn_sessions_over_files_late_rows_and_a_restart(spark):
    from parley.streaming import sessions

    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    files = [[(7, 0, "a", "user"), (7, 10, "b", "assistant"), (8, 0, "c", "user"), (7, 5, "d", "user")],
             [(7, 25, "e", "assistant"), (7, 20, "f", "user"), (7, 70, "g", "user"), (8, 20, "h", "user")],  # out of order, within the delay
             [(7, 71, "i", "assistant"), (8, 300, "j", "user"), (9, 300, "k", "user"), (9, 300, "l", "assistant")],
             [(9, 305, "m", "assistant"), (7, 12, "late", "user"), (8, 310, "n", "user")]]
    schema = "user_id long, ts timestamp, id string, role string"
    row = lambda r: (r[0], t0 + dt.timedelta(minutes=r[1]), r[2], r[3])
    stream, path = _files(spark, [[row(r) for r in f] for f in files[:3]], schema)
    root = st.stream_root(spark, "test_turns")
    run = lambda s, **kw: sessions.turn_sessions(s, root, "user_id", "ts", "role", "id", **kw)
    read = lambda df: sorted((r.user_id, r.n_messages, r.n_turns, r.duration_sec) for r in df.collect())
    first = read(run(stream, flush_at_end=False))
    closed = [r for r in _turn_twin([r for f in files[:3] for r in f]) if r[0] == 7 or (r[0] == 8 and r[1] == 2)]
    assert first == closed  # what the watermark has passed; the sessions at 300 are open
    spark.createDataFrame([row(r) for r in files[3]], schema).coalesce(1).write.mode("append").parquet(path)
    rows = [r for f in files for r in f if r[2] != "late"]  # the late row is dropped
    assert read(run(stream)) == _turn_twin(rows)


def test_run_latency_windows_tumbling_and_sliding(spark):
    t0 = dt.datetime(2024, 1, 10, 10, 0, 0)
    row = lambda trace, m, lat, side="patient": (trace, t0 + dt.timedelta(minutes=m), side, lat)
    batches = [[row(1, 0, 1.0), row(2, 50, 2.0)], [row(1, 400, 3.0), row(9, 400, 7.0), row(None, 400, 7.0)], [row(1, -5000, 9.0), row(2, 410, None), row(1, 420, 5.0, None)], [row(1, 500, 4.0)]]
    runs = spark.createDataFrame([(1, "r1"), (2, "r1"), (2, "r2"), (2, "r2")], "trace_id long, run_name string")
    for slide in (None, "15 minutes"):
        stream, _ = _files(spark, batches, "trace_id long, start_time timestamp, side string, lat double")
        out = st.run_latency_windows(stream, runs, st.stream_root(spark, "test_runs"), F.col("side"), F.col("lat"), slide=slide)
        got = sorted((r.run_name, r.window_start, r.n_calls, r.n_timed, r.total_latency, r.max_latency) for r in out.collect())
        want = {}
        for trace, at, side, lat in [r for b in batches for r in b]:
            if at < t0 or side is None:  # later than the watermark
                continue
            for run in {1: ["r1"], 2: ["r1", "r2"]}.get(trace, []):
                m = int((at - t0).total_seconds()) // 60
                starts = [m // 60 * 60] if slide is None else [m // 15 * 15 - 15 * k for k in range(4)]
                for s in starts:
                    want.setdefault((run, t0 + dt.timedelta(minutes=s)), []).append(lat)
        assert got == sorted((run, s, len(x), sum(v is not None for v in x), sum(v for v in x if v is not None) if any(v is not None for v in x) else None,
                              max((v for v in x if v is not None), default=None)) for (run, s), x in want.items()), slide


def test_latency_windows_drop_late_rows(spark):
    t0 = dt.datetime(2024, 1, 10, 10, 0, 0)
    row = lambda h, lat: ("patient", lat, t0 + dt.timedelta(hours=h))
    batches = [[row(0, 1.0), row(0.5, 2.0)], [row(5, 3.0)], [row(-200, 9.0), row(5.5, None)], [row(6, 4.0)]]
    stream, _ = _files(spark, batches, "side string, lat double, start_time timestamp")
    out = st.latency_windows(stream, st.stream_root(spark, "test_windows"), F.col("side"), F.col("lat"))
    got = sorted((r.window_start, r.n_calls, r.n_timed, r.total_latency) for r in out.collect())
    hour = lambda h: t0 + dt.timedelta(hours=h)
    assert got == [(hour(0), 2, 2, 3.0), (hour(5), 2, 1, 3.0), (hour(6), 1, 1, 4.0)]


def test_ingest_keeps_every_template_and_the_latest(spark):
    schema = "uid string, prompt_template_name string, input_file_name string, file_name string, content string"
    batches = [[("u", "a", "f", "x", "1"), ("u", "b", "f", "x", "2")], [("u", "c", "f", "x", "3"), ("u", "a", "f", "x", "4")], [("v", "a", "g", "x", "5")]]
    stream, _ = _files(spark, batches, schema)
    out = st.ingest_completions(spark, stream, lambda b: b, st.stream_root(spark, "test_ingest"))
    assert sorted((r.uid, r.prompt_template_name, r.content) for r in out.collect()) == [("u", "a", "4"), ("u", "b", "2"), ("u", "c", "3"), ("v", "a", "5")]


def test_embed_new_over_batches_and_a_replayed_epoch(spark):
    schema = "conversation_id long, pair_idx long, context string, response string, hash string"
    rows = [[(1, 0, "c1", "r1", "h1"), (1, 1, "c2", "r2", "h2")], [(2, 0, "c1", "r1", "h1"), (2, 1, "c3", "r3", "h3")], [(3, 0, "c4", "r4", "h4")]]
    embed = lambda c: F.array(F.length(c).cast("float"))
    calls = []

    def pairs(batch):
        calls.append(batch.count())
        return batch

    seed = spark.createDataFrame([("h2", "r2", [0.5], 1)], "hash string, response string, embedding array<float>, cached_at long")
    stream, _ = _files(spark, rows, schema)
    root = st.stream_root(spark, "test_embed")
    out = st.embed_new(stream, root, seed, pairs, embed)
    got = sorted((r.response, r.source) for r in out.collect())
    assert len(calls) == 3 and got == [("r1", "new"), ("r2", "cache"), ("r3", "new"), ("r4", "new")]
    # the last epoch again, as after a failure between its output and its commit
    last = max(f for f in os.listdir(os.path.join(root.removeprefix("file:"), "checkpoint", "commits")) if f.isdigit())
    for f in (last, f".{last}.crc"):
        os.remove(os.path.join(root.removeprefix("file:"), "checkpoint", "commits", f))
    again = st.embed_new(stream, root, seed, pairs, embed)
    assert len(calls) == 4 and sorted((r.response, r.source) for r in again.collect()) == got


def test_sessions_close_at_end_of_input(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    mins = [0, 10, 25, 70, 71, 200]
    rows = [(7, t0 + dt.timedelta(minutes=m)) for m in mins] + [(8, t0)]
    path = _write(spark, rows, "user_id long, ts timestamp")
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(path)
    out = st.dialogue_sessions(stream, st.stream_root(spark, "test_sessions"), "user_id", "ts")
    got = sorted((r.user_id, r.n_events, r.duration_sec) for r in out.collect())
    assert got == [(7, 1, 0.0), (7, 2, 60.0), (7, 3, 1500.0), (8, 1, 0.0)]
