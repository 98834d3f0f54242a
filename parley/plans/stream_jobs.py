"""Streaming jobs: each runs a Structured Streaming query to completion (availableNow) and returns
its result table; the oracle is the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.text import to_float_safe
from parley.operators import judge as jg
from parley.operators import latency as lt
from parley.operators.conversation import render_transcript
from parley.operators.retrieval import rag_pairs
from parley.operators.udfs import embedder, feature_embedding
from parley.plans import inputs
from parley.plans import judge_jobs, latency_jobs, retrieval_jobs  # noqa: F401 - their oracle SQL is reused below
from parley.plans.registry import ORACLE, job
from parley.streaming import jobs as st
from parley.streaming import sessions

_EXTRACT_SQL = ORACLE["extract_completions"]


@job("st_ingest_completions", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY uid, prompt_template_name, input_file_name ORDER BY file_name DESC, content DESC) AS rn FROM ({_EXTRACT_SQL}))
WHERE rn = 1""")
def st_ingest_completions(spark, d):
    """Stream of conversation turns -> completion JSONL lines -> extracted once per uid, template and file (foreachBatch, epoch-idempotent)."""
    lines = inputs.completion_lines_from(st.table_stream(spark, d, "conversations"))
    return st.ingest_completions(spark, lines, jg.completion_extract, st.stream_root(spark, "ingest_completions"))


_LAT_SQL = ORACLE["latency_metrics"]
_OBS_CTES = _LAT_SQL[:_LAT_SQL.index("kept AS (")].rstrip().rstrip(",")


@job("st_dedupe_obs", _OBS_CTES + """
SELECT trace_id, id, name, type FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id, id ORDER BY start_time) AS rn FROM obs WHERE id IS NOT NULL) WHERE rn = 1
UNION ALL SELECT trace_id, id, name, type FROM obs WHERE id IS NULL""")
def st_dedupe_obs(spark, d):
    """Observation stream -> repeated ids within a 1-hour watermark dropped (NULL ids pass)."""
    obs = inputs.observations_from(st.table_stream(spark, d, "events"))
    out = st.dedupe_stream(obs, st.stream_root(spark, "dedupe_obs"))
    return out.select("trace_id", "id", "name", "type")


def _side():
    name = F.coalesce(F.col("name"), F.lit(""))
    return (F.when(lt.turn_number(name, lt.PATIENT_PREFIXES).isNotNull(), F.lit("patient"))
            .when(lt.embedding_turn(name).isNotNull() | lt.turn_number(name, lt.COUNSELOR_PREFIXES).isNotNull(),
                  F.lit("counselor")))


_SIDE_SQL = ("CASE WHEN " + latency_jobs._turn(lt.PATIENT_PREFIXES) + " IS NOT NULL THEN 'patient' "
             "WHEN (contains(lower(name), 'embed') AND coalesce(" + latency_jobs._turn(lt.EMBEDDING_PREFIXES)
             + ", TRY_CAST(regexp_extract_all(lower(name), 'turn-(\\d+)', 1)[-1] AS BIGINT)) IS NOT NULL) OR "
             + latency_jobs._turn(lt.COUNSELOR_PREFIXES) + " IS NOT NULL THEN 'counselor' END")


@job("st_latency_window", _OBS_CTES + f""",
kept AS (SELECT * FROM obs WHERE lower(coalesce(type, '')) IN ('', 'generation')
                              OR (lower(type) = 'span' AND contains(lower(coalesce(name, '')), 'embed'))),
sd AS (SELECT start_time, {_SIDE_SQL} AS side, TRY_CAST(CAST(latency AS VARCHAR) AS DOUBLE) AS lat
       FROM (SELECT start_time, coalesce(name, '') AS name, latency FROM kept))
SELECT time_bucket(INTERVAL 1 HOUR, start_time) AS window_start, side, count(*) AS n_calls, count(lat) AS n_timed,
       round(sum(lat), 6) AS total_latency
FROM sd WHERE side IS NOT NULL GROUP BY ALL""")
def st_latency_window(spark, d):
    """Observation stream -> tumbling 1-hour latency per side under a 2-hour watermark (append mode)."""
    obs = inputs.observations_from(st.table_stream(spark, d, "events"))
    obs = obs.filter(lt.keep_observation(F.col("type"), F.col("name")))
    out = st.latency_windows(obs, st.stream_root(spark, "latency_window"), _side(),
                             to_float_safe("latency"))
    return out.withColumn("total_latency", F.round("total_latency", 6))


_RUNS_SQL = f"""
runs AS (SELECT c_custkey AS trace_id, 'run-' || CAST(c_nationkey % 3 AS VARCHAR) AS run_name FROM customer),
kept AS (SELECT * FROM obs WHERE lower(coalesce(type, '')) IN ('', 'generation')
                              OR (lower(type) = 'span' AND contains(lower(coalesce(name, '')), 'embed'))),
sd AS (SELECT run_name, start_time, {_SIDE_SQL} AS side, TRY_CAST(CAST(latency AS VARCHAR) AS DOUBLE) AS lat
       FROM (SELECT run_name, start_time, coalesce(name, '') AS name, latency FROM kept JOIN runs USING (trace_id)))"""
_WINDOW_SUMS = "count(*) AS n_calls, count(lat) AS n_timed, round(sum(lat), 6) AS total_latency, max(lat) AS max_latency"


def _run_windows(spark, d, name: str, **kw):
    obs = inputs.observations_from(st.table_stream(spark, d, "events"))
    obs = obs.filter(lt.keep_observation(F.col("type"), F.col("name")))
    prefix = inputs.LATENCY_DATASET + "/"
    tags = inputs.obs_traces(spark, d).select("trace_id", F.explode("tags").alias("tag")).where(F.col("tag").startswith(prefix))
    runs = tags.select("trace_id", F.expr(f"substring(tag, {len(prefix) + 1})").alias("run_name"))
    out = st.run_latency_windows(obs, runs, st.stream_root(spark, name), _side(), to_float_safe("latency"), **kw)
    return out.withColumn("total_latency", F.round("total_latency", 6))


@job("st_latency_runs", _OBS_CTES + "," + _RUNS_SQL + f"""
SELECT run_name, time_bucket(INTERVAL 1 HOUR, start_time) AS window_start, side, {_WINDOW_SUMS}
FROM sd WHERE side IS NOT NULL GROUP BY ALL""")
def st_latency_runs(spark, d):
    """Observation stream joined with the runs of its traces -> tumbling 1-hour latency per run and side."""
    return _run_windows(spark, d, "latency_runs")


@job("st_latency_sliding", _OBS_CTES + "," + _RUNS_SQL + f"""
SELECT run_name, time_bucket(INTERVAL 15 MINUTE, start_time) - INTERVAL (15 * k) MINUTE AS window_start, side, {_WINDOW_SUMS}
FROM sd, generate_series(0, 3) AS g(k) WHERE side IS NOT NULL GROUP BY ALL""")
def st_latency_sliding(spark, d):
    """The same in windows of an hour that start every 15 minutes, added up from panes of 15 minutes."""
    return _run_windows(spark, d, "latency_sliding", slide="15 minutes")


@job("st_dialogue_turns", """
WITH e AS (SELECT user_id, ts, event_id, event_type AS role, lag(ts) OVER w AS before, lag(event_type) OVER w AS role_before
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, before IS NULL OR ts - before >= INTERVAL 30 MINUTE AS opens FROM e),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM f)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_messages,
       CAST(sum(CASE WHEN opens OR role <> role_before THEN 1 ELSE 0 END) AS BIGINT) AS n_turns,
       arg_min(role, ts) AS first_role, arg_max(role, ts) AS last_role, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 6) AS duration_sec
FROM s GROUP BY user_id, sid""")
def st_dialogue_turns(spark, d):
    """Event stream -> per-user dialogues closed after 30 idle minutes, with messages, turns and duration (keyed state and timers)."""
    ev = st.table_stream(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    out = sessions.turn_sessions(ev, st.stream_root(spark, "dialogue_turns"), "user_id", "ts", "event_type", "event_id")
    return out.withColumn("duration_sec", F.round("duration_sec", 6))


@job("st_dialogue_session", """
WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                                      OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE
                                    THEN 1 ELSE 0 END AS new_s FROM events),
s AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events,
       round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 6) AS duration_sec
FROM s GROUP BY user_id, sid""")
def st_dialogue_session(spark, d):
    """Event stream -> per-user sessions closed after 30 idle minutes (session_window): size and duration."""
    ev = st.table_stream(spark, d, "events").select("user_id", "ts")
    out = st.dialogue_sessions(ev, st.stream_root(spark, "dialogue_session"), "user_id", "ts")
    return out.select("user_id", "session_start", "session_end", "n_events",
                      F.round("duration_sec", 6).alias("duration_sec"))


_EMB_SQL = ORACLE["embedding_cache"]
_EMB_CTES = _EMB_SQL[:_EMB_SQL.rindex("SELECT p.conversation_id")]


@job("st_embed_new", _EMB_CTES + """
SELECT hash, response, source, round(CAST(embedding[1] AS DOUBLE), 6) AS e0, round(CAST(embedding[2] AS DOUBLE), 6) AS e1,
       round(CAST(embedding[3] AS DOUBLE), 6) AS e2, round(CAST(embedding[4] AS DOUBLE), 6) AS e3
FROM merged""")
def st_embed_new(spark, d):
    """Stream of conversation turns -> per micro-batch: RAG pairs not in the cache -> embedded -> appended."""
    turns = st.table_stream(spark, d, "conversations")
    cache = inputs.rag_cache(spark, d)
    out = st.embed_new(turns, st.stream_root(spark, "embed_new"), cache,
                       lambda b: rag_pairs(render_transcript(b)), embedder(feature_embedding))
    return out.select("hash", "response", "source",
                      *[F.round(F.col("embedding")[i].cast("double"), 6).alias(f"e{i}") for i in range(4)])

