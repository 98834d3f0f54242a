"""Latency and turn metrics per run - islands of group-bys, no per-trace loops.

observations -> keep generations and embedding spans -> one row per observation
id (first by start time; partial ``min_by`` aggregation, so a hot trace is
combined map-side) -> classify by name -> per (trace, turn) -> per trace ->
per run, left-joined from all traces of the run so a trace without
observations still counts in the turn averages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import to_float_safe
from parley.operators.runs import discover_runs

# Observation name prefixes.
PATIENT_PREFIXES = ["patient-turn"]
COUNSELOR_PREFIXES = ["counselor-turn", "counselor-editor-turn"]
EMBEDDING_PREFIXES = ["rag-embedding-turn", "query-embedding-turn", "embedding-turn", "rag-retrieve-turn",
                      "rag-retrieval-turn"]


def turn_number(name, prefixes: list[str]):
    """``^(prefix)-(\\d+)$`` -> the number, else NULL."""
    alts = "|".join(p.replace("-", "\\-") for p in prefixes)
    return F.nullif(F.regexp_extract(name, rf"^(?:{alts})-(\d+)$", 1), F.lit("")).try_cast("bigint")


def embedding_turn(name):
    """Embedding call names (containing 'embed'): explicit prefixes, else the last ``turn-N`` in the name."""
    low = F.lower(name)
    last = F.element_at(F.regexp_extract_all(low, F.lit(r"turn-(\d+)"), 1), -1)
    return F.when(low.contains("embed"), F.coalesce(turn_number(name, EMBEDDING_PREFIXES), last.try_cast("bigint")))


def keep_observation(type_col, name_col):
    """Generations, embedding spans, and untyped observations."""
    t = F.lower(F.coalesce(type_col.cast("string"), F.lit("")))
    n = F.lower(F.coalesce(name_col, F.lit("")))
    return (t == "") | (t == "generation") | ((t == "span") & n.contains("embed"))


def dedupe_observations(obs: DataFrame) -> DataFrame:
    """Each observation id once per trace (earliest start wins); NULL ids are never merged."""
    keyed = obs.filter(F.col("id").isNotNull())
    rest = [c for c in obs.columns if c not in ("trace_id", "id")]
    first = (keyed.groupBy("trace_id", "id")
             .agg(F.min_by(F.struct(*rest), F.struct(F.col("start_time"), F.col("name"))).alias("_o"))
             .select("trace_id", "id", "_o.*"))
    return first.unionByName(obs.filter(F.col("id").isNull()))


def latency_metrics(traces: DataFrame, observations: DataFrame, dataset: str,
                    trace_name: str = "generated-conversation") -> DataFrame:
    """Per run of ``dataset``: traces, pooled mean exchange latency, mean counselor turns, mean trace latency,
    mean conversation turns (0 when there is nothing to average)."""
    obs = observations.withColumn("start_time", F.coalesce("start_time", "startTime", "created_at", "createdAt")) \
        if "startTime" in observations.columns else observations
    obs = obs.filter(keep_observation(F.col("type"), F.col("name")))
    obs = dedupe_observations(obs)
    name = F.coalesce(F.col("name"), F.lit(""))
    p = turn_number(name, PATIENT_PREFIXES)
    e = embedding_turn(name)
    c = turn_number(name, COUNSELOR_PREFIXES)
    side = F.when(p.isNotNull(), F.lit("patient")).when(e.isNotNull() | c.isNotNull(), F.lit("counselor"))
    turn = F.coalesce(p, e, c)
    lat = to_float_safe("latency")
    classified = obs.select("trace_id", side.alias("side"), turn.alias("turn"), lat.alias("lat")).filter(F.col("side").isNotNull())
    per_turn = classified.groupBy("trace_id", "turn").agg(
        F.max((F.col("side") == "patient").cast("int")).alias("has_p"),
        F.max((F.col("side") == "counselor").cast("int")).alias("has_c"),
        F.count("lat").alias("n_lat"), F.coalesce(F.sum("lat"), F.lit(0.0)).alias("lat_sum"))
    per_trace = per_turn.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum("has_p").alias("n_p"), F.sum("has_c").alias("n_c"),
        F.sum(F.when(F.col("n_lat") > 0, F.col("lat_sum"))).alias("x_sum"),
        F.count_if(F.col("n_lat") > 0).alias("x_n"))
    prefix = dataset + "/"
    run_name = F.expr(f"substring(tag, {len(prefix) + 1})").alias("run_name")
    tagged = (traces.filter(F.col("name") == trace_name)
              .select("trace_id", "turn_count", "latency", F.explode("tags").alias("tag"))
              .filter(F.col("tag").startswith(prefix)).select(run_name, "trace_id", "turn_count", "latency"))
    meta = F.col("turn_count").cast("string").try_cast("bigint")
    meta = F.when(meta >= 0, meta)
    t = tagged.join(per_trace, "trace_id", "left")
    t = t.select("run_name", "trace_id",
                 F.coalesce(meta, F.col("n_turns"), F.lit(0)).alias("counselor_turns"),
                 F.coalesce(meta * 2, F.col("n_p") + F.col("n_c"), F.lit(0)).alias("conversation_turns"),
                 to_float_safe("latency").alias("trace_latency"), "x_sum", "x_n")
    g = t.groupBy("run_name").agg(
        F.count("trace_id").alias("n_traces"),
        F.sum("x_sum").alias("x_sum"), F.sum("x_n").alias("x_n"),
        F.avg(F.when(F.col("trace_id").isNotNull(), F.col("counselor_turns"))).alias("avg_counselor_turns"),
        F.avg("trace_latency").alias("avg_conversation_latency"),
        F.avg(F.when(F.col("trace_id").isNotNull(), F.col("conversation_turns"))).alias("avg_conversation_turns"))
    g = discover_runs(traces, dataset).join(g, "run_name", "left")  # one row per run on either side
    r = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return g.select("run_name", F.coalesce("n_traces", F.lit(0)).alias("n_traces"),
                    r(F.col("x_sum") / F.col("x_n")).alias("avg_exchange_latency"),
                    r(F.col("avg_counselor_turns")).alias("avg_counselor_turns"),
                    r(F.col("avg_conversation_latency")).alias("avg_conversation_latency"),
                    r(F.col("avg_conversation_turns")).alias("avg_conversation_turns"))
