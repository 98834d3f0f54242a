"""Structured Streaming jobs - incremental twins of the batch jobs.

Every job reads a file source (new files = new micro-batches), runs with
``trigger(availableNow=True)`` and a checkpoint, and writes through
``foreachBatch`` into ``epoch=<id>`` partitions with overwrite, so a replayed
epoch replaces its own output: exactly-once end to end. All folders live under
the session's ``spark.checkpoint.dir`` (the shared folder on a cluster); each
run takes a fresh sub-folder. The functions return the result table as a
DataFrame read back from that folder.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import ensure_checkpoint_dir


def stream_root(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/parley-streams/{name}/{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A fixture table as a file stream (the glob keeps the single file as the source's only match)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parque[t]"
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_epochs(stream: DataFrame, root: str, per_batch: Callable[[DataFrame, int], DataFrame | None],
               output_mode: str = "append") -> str:
    """Run ``stream`` to completion; each micro-batch's result goes to ``<root>/out/epoch=<id>`` (overwrite)."""
    out = f"{root}/out"

    def handle(batch: DataFrame, epoch_id: int) -> None:
        res = per_batch(batch, epoch_id)
        if res is not None:
            res.write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")

    q = (stream.writeStream.outputMode(output_mode).foreachBatch(handle)
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


COMPLETION_KEY = ["uid", "prompt_template_name", "input_file_name"]


def ingest_completions(spark: SparkSession, lines: DataFrame, extract: Callable[[DataFrame], DataFrame],
                       root: str) -> DataFrame:
    """New JSONL lines -> extracted completions, exactly once per uid, template and input file (the latest epoch wins)."""
    out = run_epochs(lines, root, lambda b, e: extract(b))
    raw = spark.read.parquet(out)
    cols = [c for c in raw.columns if c not in (*COMPLETION_KEY, "epoch")]
    latest = raw.groupBy(*COMPLETION_KEY).agg(F.max_by(F.struct(*cols), F.struct("epoch", "file_name", "content")).alias("_l"))
    return latest.select(*COMPLETION_KEY, "_l.*")


def dedupe_stream(obs: DataFrame, root: str, horizon: str = "1 hour") -> DataFrame:
    """Drop repeated observation ids (per trace) seen within ``horizon`` of each other; NULL ids pass through."""
    obs = obs.withColumn("start_time", F.col("start_time").cast("timestamp"))
    keyed = (obs.filter(F.col("id").isNotNull()).withWatermark("start_time", horizon)
             .dropDuplicatesWithinWatermark(["trace_id", "id"]))
    stream = keyed.unionByName(obs.filter(F.col("id").isNull()))
    out = run_epochs(stream, root, lambda b, e: b)
    return obs.sparkSession.read.parquet(out).drop("epoch")


def _end_marker(spark: SparkSession, root: str, like: DataFrame, far: dt.datetime = dt.datetime(9999, 1, 1)) -> tuple[DataFrame, Callable[[], None]]:
    """A source that is empty until the returned function puts one row (far future, all else NULL) into it."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in like.schema.fields])
    path = f"{root}/end_of_stream"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)

    def close() -> None:
        row = tuple(far if isinstance(f.dataType, T.TimestampType) else None for f in schema.fields)
        spark.createDataFrame([row], schema).write.mode("append").parquet(path)

    return spark.readStream.schema(schema).parquet(path), close


def run_and_close(build: Callable[[], DataFrame], root: str, per_batch, close: Callable[[], None] | None) -> str:
    """Run a windowed stream in append mode until its source is drained; then, if ``close`` is given, once more from the
    same checkpoint with the end marker, whose time closes every open window."""
    out = run_epochs(build(), root, per_batch)
    if close is not None:
        close()
        run_epochs(build(), root, per_batch)
    return out


def latency_windows(obs: DataFrame, root: str, side_col, latency_col, size: str = "1 hour",
                    delay: str = "2 hours", flush_at_end: bool = True) -> DataFrame:
    """Tumbling-window latency per side, emitted once a window is past the watermark (append mode).

    Rows later than the watermark are dropped and closed windows leave the state. With ``flush_at_end`` the windows
    that are open when the source is drained are closed by an end marker.
    """
    spark = obs.sparkSession
    s = obs.select(F.col("start_time").cast("timestamp").alias("start_time"), side_col.alias("side"),
                   latency_col.alias("lat")).filter(F.col("side").isNotNull())
    marker, close = _end_marker(spark, root, s)

    def build() -> DataFrame:
        return (s.unionByName(marker).withWatermark("start_time", delay).groupBy(F.window("start_time", size).alias("w"), "side")
                .agg(F.count(F.lit(1)).alias("n_calls"), F.count("lat").alias("n_timed"), F.sum("lat").alias("total_latency")))

    out = run_and_close(build, root, lambda b, e: b.filter(F.col("side").isNotNull()).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "side", "n_calls", "n_timed", "total_latency"),
        close if flush_at_end else None)
    return spark.read.parquet(out).drop("epoch")


def run_latency_windows(obs: DataFrame, runs: DataFrame, root: str, side_col, latency_col, size: str = "1 hour", slide: str | None = None,
                        delay: str = "2 hours", flush_at_end: bool = True) -> DataFrame:
    """Latency per run and side in tumbling windows, or in sliding ones that start every ``slide``.

    The stream meets the static table ``runs`` (trace_id, run_name; a trace may be in several runs). Each observation
    is added to one pane of length ``slide``; panes that the watermark has passed are added to the windows over
    them. So a row touches one entry of state however many windows overlap, and late rows are dropped once, at the
    panes. Observations of no run, side or time are left out.
    """
    spark = obs.sparkSession
    s = obs.select("trace_id", F.col("start_time").cast("timestamp").alias("start_time"), side_col.alias("side"), latency_col.alias("lat"))
    marker, close = _end_marker(spark, root, s)
    sums = ("n_calls", "n_timed", "total_latency")

    def build() -> DataFrame:
        known = s.where("side IS NOT NULL AND start_time IS NOT NULL").unionByName(marker).withWatermark("start_time", delay)
        # a key without nulls: a null check would be pushed below the watermark and take the end marker away
        rows = known.withColumn("_trace", F.coalesce(F.col("trace_id").cast("string"), F.lit(""))).join(
            runs.where("trace_id IS NOT NULL").select(F.col("trace_id").cast("string").alias("_trace"), "run_name").distinct(), "_trace")
        panes = rows.groupBy(F.window("start_time", slide or size).alias("w"), "run_name", "side").agg(
            F.count(F.lit(1)).alias("n_calls"), F.count("lat").alias("n_timed"), F.sum("lat").alias("total_latency"), F.max("lat").alias("max_latency"))
        if slide is None:
            return panes
        return panes.groupBy(F.window("w", size, slide).alias("w"), "run_name", "side").agg(
            *[F.sum(c).alias(c) for c in sums], F.max("max_latency").alias("max_latency"))

    out = run_and_close(build, root, lambda b, e: b.select(
        "run_name", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "side", *sums, "max_latency"), close if flush_at_end else None)
    return spark.read.parquet(out).drop("epoch")


def dialogue_sessions(events: DataFrame, root: str, key: str, ts: str, gap: str = "30 minutes",
                      delay: str = "1 hour", flush_at_end: bool = True) -> DataFrame:
    """Close a dialogue after ``gap`` of silence: sessions per key with message count and duration.

    Session windows run in append mode: a session is emitted once the
    watermark passes its end. For a bounded replay (``flush_at_end``) an end
    marker follows once the source is drained and closes every session; the
    marker's own session is never emitted.
    """
    spark = events.sparkSession
    events = events.select(key, F.col(ts).cast("timestamp").alias(ts))
    marker, close = _end_marker(spark, root, events)

    def build() -> DataFrame:
        return (events.unionByName(marker).withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("s"))
                .agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")))

    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    out = run_and_close(build, root, lambda b, e: b.filter(F.col(key).isNotNull()).select(
        key, ntz("s.start").alias("session_start"), ntz("s.end").alias("session_end"), "n_events",
        ntz("first_ts").alias("first_ts"), ntz("last_ts").alias("last_ts")), close if flush_at_end else None)
    res = spark.read.parquet(out).drop("epoch")
    secs = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return res.withColumn("duration_sec", secs("last_ts") - secs("first_ts"))


def embed_new(turns: DataFrame, root: str, initial_cache: DataFrame,
              pairs_of: Callable[[DataFrame], DataFrame], embed) -> DataFrame:
    """Per micro-batch: pairs of the batch's conversations not yet cached -> embedded -> appended to the cache.

    The cache is the union of the seed cache and every epoch's new rows; the
    latest row per hash is current. Each micro-batch must carry whole
    conversations (one file per set of conversations).
    """
    spark = turns.sparkSession
    seed_path, out_path = f"{root}/seed", f"{root}/out"
    initial_cache.write.mode("overwrite").parquet(seed_path)
    kind = initial_cache.schema["embedding"].dataType.simpleString()
    schema = f"hash string, response string, embedding {kind}, cached_at bigint"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out_path}/epoch=-1")  # so that the folder is there

    def epochs() -> DataFrame:
        return spark.read.schema(f"{schema}, epoch bigint").parquet(out_path)

    def per_batch(batch: DataFrame, epoch_id: int):
        from parley.operators.retrieval import new_pairs, truncate_tail
        before = epochs().filter(F.col("epoch") < epoch_id)  # a replayed epoch does not see its own rows
        cache = spark.read.parquet(seed_path).select("hash").unionByName(before.select("hash"))
        fresh = new_pairs(pairs_of(batch), cache)
        one = fresh.groupBy("hash").agg(F.min_by(F.struct("context", "response"),
                                                 F.struct("conversation_id", "pair_idx")).alias("_p"))
        return one.select("hash", F.col("_p.response").alias("response"),
                          embed(truncate_tail(F.col("_p.context"))).cast(kind).alias("embedding"),
                          (F.lit(1_000_000_000) + F.lit(epoch_id)).cast("bigint").alias("cached_at"))

    run_epochs(turns, root, per_batch)
    seed = spark.read.parquet(seed_path).withColumn("source", F.lit("cache"))
    allc = seed.unionByName(epochs().drop("epoch").withColumn("source", F.lit("new")), allowMissingColumns=True)
    latest = allc.groupBy("hash").agg(F.max_by(F.struct("response", "embedding", "source"), "cached_at").alias("_c"))
    return latest.select("hash", "_c.response", "_c.embedding", "_c.source")
