"""Run bookkeeping: manifests, grids, selections, upserts, run discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import stable_id


def join_manifest(results: DataFrame, manifest: DataFrame, key: str = "custom_id") -> DataFrame:
    """Batch results left-joined to the manifest; status ok / error / unknown_id, plus manifest rows
    without any result as 'pending' (full outer join on the request id)."""
    r = results.withColumn("_r", F.lit(1))
    m = manifest.withColumn("_m", F.lit(1))
    j = r.join(m, key, "full")
    status = (F.when(F.col("_r").isNull(), F.lit("pending"))
              .when(F.col("_m").isNull(), F.lit("unknown_id"))
              .when(F.col("error").isNotNull(), F.lit("error"))
              .otherwise(F.lit("ok")))
    return j.withColumn("status", status).drop("_r", "_m")


def run_counts(joined: DataFrame) -> DataFrame:
    """processed / error / unknown / pending counters (``groupBy(status).count()``)."""
    return joined.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def experiment_grid(profiles: DataFrame, dims: dict[str, list[str]]) -> DataFrame:
    """Sampled profiles x every combination of the configuration lists in ``dims``.

    The lists are driver-side config (counselor prompts, editor prompts, phases,
    models); each is expanded per row with ``explode`` - a fan-out of bounded
    width, never a join. '' means "none".
    """
    out = profiles
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def sample_profiles(profiles: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """k profiles chosen by a seeded hash order (a sampling operator: the limit is the feature)."""
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return profiles.orderBy(order, key).limit(k)


def derive_category(key):
    """Profile key minus its last ``_`` part; the whole key when nothing would be left."""
    cut = F.regexp_replace(key, "_[^_]*$", "")
    return F.when(cut == "", key).otherwise(cut)


def expand_selection(requested: list[str], keys: DataFrame, key_col: str = "key",
                     key_pos_col: str = "key_pos") -> tuple[DataFrame, DataFrame]:
    """Resolve requested names against the available keys -> (selected keys, unmatched requests).

    A request is ``all`` (every key, in key order), an exact key, or else a
    prefix: keys starting with ``request + '_'`` (in sorted key order).
    Duplicates keep their first position. Output rows carry ``req_pos`` and
    ``sub_order``; ordering by them gives the reference's list order.

    ``requested`` is driver-side configuration, so it is inlined as a literal
    map request -> first position; each key probes the map with itself and its
    ``_``-prefixes (no request x key product). A prefix only counts when that
    request is not itself a key (the reference's exact match wins); the exact
    hits are at most ``len(requested)`` rows, so broadcasting them is bounded.
    """
    first_pos: dict[str, int] = {}
    for i, r in enumerate(requested):
        first_pos.setdefault(r, i)
    named = {r: i for r, i in first_pos.items() if r != "all"}
    spark = keys.sparkSession
    if named:
        req_map = F.create_map(*[x for r, i in named.items() for x in (F.lit(r), F.lit(i))])
    else:
        req_map = F.create_map().cast("map<string,int>")
    parts = F.split(F.col(key_col), "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                           lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    probes = F.array_distinct(F.array_union(F.array(F.col(key_col)), prefixes))
    k = keys.select(key_col, key_pos_col, F.explode(probes).alias("_probe"))
    k = k.withColumn("req_pos", F.try_element_at(req_map, F.col("_probe"))).filter(F.col("req_pos").isNotNull())
    exact_hits = (keys.filter(F.col(key_col).isin(*named.keys()) if named else F.lit(False))
                  .select(F.col(key_col).alias("_probe"), F.lit(True).alias("_is_key")).distinct())
    k = k.join(F.broadcast(exact_hits), "_probe", "left")
    is_exact = F.col("_probe") == F.col(key_col)
    hits = k.filter(is_exact | F.col("_is_key").isNull()).select(
        key_col, "req_pos", F.when(is_exact, F.lit("")).otherwise(F.col(key_col)).alias("_sub"))
    if "all" in first_pos:
        every = keys.select(key_col, F.lit(first_pos["all"]).alias("req_pos"),
                            F.lpad(F.col(key_pos_col).cast("string"), 20, "0").alias("_sub"))
        hits = hits.unionByName(every)
    best = hits.groupBy(key_col).agg(F.min(F.struct("req_pos", "_sub")).alias("_b"))
    selected = best.select(key_col, F.col("_b.req_pos").alias("req_pos"), F.col("_b._sub").alias("sub_order"))
    reqs = spark.createDataFrame([(r, i) for r, i in named.items()], "request string, req_pos int")
    misses = reqs.join(hits.select("req_pos").distinct(), "req_pos", "left_anti")
    return selected, misses


def upsert_latest(df: DataFrame, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """Rewriting an item replaces it: keep the latest row per key (last write wins).

    ``max_by`` over a struct is a partial aggregate, so a key rewritten millions
    of times costs one row per task before the shuffle (no per-key sort).
    """
    rest = [c for c in df.columns if c not in key_cols]
    latest = F.max_by(F.struct(*rest), F.struct(*order_cols))
    return df.groupBy(*key_cols).agg(latest.alias("_l")).select(*key_cols, "_l.*")


def stable_item_id(dataset, profile_key):
    """sha256('dynamic-evals::<dataset>::<profile_key>')."""
    return F.sha2(F.concat(F.lit("dynamic-evals::"), dataset, F.lit("::"), profile_key), 256)


def discover_runs(traces: DataFrame, dataset: str) -> DataFrame:
    """Distinct run names from ``<dataset>/<run>`` tags."""
    tags = traces.select(F.explode("tags").alias("tag"))
    prefix = dataset + "/"
    return (tags.filter(F.col("tag").startswith(prefix))
            .select(F.expr(f"substring(tag, {len(prefix) + 1})").alias("run_name")).distinct())


def traces_per_run(traces: DataFrame, dataset: str, name: str = "generated-conversation") -> DataFrame:
    """Traces of the given name per run of ``dataset`` (0 for runs without one): one pass, no join on the tag."""
    prefix = dataset + "/"
    tags = traces.select("trace_id", "name", F.explode("tags").alias("tag")).filter(F.col("tag").startswith(prefix))
    return tags.groupBy(F.expr(f"substring(tag, {len(prefix) + 1})").alias("run_name")).agg(
        F.count(F.when(F.col("name") == name, F.col("trace_id"))).alias("n_traces"))


def runs_paged(traces: DataFrame, dataset: str, run: str, name: str = "generated-conversation") -> DataFrame:
    """All traces of one ``dataset/run`` tag with the given trace name (server-side filter of the reference)."""
    return traces.filter(F.array_contains("tags", f"{dataset}/{run}") & (F.col("name") == name))


__all__ = ["join_manifest", "run_counts", "experiment_grid", "sample_profiles", "derive_category",
           "expand_selection", "upsert_latest", "stable_item_id", "discover_runs", "runs_paged", "stable_id"]
