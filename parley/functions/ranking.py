"""Row indexes inside groups without funnelling a group through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_index(df: DataFrame, keys: list[str], hash_col: str, tie_col: str, out: str = "group_idx",
                bucket_size: int = 50_000) -> DataFrame:
    """0-based index of each row inside its ``keys`` group, ordered by (bucket, hash, tie).

    A group of n rows is split into ceil(n / bucket_size) hash buckets; bucket
    offsets come from a per-(group, bucket) count table (one row per bucket,
    so it is small and AQE broadcasts it), and rows are numbered inside their
    bucket. A group holding a third of all rows is therefore indexed by many
    tasks, never one.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_nb", F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(bucket_size))).cast("bigint"))
    d = df.join(counts.select(*keys, "_nb"), keys, "left").withColumn("_b", F.pmod(F.col(hash_col), F.col("_nb")))
    bc = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bc = bc.withColumn("_off", F.coalesce(F.sum("_bn").over(wb), F.lit(0)))
    d = d.join(bc.select(*keys, "_b", "_off"), [*keys, "_b"], "left")
    w = Window.partitionBy(*keys, "_b").orderBy(hash_col, tie_col)
    return d.withColumn(out, F.col("_off") + F.row_number().over(w) - 1).drop("_nb", "_b", "_off")


def ordered_index(df: DataFrame, keys: list[str], id_col: str, out: str = "group_idx", ids_per_bucket: int = 100_000,
                  per_key: DataFrame | None = None) -> DataFrame:
    """0-based index of each row inside its ``keys`` group, in order of an integer id.

    A group is cut into ranges of ids; offsets come from the counts of these ranges, and rows are numbered inside their
    range, so no task holds a whole group. ``per_key`` (one row per key) adds its columns on the way, without a join of
    its own that would bring a group together.
    """
    d = df.withColumn("_b", F.floor(F.col(id_col) / ids_per_bucket))
    counts = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if per_key is not None:
        counts = counts.join(per_key, keys)
    left, right = d.alias("d"), counts.alias("c")  # null ids are a range of their own
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_b"]]
    d = left.join(right, on).select("d.*", "c._off", *[f"c.{x}" for x in (per_key.columns if per_key is not None else []) if x not in keys])
    w = Window.partitionBy(*keys, "_b").orderBy(id_col)
    return d.withColumn(out, F.col("_off") + F.row_number().over(w) - 1).drop("_b", "_off")


def segmented_scan(df: DataFrame, keys: list[str], pos: str, specs: list[tuple[str, str, str, bool]],
                   chunk_rows: int = 1_000_000, totals: bool = False) -> DataFrame:
    """Running aggregates per ``keys`` in ``pos`` order, computed chunk-parallel (a parallel prefix scan).

    ``specs``: (out_col, kind, value_col, inclusive) with kind ``sum`` (NULL counts as 0), ``max`` or ``last``
    (last non-NULL value); ``totals`` adds ``<out>_total`` (the whole key's sum) for every ``sum`` spec. Rows are cut into chunks of ``chunk_rows`` positions; each chunk is summarised by a
    partial aggregate, the summaries (one row per chunk) give every chunk its carry-in, and a window inside
    each bounded chunk finishes the scan. A key holding a third of all rows is scanned by many tasks.
    """
    d = df.withColumn("_chunk", F.floor(F.col(pos) / F.lit(chunk_rows)).cast("bigint"))
    aggs = []
    for out, kind, v, _incl in specs:
        if kind == "sum":
            aggs.append(F.coalesce(F.sum(v), F.lit(0)).alias(f"_s_{out}"))
        elif kind == "max":
            aggs.append(F.max(v).alias(f"_s_{out}"))
        elif kind == "last":
            aggs.append(F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(pos))).alias(f"_s_{out}"))
        else:
            raise ValueError(kind)
    summ = d.groupBy(*keys, "_chunk").agg(*aggs)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for out, kind, _v, _incl in specs:
        s = F.col(f"_s_{out}")
        c = {"sum": F.sum(s), "max": F.max(s), "last": F.last(s, ignorenulls=True)}[kind].over(before)
        carries.append(c.alias(f"_c_{out}"))
    if totals:  # whole-key value of every ``sum`` spec, from the summary table (no extra pass over the data)
        whole = Window.partitionBy(*keys)
        carries += [F.sum(F.col(f"_s_{out}")).over(whole).alias(f"{out}_total")
                    for out, kind, _v, _i in specs if kind == "sum"]
    summ = summ.select(*keys, "_chunk", *carries)
    d = d.join(summ, [*keys, "_chunk"], "left")
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    for out, kind, v, incl in specs:
        frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow if incl else -1)
        carry = F.col(f"_c_{out}")
        if kind == "sum":
            val = F.coalesce(carry, F.lit(0)) + F.coalesce(F.sum(v).over(frame), F.lit(0))
        elif kind == "max":
            val = F.greatest(carry, F.max(v).over(frame))
        else:
            val = F.coalesce(F.last(v, ignorenulls=True).over(frame), carry)
        d = d.withColumn(out, val)
    return d.drop("_chunk", *[f"_c_{o}" for o, *_ in specs])
