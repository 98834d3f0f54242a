"""Tiered demographic profile matching and example sampling.

The reference lists every match of every target and then samples five - a
quadratic step (a concern group of n profiles gives n^2 pairs). Here no
target x candidate pair is ever formed:

* every tier is an equality key (concern / sex / both / none) plus an
  optional age band |age - t.age| <= 3;
* members of a tier group are ranked by (age, bucket, hash): a slot table of
  counts per (group, age) - small, size-checked before it is broadcast - turns
  each target's band into one contiguous rank interval, so the match count is
  a lookup, not a join of pairs;
* up to five distinct ranks are drawn per target with Floyd's sampling
  (``aggregate`` over a 5-element sequence, JVM-side) and resolved with an
  equi-join on (tier, group, rank).

Ranking inside a slot is salted: a slot of n members is split into
ceil(n / bucket_size) hash buckets, so even a slot holding a third of all
profiles is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import py_strip, template_fill

# The standard presenting concerns.
STANDARD_CONCERNS = ["Financial loss", "Loneliness", "Exam or study related", "Depression", "Anxiety", "Suicidality",
                     "Relationship", "Panic attack", "Family relationship", "Non-suicidal self-injury",
                     "Workplace related"]
UNKNOWN_SEX = ["unspecified", "unknown"]
# Trait fields read from the client-traits JSON.
TRAIT_FIELDS = ["name", "age", "sex_or_gender", "socioeconomic_status", "residence", "job", "key_details",
                "language_patterns", "emotional_expression_vulnerability", "depth_pacing_of_disclosure",
                "engagement_response_to_support", "focus_structure_of_discussion"]

# tier -> (equality keys, age band)
TIERS = {"C": (["concern"], False), "CA": (["concern"], True), "CS": (["concern", "sex"], False),
         "ASC": (["concern", "sex"], True), "S": (["sex"], False), "A": ([], True), "AS": (["sex"], True)}
MIN_MATCHES, SAMPLE_K, AGE_BAND = 5, 5, 3.0


def hash64(*parts) -> Column:
    """Non-negative 60-bit hash from md5 (same value in Spark SQL and DuckDB)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("bigint")


def traits_expand(raw) -> list[Column]:
    """Trait fields ``trait_<name>`` from the JSON inside free text ('' when missing)."""
    from parley.functions.jsonx import json_from_text
    v = json_from_text(raw)
    return [F.coalesce(F.try_variant_get(v, f"$.{f}", "string"), F.lit("")).alias(f"trait_{f}") for f in TRAIT_FIELDS]


def target_tier(age, sex, concern) -> Column:
    unknown_sex = sex.isNull() | sex.isin(*UNKNOWN_SEX)
    std = concern.isin(*STANDARD_CONCERNS) & concern.isNotNull()
    return (F.when(~std & age.isNull(), F.lit("S"))
            .when(~std & unknown_sex, F.lit("A"))
            .when(~std, F.lit("AS"))
            .when(age.isNull() & unknown_sex, F.lit("C"))
            .when(unknown_sex, F.lit("CA"))
            .when(age.isNull(), F.lit("CS"))
            .otherwise(F.lit("ASC")))


def _group_key(keys: list[str]) -> Column:
    return F.concat_ws("\u0001", *[F.col(k) for k in keys]) if keys else F.lit("")


def _members(profiles: DataFrame, tiers: list[str], seed: int, bucket_size: int):
    """Ranked members per tier: (tier, gkey, slot_age, uid, rank) and the slot table (tier, gkey, slot_age, n, before).

    The slot and bucket tables hold one row per (group, age) / bucket, so AQE
    broadcasts them from their measured size; beyond the broadcast threshold
    the same joins run as shuffles."""
    entries = []
    for t in tiers:
        keys, band = TIERS[t]
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).isNotNull()
        if band:
            cond = cond & F.col("age").isNotNull()
        entries.append(F.struct(F.lit(t).alias("tier"), F.when(cond, _group_key(keys)).alias("gkey"),
                                (F.col("age") if band else F.lit(0.0)).alias("slot_age")))
    # one pass over the profiles: each profile is a member of every tier whose keys it has
    mem = (profiles.select("uid", hash64(F.col("uid"), F.lit(seed)).alias("h"), F.inline(F.array(*entries)))
           .filter(F.col("gkey").isNotNull()))
    slots = mem.groupBy("tier", "gkey", "slot_age").agg(F.count(F.lit(1)).alias("n"))
    ws = Window.partitionBy("tier", "gkey").orderBy("slot_age").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("n").over(ws), F.lit(0)))
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(bucket_size))).cast("bigint")
    mem = (mem.join(slots.select("tier", "gkey", "slot_age", "before", n_buckets.alias("nb")), ["tier", "gkey", "slot_age"])
           .withColumn("bucket", F.pmod(F.col("h"), F.col("nb"))))
    bcounts = mem.groupBy("tier", "gkey", "slot_age", "bucket").agg(F.count(F.lit(1)).alias("bn"))
    wb = Window.partitionBy("tier", "gkey", "slot_age").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bcounts = bcounts.withColumn("b_before", F.coalesce(F.sum("bn").over(wb), F.lit(0)))
    mem = mem.join(bcounts.select("tier", "gkey", "slot_age", "bucket", "b_before"), ["tier", "gkey", "slot_age", "bucket"])
    win = Window.partitionBy("tier", "gkey", "slot_age", "bucket").orderBy("h", "uid")
    mem = mem.withColumn("rank", F.col("before") + F.col("b_before") + F.row_number().over(win) - 1)
    return mem.select("tier", "gkey", "slot_age", "uid", "rank"), slots


def _tier_gkey(tier_col):
    out = None
    for name, (keys, _band) in TIERS.items():
        ok = F.lit(True)
        for k in keys:
            ok = ok & F.col(k).isNotNull()
        val = F.when(ok, _group_key(keys))
        out = F.when(tier_col == name, val) if out is None else out.when(tier_col == name, val)
    return out


def _intervals(probe: DataFrame, slots: DataFrame) -> DataFrame:
    """(uid, which, tier, gkey, lo, cnt): the rank where a target's matches start and their number.

    Without an age band that is the whole group. With one, members below either end of the band are counted by a running
    sum over slots and distinct band ends, within cells of one year, plus the sums of the cells before; no target meets
    the slots of its band one by one.
    """
    totals = slots.groupBy("tier", "gkey").agg(F.sum("n").alias("cnt"))
    flat = probe.filter(~F.col("band")).join(totals, ["tier", "gkey"]).select("uid", "which", "tier", "gkey", F.lit(0).cast("bigint").alias("lo"), "cnt")
    ends = probe.filter("band").select("uid", "which", "tier", "gkey", (F.col("age") - AGE_BAND).alias("low"), (F.col("age") + AGE_BAND).alias("high"))
    points = (ends.select("tier", "gkey", F.col("low").alias("x"), F.lit(0).alias("side"))
              .unionByName(ends.select("tier", "gkey", F.col("high").alias("x"), F.lit(2).alias("side"))).distinct().withColumn("n", F.lit(0).cast("bigint")))
    events = slots.select("tier", "gkey", F.col("slot_age").alias("x"), F.lit(1).alias("side"), "n").unionByName(points).withColumn("cell", F.floor("x"))
    earlier = Window.partitionBy("tier", "gkey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (events.groupBy("tier", "gkey", "cell").agg(F.sum("n").alias("cell_n"))
             .select("tier", "gkey", "cell", F.coalesce(F.sum("cell_n").over(earlier), F.lit(0)).alias("cell_before")))
    inside = Window.partitionBy("tier", "gkey", "cell").orderBy("x", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = (events.withColumn("run", F.sum("n").over(inside)).filter("side <> 1").join(cells, ["tier", "gkey", "cell"])
             .select("tier", "gkey", "x", "side", (F.col("run") + F.col("cell_before")).alias("below")))
    at = lambda side, x, out: below.filter(F.col("side") == side).select("tier", "gkey", F.col("x").alias(x), F.col("below").alias(out))
    banded = ends.join(at(0, "low", "lo"), ["tier", "gkey", "low"]).join(at(2, "high", "up"), ["tier", "gkey", "high"])
    return flat.unionByName(banded.select("uid", "which", "tier", "gkey", "lo", (F.col("up") - F.col("lo")).alias("cnt")))


def match_profiles(profiles: DataFrame, seed: int = 16, k: int = SAMPLE_K, min_matches: int = MIN_MATCHES,
                   bucket_size: int = 50_000, checkpoint: bool = True, input_materialized: bool = False) -> DataFrame:
    """profiles (uid, age double, sex, concern) -> per target: tier used, match count, up to ``k`` sampled matches.

    Tier by the target's own fields (see SURVEY table); fewer than
    ``min_matches`` -> concern-only tier (every tier contains A & S & C, so the
    reference's middle relaxation never changes the result). Output rows
    (uid, tier, n_matches, match_idx, match_uid); targets without matches keep
    one row with NULL match columns.
    """
    p = profiles.select(F.col("uid").cast("string").alias("uid"), F.col("age").cast("double").alias("age"),
                        F.col("sex").cast("string").alias("sex"), F.col("concern").cast("string").alias("concern"))
    if checkpoint and not input_materialized:
        from parley.session import cut_lineage
        p = cut_lineage(p)  # the profiles feed every branch below; read them once
    mem, slots = _members(p, list(TIERS), seed, bucket_size)
    if checkpoint:
        from parley.session import cut_lineage
        mem = cut_lineage(mem)  # ranked members feed the self-rank and the match lookups
    band_tiers = [n for n, (_k, b) in TIERS.items() if b]
    t = p.withColumn("tier0", target_tier(F.col("age"), F.col("sex"), F.col("concern")))
    t = t.withColumn("gk0", _tier_gkey(F.col("tier0"))).withColumn("band0", F.col("tier0").isin(*band_tiers))
    t = t.withColumn("gkC", F.col("concern"))
    # the target's own tier and the concern fallback
    probe = t.select("uid", "age", F.inline(F.array(
        F.struct(F.lit("a").alias("which"), F.col("tier0").alias("tier"), F.col("gk0").alias("gkey"), F.col("band0").alias("band")),
        F.struct(F.lit("c").alias("which"), F.lit("C").alias("tier"), F.col("gkC").alias("gkey"), F.lit(False).alias("band")))))
    probe = probe.filter(F.col("gkey").isNotNull())
    iv = _intervals(probe, slots)
    own = mem.select("uid", "tier", F.col("rank").alias("self_rank"))
    iv = iv.join(own, ["uid", "tier"], "left")
    n_of = F.col("cnt") - F.when(F.col("self_rank").isNotNull(), 1).otherwise(0)
    iv = iv.withColumn("n", n_of)
    ivw = iv.groupBy("uid").agg(
        *[F.max(F.when(F.col("which") == w, F.struct("n", "lo", "self_rank", "tier", "gkey"))).alias(w) for w in ("a", "c")])
    x = t.select("uid", "tier0").join(ivw, "uid", "left")
    n_first = F.coalesce(F.col("a.n"), F.lit(0))
    use_first = n_first >= min_matches
    pick = lambda f: F.when(use_first, F.col(f"a.{f}")).otherwise(F.col(f"c.{f}"))
    x = x.select("uid",
                 F.when(use_first, F.col("tier0")).otherwise(F.lit("C")).alias("tier"),
                 F.when(use_first, n_first).otherwise(F.coalesce(F.col("c.n"), F.lit(0))).cast("bigint").alias("n_matches"),
                 pick("lo").alias("lo"), pick("self_rank").alias("self_rank"), pick("gkey").alias("gkey"))
    m = F.col("n_matches")
    kk = F.least(F.lit(k).cast("bigint"), m)
    draw = lambda j: F.pmod(hash64(F.col("uid"), j, F.lit(seed)), j + 1)
    floyd = F.aggregate(F.when(kk > 0, F.sequence(m - kk, m - 1)).otherwise(F.array().cast("array<bigint>")),
                        F.array().cast("array<bigint>"),
                        lambda acc, j: F.array_append(acc, F.when(F.array_contains(acc, draw(j)), j).otherwise(draw(j))))
    picks = x.select("uid", "tier", "n_matches", "lo", "self_rank", "gkey",
                     F.posexplode_outer(floyd).alias("match_idx", "s"))
    rank = F.col("lo") + F.col("s")
    rank = F.when(F.col("self_rank").isNotNull() & (rank >= F.col("self_rank")), rank + 1).otherwise(rank)
    picks = picks.withColumn("rank", rank)
    look = mem.select("tier", "gkey", "rank", F.col("uid").alias("match_uid"))
    out = picks.join(look, ["tier", "gkey", "rank"], "left")
    return out.select("uid", "tier", "n_matches", F.col("match_idx").cast("bigint").alias("match_idx"), "match_uid")


def sample_examples(matches: DataFrame, client_msgs: DataFrame, seed: int = 16, per_convo: int = 9,
                    total: int = 45, n_slices: int = 5) -> DataFrame:
    """Matched profiles -> example client messages per target.

    Match i contributes its client messages [int(i/5*T), int((i+1)/5*T)) (the
    whole list when that slice is empty), at most ``per_convo`` of them, at
    most ``total`` overall; over-full sets are cut by a seeded hash order.
    client_msgs: (uid, msg_idx, message).
    """
    m = matches.filter(F.col("match_uid").isNotNull()).select("uid", "match_idx", "match_uid")
    cm = client_msgs.select(F.col("uid").alias("match_uid"), "msg_idx", "message")
    cnt = cm.groupBy("match_uid").agg(F.count(F.lit(1)).alias("T"))
    j = m.join(cnt, "match_uid").join(cm, "match_uid")
    start = F.floor(F.col("match_idx") * F.col("T") / F.lit(float(n_slices)))
    end = F.floor((F.col("match_idx") + 1) * F.col("T") / F.lit(float(n_slices)))
    in_slice = F.when(end > start, (F.col("msg_idx") >= start) & (F.col("msg_idx") < end)).otherwise(F.lit(True))
    j = j.filter(in_slice)
    w1 = Window.partitionBy("uid", "match_idx").orderBy(hash64(F.col("uid"), F.col("match_uid"), F.col("msg_idx"), F.lit(seed)))
    j = j.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= per_convo)
    w2 = Window.partitionBy("uid").orderBy(hash64(F.col("uid"), F.lit("all"), F.col("match_uid"), F.col("msg_idx"), F.lit(seed)))
    j = j.withColumn("_r2", F.row_number().over(w2)).filter(F.col("_r2") <= total)
    return j.select("uid", "match_idx", "match_uid", F.col("msg_idx").cast("bigint").alias("msg_idx"), "message")


def concern_key(category, concern) -> Column:
    """coalesce(category, concern) with spaces -> '_' and lower case."""
    return F.lower(F.replace(F.coalesce(category, concern), F.lit(" "), F.lit("_")))


def profile_prompt(template: str, slots: dict[str, Column]) -> Column:
    """Fill ``{slot}`` names of ``template`` in one pass, strip the ends; then three or more newlines become two."""
    return F.regexp_replace(py_strip(template_fill(F.lit(template), slots)), "\n{3,}", "\n\n")
