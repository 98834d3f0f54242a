"""Score operators: judge score tables -> statistics, rubric fractions, CI tables.

Every statistic is a long-table ``groupBy`` with map-side partial aggregation,
so a hot model / category / system costs one combined row per task before the
shuffle. Exact medians run over 1-5 judge scores: ``median``'s buffer is a
value -> count map, bounded by the number of distinct scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.jsonx import is_json_null, judge_document, variant_entries, vget
from parley.functions.stats import mean_ci
from parley.functions.text import bool_norm, rnd

# The nine comparison-judge categories, in report order.
SCORE_CATEGORIES = ["resolution", "micro_skills", "context", "language", "empathy_chaining",
                    "forbidden_statements", "multiple_tasks", "pacing", "questions"]

# Rubric item weights (X1-X4 drop out when X0 = 0; P5 drops out when missing).
RUBRIC_WEIGHTS = {
    "P1": 2, "P2": 1, "P3": 1, "P4": 1, "P5": 1, "P6": 1, "P7": 1, "P8": 2,
    "M1": 2, "M2": 1, "M3": 1, "M4": 1, "M5": 1,
    "S1": 1, "S2": 1, "S3": 2, "S4": 1, "S5": 1, "S6": 1, "S7": 1,
    "X0": 0, "X1": 4, "X2": 4, "X3": 2, "X4": 2,
}
RUBRIC_PREFIX = "counselor-eval-rubric."

# Realism score keys and concern buckets.
LINGUISTIC_KEYS = ["language_patterns.grammar_and_punctuation",
                   "language_patterns.message_length_and_complexity",
                   "language_patterns.authenticity_and_natural_flow"]
EMOTIONAL_KEYS = ["emotional_realism.cognitive_distortions",
                  "emotional_realism.physical_or_behavioral_symptoms_of_distress",
                  "emotional_realism.depth_of_emotion_presenting_issue",
                  "emotional_realism.authentic_progression_of_emotional_states"]
TRAIT_KEY = "presenting_concern.score"
TARGET_CATEGORIES = ["suicidality", "depression", "anxiety", "relationship"]
DISPLAY_ORDER = ["Suicidality", "Depression", "Anxiety", "Relationship", "Other"]

# Eval families averaged into extra rows.
FAMILIES = ["big_five_traits", "language_patterns", "emotional_realism"]


def model_from_file(c):
    """Last ``|`` segment of an input file name."""
    return F.element_at(F.split(c, r"\|"), -1)


def title_words(c):
    """'micro_skills' -> 'Micro Skills'."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def judge_scores_long(replies: DataFrame, reply_col: str = "comparison_json", id_col: str = "uid",
                      file_col: str | None = "input_file_name",
                      categories: list[str] | None = None) -> DataFrame:
    """Comparison replies -> long (uid, model, category, score, justification).

    Missing category -> score NULL and justification ''; unparsable reply -> all NULL.
    """
    cats = categories or SCORE_CATEGORIES
    model = model_from_file(F.col(file_col)) if file_col else F.lit(None).cast("string")
    # Parse once per reply (its own projection), then read each category from the map of entries.
    parsed = replies.select(F.col(id_col).alias("uid"), model.alias("model"),
                            F.try_variant_get(judge_document(reply_col), "$", "map<string,variant>").alias("_m"))
    cell = lambda c, k, t: F.try_variant_get(F.try_element_at("_m", F.lit(c)), f"$.{k}", t)
    entries = F.array(*[F.struct(F.lit(i).alias("cat_pos"), F.lit(c).alias("category"),
                                 cell(c, "score", "double").alias("score"),
                                 F.coalesce(cell(c, "justification", "string"), F.lit("")).alias("justification"))
                        for i, c in enumerate(cats)])
    return parsed.select("uid", "model", F.inline(entries))


def score_stats(long: DataFrame, by_model: bool = True) -> DataFrame:
    """Per (model,) category: mean, median, population std, min, max, count of non-null scores.

    Categories without any score are omitted; rows with a NULL model are dropped.
    """
    keys = ["model", "category"] if by_model else ["category"]
    df = long.filter(F.col("score").isNotNull())
    if by_model:
        df = df.filter(F.col("model").isNotNull())
    return (df.groupBy(*keys)
            .agg(rnd(F.avg("score")).alias("mean_score"),
                 rnd(F.median("score")).alias("median_score"),
                 rnd(F.stddev_pop("score")).alias("std_score"),
                 F.min("score").alias("min_score"),
                 F.max("score").alias("max_score"),
                 F.count("score").alias("n_scores"))
            .withColumn("category", title_words(F.col("category"))))


def score_distribution(long: DataFrame, levels=(1, 2, 3, 4, 5)) -> DataFrame:
    """Per model x category: how many scores equal each level and their share of the count."""
    df = long.filter(F.col("score").isNotNull() & F.col("model").isNotNull())
    aggs = [F.count("score").alias("n_scores")]
    for k in levels:
        aggs.append(F.count_if(F.col("score") == k).alias(f"n_{k}"))
    out = df.groupBy("model", "category").agg(*aggs)
    for k in levels:
        out = out.withColumn(f"pct_{k}", rnd(F.col(f"n_{k}") * 100.0 / F.col("n_scores")))
    return out.withColumn("category", title_words(F.col("category")))


def family_scores(evals: DataFrame, doc_col: str = "doc", file_col: str = "file_name",
                  divisor: float = 4.0) -> DataFrame:
    """Eval documents -> long (file_name, category, subcategory, score, rationale) + family averages
    + overall score.

    Family categories expand one row per sub-key; other categories give one row
    with subcategory = category. ``<family>_average`` rows carry the mean of the
    family's sub-scores. ``overall_score`` = (big-five + language-patterns
    average + emotional-realism average + presenting_concern) / ``divisor``
    (default 4 = the mean of the four terms; the reference divides by 5, pass
    ``divisor=5`` for parity); the big-five term is
    the document's own ``big_five_traits_average`` / ``big_five_traits_simple``
    score, falling back to the computed big-five average.
    """
    top = (evals.select(file_col, doc_col, variant_entries(doc_col).alias("category", "content"))
           .filter(~is_json_null("content")))
    is_family = F.col("category").isin(*FAMILIES)
    fam = (top.filter(is_family)
           .select(file_col, "category", variant_entries("content").alias("subcategory", "data"))
           .select(file_col, "category", "subcategory",
                   vget("data", "$.score", "double").alias("score"),
                   vget("data", "$.rationale", "string").alias("rationale")))
    plain = (top.filter(~is_family)
             .select(file_col, "category", F.col("category").alias("subcategory"),
                     vget("content", "$.score", "double").alias("score"),
                     vget("content", "$.rationale", "string").alias("rationale")))
    averages = (fam.groupBy(file_col, "category").agg(F.avg("score").alias("score"))
                .select(file_col, F.concat("category", F.lit("_average")).alias("category"),
                        F.lit("").alias("subcategory"), "score",
                        F.lit("Average score across the family.").alias("rationale")))
    fam_means = fam.groupBy(file_col).agg(
        *[F.avg(F.when(F.col("category") == f, F.col("score"))).alias(f"_{f}") for f in FAMILIES])
    per_file = (evals.select(file_col,
                             F.coalesce(vget(doc_col, "$.big_five_traits_average.score", "double"),
                                        vget(doc_col, "$.big_five_traits_simple.score", "double")).alias("b5_doc"),
                             vget(doc_col, "$.presenting_concern.score", "double").alias("pc"))
                .join(fam_means, file_col, "left"))
    overall = per_file.select(
        file_col, F.lit("overall_score").alias("category"), F.lit("").alias("subcategory"),
        ((F.coalesce("b5_doc", "_big_five_traits") + F.col("_language_patterns")
          + F.col("_emotional_realism") + F.col("pc")) / F.lit(float(divisor))).alias("score"),
        F.lit("Overall average score.").alias("rationale"))
    out = fam.unionByName(plain).unionByName(averages).unionByName(overall)
    return out.withColumn("score", rnd("score"))


def latest_per_key(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Last write wins per key: ``max_by`` is a partial aggregate, so a key written millions of times is combined
    map-side instead of sorted whole in one task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order_col)).alias("_l")).select(*keys, "_l.*")


def weighted_rubric(traces: DataFrame, scores: DataFrame, weights: dict[str, int] | None = None,
                    prefix: str = RUBRIC_PREFIX, drop_items: tuple[str, ...] = ()) -> DataFrame:
    """Per trace: sum(weight * [item = 1]) / sum(weight of non-excluded items).

    Driven by traces x rubric items so unanswered items still count in the
    denominator. X1-X4 are excluded when X0 = 0, P5 when it is missing or not
    boolean. NULL when the trace has no scores at all or the denominator is 0.
    The rubric is a fixed list, expanded per trace with ``inline`` (no join).
    ``drop_items`` removes items the judge is never asked (e.g. ``("P7",)``);
    by default they stay in the denominator, as in the reference.
    """
    weights = {k: v for k, v in (weights or RUBRIC_WEIGHTS).items() if k not in drop_items}
    rubric = F.array(*[F.struct(F.lit(k).alias("item"), F.lit(int(v)).alias("weight")) for k, v in weights.items()])
    latest = latest_per_key(scores.filter(F.col("value").isNotNull()), ["trace_id", "name"], "ts")
    has_scores = latest.select("trace_id").distinct().withColumn("_has", F.lit(True))
    items = (latest.filter(F.col("name").startswith(prefix))
             .select("trace_id", F.expr(f"substring(name, {len(prefix) + 1})").alias("item"),
                     bool_norm("value").alias("v")))
    grid = traces.select("trace_id", F.inline(rubric))
    g = grid.join(items, ["trace_id", "item"], "left")
    x0 = F.max(F.when(F.col("item") == "X0", F.col("v"))).over(Window.partitionBy("trace_id"))
    g = g.withColumn("_x0", x0)
    excluded = ((F.col("item").isin("X1", "X2", "X3", "X4") & F.coalesce(F.col("_x0") == 0, F.lit(False)))
                | ((F.col("item") == "P5") & F.col("v").isNull()))
    per_trace = (g.groupBy("trace_id")
                 .agg(F.sum(F.when(~excluded & (F.col("v") == 1), F.col("weight")).otherwise(0)).alias("earned"),
                      F.sum(F.when(~excluded, F.col("weight")).otherwise(0)).alias("possible")))
    per_trace = per_trace.join(has_scores, "trace_id", "left")
    frac = F.when(F.col("_has") & (F.col("possible") > 0), F.col("earned") / F.col("possible"))
    return per_trace.select("trace_id", F.col("earned").cast("bigint"), F.col("possible").cast("bigint"),
                            frac.alias("fraction"))


def mean_rubric_by_system(traces: DataFrame, fractions: DataFrame, systems: DataFrame) -> DataFrame:
    """Mean of trace fractions per system (traces selected by the ``dataset/run`` tag); NULL = N/A."""
    tagged = traces.filter(F.col("name") == "generated-conversation").select("trace_id", F.explode("tags").alias("tag"))
    per_tag = (tagged.join(fractions.select("trace_id", "fraction"), "trace_id", "left").groupBy("tag")
               .agg(F.count("trace_id").alias("n"), F.count("fraction").alias("scored"), F.sum("fraction").alias("total")))
    wanted = systems.withColumn("tag", F.concat_ws("/", "dataset", "run")).join(per_tag, "tag", "left")  # one row per tag
    return (wanted.groupBy("system")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_traces"), F.coalesce(F.sum("scored"), F.lit(0)).alias("n_scored"),
                 rnd(F.sum("total") / F.nullif(F.sum("scored"), F.lit(0))).alias("mean_fraction")))


def bucket_other(c, targets=TARGET_CATEGORIES):
    """lower-cased category; one of the targets -> capitalised, else (or missing) 'Other'."""
    low = F.lower(F.coalesce(c, F.lit("other")))
    return F.when(low.isin(*targets), F.initcap(low)).otherwise(F.lit("Other"))


def realism_table(traces: DataFrame, scores: DataFrame) -> DataFrame:
    """Per concern bucket x metric: n, mean and 95 % t interval of per-trace realism scores.

    Per trace: mean of the present linguistic keys, mean of the present
    emotional keys, and the presenting-concern score (missing keys ignored; a
    trace without any score contributes nothing). n < 2 -> bounds = mean; no
    values -> NULLs. All five buckets are always reported.
    """
    s = latest_per_key(scores.filter(F.col("value").isNotNull()), ["trace_id", "name"], "ts")
    s = s.withColumn("x", F.col("value").try_cast("double"))
    metric = (F.when(F.col("name").isin(*LINGUISTIC_KEYS), F.lit("linguistic"))
              .when(F.col("name").isin(*EMOTIONAL_KEYS), F.lit("emotional"))
              .when(F.col("name") == TRAIT_KEY, F.lit("trait")))
    per_trace = (s.withColumn("metric", metric).filter(F.col("metric").isNotNull() & F.col("x").isNotNull())
                 .groupBy("trace_id", "metric").agg(F.avg("x").alias("x")))
    bucketed = per_trace.join(traces.select("trace_id", bucket_other(F.col("category")).alias("bucket")),
                              "trace_id")
    n, mean, lower, upper = mean_ci(F.col("x"))
    stats = bucketed.groupBy("bucket", "metric").agg(n.alias("n"), rnd(mean).alias("mean"),
                                                     rnd(lower).alias("ci_lower"), rnd(upper).alias("ci_upper"))
    spark = traces.sparkSession
    dim = spark.createDataFrame([(b, i, m) for i, b in enumerate(DISPLAY_ORDER)
                                 for m in ("linguistic", "emotional", "trait")],
                                "bucket string, display_pos int, metric string")
    return (F.broadcast(dim).join(stats, ["bucket", "metric"], "left")
            .select("bucket", "display_pos", "metric", F.coalesce("n", F.lit(0)).alias("n"),
                    "mean", "ci_lower", "ci_upper"))


AGE_BINS = [(18, 25, "18-25"), (25, 35, "26-35"), (35, 50, "36-50"), (50, 100, "51+")]


def demographic_summary(patients: DataFrame) -> DataFrame:
    """Patient records (age, gender, presenting_concern) -> (characteristic, category, n, pct, n_pct).

    Age defaults to 0, others to 'Unknown'; ages outside [18, 100) form a NULL
    bucket; genders are counted as written and labelled capitalised.
    """
    age = F.coalesce(F.col("age").cast("string").try_cast("double").cast("int"), F.lit(0))
    age_bucket = None
    for lo, hi, label in AGE_BINS:
        cond = (age >= lo) & (age < hi)
        age_bucket = F.when(cond, F.lit(label)) if age_bucket is None else age_bucket.when(cond, F.lit(label))
    gender = F.coalesce(F.col("gender"), F.lit("Unknown"))
    concern = F.coalesce(F.col("presenting_concern"), F.lit("Unknown"))
    cells = patients.select(F.inline(F.array(
        F.struct(F.lit("Demographic Factors - Age Group").alias("characteristic"), age_bucket.alias("key"),
                 age_bucket.alias("category")),
        F.struct(F.lit("Demographic Factors - Gender").alias("characteristic"), gender.alias("key"),
                 F.concat(F.upper(F.substring(gender, 1, 1)), F.lower(gender.substr(F.lit(2), F.length(gender)))).alias("category")),
        F.struct(F.lit("Presenting Concerns - Primary Concern").alias("characteristic"), concern.alias("key"),
                 concern.alias("category")),
    )))
    counts = cells.groupBy("characteristic", "key", "category").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("characteristic"))
    out = counts.withColumn("pct", rnd(F.col("n") * 100.0 / total))
    # labels keep the reference's wording ("18-25" is [18, 25)); the exact half-open bounds ride along
    lo = hi = None
    for a, b, label in AGE_BINS:
        lo = F.when(F.col("category") == label, F.lit(a)) if lo is None else lo.when(F.col("category") == label, F.lit(a))
        hi = F.when(F.col("category") == label, F.lit(b)) if hi is None else hi.when(F.col("category") == label, F.lit(b))
    is_age = F.col("characteristic") == "Demographic Factors - Age Group"
    return out.select("characteristic", "category", "n", "pct",
                      F.format_string("%d (%.1f%%)", F.col("n"), F.col("pct")).alias("n_pct"),
                      F.when(is_age, lo).alias("age_lo"), F.when(is_age, hi).alias("age_hi_excl"))
