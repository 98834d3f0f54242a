"""Score operators on inline rows."""

import math
import statistics

from pyspark.sql import functions as F

from parley.functions.stats import T975, t975
from parley.operators import scores as sc


def test_score_stats_population_std_and_median(spark):
    vals = [1, 2, 2, 5]
    rows = [("u%d" % i, "m", "pacing", float(v), "") for i, v in enumerate(vals)] + [("x", None, "pacing", 3.0, "")]
    df = spark.createDataFrame(rows, "uid string, model string, category string, score double, justification string")
    r = sc.score_stats(df).collect()[0]
    assert r.category == "Pacing" and r.n_scores == 4
    assert math.isclose(r.std_score, statistics.pstdev(vals), rel_tol=1e-6)
    assert r.median_score == 2.0 and r.mean_score == 2.5


def test_weighted_rubric_exclusions(spark):
    p = sc.RUBRIC_PREFIX
    rows = [(1, p + "X0", "false", 1), (1, p + "X1", "true", 1), (1, p + "P1", "yes", 1), (1, p + "P5", "NA", 1),
            (2, p + "X0", "1.0", 1), (2, p + "X1", "1", 1), (2, p + "P1", "0", 1),
            (3, p + "P1", "true", 1),  # X0 missing: X1-X4 stay in the denominator
            (4, "other", "1", 1)]
    scores = spark.createDataFrame(rows, "trace_id long, name string, value string, ts long")
    traces = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "trace_id long")
    got = {r.trace_id: (r.earned, r.possible, r.fraction) for r in sc.weighted_rubric(traces, scores).collect()}
    total = sum(sc.RUBRIC_WEIGHTS.values())
    x = sum(sc.RUBRIC_WEIGHTS[k] for k in ("X1", "X2", "X3", "X4"))
    assert got[1][:2] == (2, total - x - 1)          # X1-X4 and P5 excluded
    assert got[2][:2] == (4, total - 1)              # P5 missing -> excluded
    assert got[3][:2] == (2, total - 1)
    assert got[4][2] is not None and got[5][2] is None  # 4 has a score (not rubric) -> 0.0; 5 has none -> NULL
    assert got[4][2] == 0.0


def test_t_quantiles_and_ci(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 5, 31, 60)], "n int")
    got = [r.t for r in df.select(t975("n").alias("t")).collect()]
    assert got[0] == T975[0] and got[2] == T975[4]
    assert abs(got[3] - 2.039513) < 5e-5 and abs(got[4] - 2.000298) < 5e-5


def test_realism_table_small_groups(spark):
    traces = spark.createDataFrame([(1, "Anxiety"), (2, "anxiety"), (3, None), (4, "grief")], "trace_id long, category string")
    s = [(1, sc.TRAIT_KEY, "2", 0), (2, sc.TRAIT_KEY, "4", 0), (3, sc.TRAIT_KEY, "5", 0),
         (4, sc.LINGUISTIC_KEYS[0], "1", 0), (4, sc.LINGUISTIC_KEYS[1], "3", 0)]
    scores = spark.createDataFrame(s, "trace_id long, name string, value string, ts long")
    got = {(r.bucket, r.metric): r for r in sc.realism_table(traces, scores).collect()}
    a = got[("Anxiety", "trait")]
    half = T975[0] * statistics.stdev([2, 4]) / math.sqrt(2)
    assert a.n == 2 and math.isclose(a.ci_upper, 3 + half, rel_tol=1e-6)
    o = got[("Other", "trait")]
    assert o.n == 1 and o.ci_lower == o.mean == o.ci_upper == 5.0
    assert got[("Other", "linguistic")].mean == 2.0
    assert got[("Depression", "trait")].n == 0 and got[("Depression", "trait")].mean is None
    assert len(got) == 15


def test_demographic_bins(spark):
    rows = [("17", "male"), ("18", "Male"), ("25", None), ("34.9", "female"), ("99", "female"), ("100", "x"), (None, "y")]
    df = spark.createDataFrame(rows, "age string, gender string").withColumn("presenting_concern", F.lit("Anxiety"))
    got = {(r.characteristic, r.category): r.n for r in sc.demographic_summary(df).collect()
           if r.characteristic.endswith("Age Group")}
    assert got == {("Demographic Factors - Age Group", None): 3, ("Demographic Factors - Age Group", "18-25"): 1,
                   ("Demographic Factors - Age Group", "26-35"): 2, ("Demographic Factors - Age Group", "51+"): 1}


def test_weighted_rubric_drop_unasked(spark):
    p = sc.RUBRIC_PREFIX
    scores = spark.createDataFrame([(1, p + "P1", "1", 1)], "trace_id long, name string, value string, ts long")
    traces = spark.createDataFrame([(1,)], "trace_id long")
    total = sum(sc.RUBRIC_WEIGHTS.values())
    with_p7 = sc.weighted_rubric(traces, scores).first()
    without = sc.weighted_rubric(traces, scores, drop_items=("P7",)).first()
    assert (with_p7.possible, without.possible) == (total - 1, total - 2)
