"""Score jobs: judge statistics, distributions, families, rubric, realism, demographics."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.jsonx import variant_entries
from parley.functions.stats import t975_sql
from parley.functions.text import rnd
from parley.operators import scores as sc
from parley.plans import inputs
from parley.plans.registry import job
from parley.plans.sqlparts import with_

_CATS = ", ".join(f"('{c}', '{c.replace('_', ' ').title()}')" for c in sc.SCORE_CATEGORIES)

JUDGE_LONG_SQL = f"""
pj AS (
  SELECT uid, string_split(input_file_name, '|')[-1] AS model,
         regexp_replace(regexp_replace(comparison_json, '^```json\\n', ''), '\\n```$', '') AS u FROM replies),
oj AS (SELECT uid, model, CASE WHEN json_valid(u) THEN u::JSON END AS o FROM pj),
vj AS (
  SELECT uid, model,
         CASE WHEN json_extract_string(o, '$.choices[0].message.content') IS NOT NULL
              THEN CASE WHEN json_valid(json_extract_string(o, '$.choices[0].message.content'))
                        THEN json_extract_string(o, '$.choices[0].message.content')::JSON END
              ELSE o END AS doc
  FROM oj),
long AS (
  SELECT uid, model, c.category, c.title,
         TRY_CAST(json_extract_string(doc, '$.' || c.category || '.score') AS DOUBLE) AS score
  FROM vj, (VALUES {_CATS}) c(category, title))"""


def _judge_long(spark, d):
    return sc.judge_scores_long(inputs.comparison_replies(spark, d))


@job("score_stats", with_(inputs.COMPARISON_REPLIES_SQL, JUDGE_LONG_SQL) + """
SELECT model, title AS category, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score,
       round(stddev_pop(score), 6) AS std_score, min(score) AS min_score, max(score) AS max_score,
       count(score) AS n_scores
FROM long WHERE score IS NOT NULL AND model IS NOT NULL GROUP BY model, title""")
def score_stats(spark, d):
    """Judge replies -> per-category scores -> mean/median/std/min/max/count by model."""
    return sc.score_stats(_judge_long(spark, d))


_DIST_SQL_COLS = ", ".join(f"CAST(count_if(score = {k}) AS BIGINT) AS n_{k}" for k in range(1, 6))
_PCT_SQL_COLS = ", ".join(f"round(n_{k} * 100.0 / n_scores, 6) AS pct_{k}" for k in range(1, 6))


@job("score_distribution", with_(inputs.COMPARISON_REPLIES_SQL, JUDGE_LONG_SQL) + f"""
SELECT *, {_PCT_SQL_COLS} FROM (
  SELECT model, title AS category, count(score) AS n_scores, {_DIST_SQL_COLS}
  FROM long WHERE score IS NOT NULL AND model IS NOT NULL GROUP BY model, title)""")
def score_distribution(spark, d):
    """Counts of each score level 1-5 and their share, by model and category."""
    return sc.score_distribution(_judge_long(spark, d))


_FAM = ", ".join(f"'{f}'" for f in sc.FAMILIES)


@job("family_scores", with_(inputs.EVAL_DOCUMENTS_SQL, f"""
ev AS (SELECT file_name, doc_json::JSON AS doc FROM evals),
top AS (SELECT file_name, doc, k AS category, json_extract(doc, '$."' || k || '"') AS content
        FROM (SELECT file_name, doc, unnest(json_keys(doc)) AS k FROM ev)),
fam AS (SELECT file_name, category, s AS subcategory,
               TRY_CAST(json_extract_string(content, '$."' || s || '".score') AS DOUBLE) AS score,
               json_extract_string(content, '$."' || s || '".rationale') AS rationale
        FROM (SELECT *, unnest(json_keys(content)) AS s FROM top WHERE category IN ({_FAM}))),
plain AS (SELECT file_name, category, category AS subcategory,
                 TRY_CAST(json_extract_string(content, '$.score') AS DOUBLE) AS score,
                 json_extract_string(content, '$.rationale') AS rationale
          FROM top WHERE category NOT IN ({_FAM}) AND json_type(content) <> 'NULL'),
avgs AS (SELECT file_name, category || '_average' AS category, '' AS subcategory, avg(score) AS score,
                'Average score across the family.' AS rationale FROM fam GROUP BY file_name, category),
fm AS (SELECT file_name, avg(CASE WHEN category = 'big_five_traits' THEN score END) AS b5,
              avg(CASE WHEN category = 'language_patterns' THEN score END) AS lp,
              avg(CASE WHEN category = 'emotional_realism' THEN score END) AS er FROM fam GROUP BY file_name),
ov AS (SELECT e.file_name, 'overall_score' AS category, '' AS subcategory,
              (coalesce(TRY_CAST(json_extract_string(e.doc, '$.big_five_traits_average.score') AS DOUBLE),
                        TRY_CAST(json_extract_string(e.doc, '$.big_five_traits_simple.score') AS DOUBLE), fm.b5)
               + fm.lp + fm.er + TRY_CAST(json_extract_string(e.doc, '$.presenting_concern.score') AS DOUBLE)) / 5.0 AS score,
              'Overall average score.' AS rationale
       FROM ev e LEFT JOIN fm USING (file_name))""") + """
SELECT file_name, category, subcategory, round(score, 6) AS score, rationale
FROM (SELECT * FROM fam UNION ALL SELECT * FROM plain UNION ALL SELECT * FROM avgs UNION ALL SELECT * FROM ov)""")
def family_scores(spark, d):
    """Eval documents -> long scores + family averages + overall score (divisor 5, reference parity)."""
    ev = inputs.eval_documents(spark, d).select("file_name", F.try_parse_json("doc_json").alias("doc"))
    return sc.family_scores(ev, divisor=5.0)


# Fixed values for the fixture run: (system, dataset, run) triples; the last one has no traces.
FIXTURE_SYSTEMS = [("English", "docs-en", "eval-run"), ("French", "docs-fr", "eval-run"),
                   ("German", "docs-de", "eval-run"), ("Spanish", "docs-es", "eval-run"),
                   ("Unused", "docs-xx", "eval-run")]

_RUBRIC_VALUES = ", ".join(f"('{k}', {v})" for k, v in sc.RUBRIC_WEIGHTS.items())
RUBRIC_FRACTIONS_SQL = f"""
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, name ORDER BY ts DESC) AS rn
                          FROM scores WHERE value IS NOT NULL) WHERE rn = 1),
has AS (SELECT DISTINCT trace_id, true AS has FROM latest),
items AS (SELECT trace_id, substr(name, {len(sc.RUBRIC_PREFIX) + 1}) AS item,
                 CASE WHEN lower(value) IN ('1', '1.0', 'true', 'yes') THEN 1
                      WHEN lower(value) IN ('0', '0.0', 'false', 'no') THEN 0 END AS v
          FROM latest WHERE starts_with(name, '{sc.RUBRIC_PREFIX}')),
grid AS (SELECT t.trace_id, w.item, w.weight FROM traces t, (VALUES {_RUBRIC_VALUES}) w(item, weight)),
g AS (SELECT grid.*, items.v, max(CASE WHEN grid.item = 'X0' THEN items.v END) OVER (PARTITION BY grid.trace_id) AS x0
      FROM grid LEFT JOIN items USING (trace_id, item)),
ex AS (SELECT *, (item IN ('X1', 'X2', 'X3', 'X4') AND coalesce(x0 = 0, false)) OR (item = 'P5' AND v IS NULL) AS excl FROM g),
pt AS (SELECT trace_id, CAST(sum(CASE WHEN NOT excl AND v = 1 THEN weight ELSE 0 END) AS BIGINT) AS earned,
              CAST(sum(CASE WHEN NOT excl THEN weight ELSE 0 END) AS BIGINT) AS possible FROM ex GROUP BY trace_id),
fr AS (SELECT pt.trace_id, earned, possible,
              CASE WHEN has AND possible > 0 THEN earned / possible END AS fraction
       FROM pt LEFT JOIN has USING (trace_id))"""


def _fractions(spark, d):
    return sc.weighted_rubric(inputs.traces(spark, d), inputs.rubric_scores(spark, d))


@job("rubric_fractions", with_(inputs.TRACES_SQL, inputs.RUBRIC_SCORES_SQL, RUBRIC_FRACTIONS_SQL) + """
SELECT trace_id, earned, possible, round(fraction, 6) AS fraction FROM fr""")
def rubric_fractions(spark, d):
    """Per trace weighted rubric fraction (latest value per item, bool-normalised, X0/P5 exclusions)."""
    return _fractions(spark, d).withColumn("fraction", rnd("fraction"))


_SYS_VALUES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in FIXTURE_SYSTEMS)


@job("weighted_rubric", with_(inputs.TRACES_SQL, inputs.RUBRIC_SCORES_SQL, RUBRIC_FRACTIONS_SQL, f"""
sys AS (SELECT * FROM (VALUES {_SYS_VALUES}) s(system, dataset, run)),
tagged AS (SELECT trace_id, unnest(tags) AS tag FROM traces WHERE name = 'generated-conversation'),
j AS (SELECT s.system, t.trace_id, f.fraction FROM sys s LEFT JOIN tagged t ON t.tag = s.dataset || '/' || s.run
      LEFT JOIN fr f ON f.trace_id = t.trace_id)""") + """
SELECT system, count(trace_id) AS n_traces, count(fraction) AS n_scored, round(avg(fraction), 6) AS mean_fraction
FROM j GROUP BY system""")
def weighted_rubric(spark, d):
    """Per system: mean weighted-rubric fraction over its run's traces (NULL = N/A)."""
    systems = spark.createDataFrame(FIXTURE_SYSTEMS, "system string, dataset string, run string")
    return sc.mean_rubric_by_system(inputs.traces(spark, d), _fractions(spark, d), systems)


_LING = ", ".join(f"'{k}'" for k in sc.LINGUISTIC_KEYS)
_EMO = ", ".join(f"'{k}'" for k in sc.EMOTIONAL_KEYS)
_TARGETS = ", ".join(f"'{k}'" for k in sc.TARGET_CATEGORIES)
_DIM = ", ".join(f"('{b}', {i}, '{m}')" for i, b in enumerate(sc.DISPLAY_ORDER)
                 for m in ("linguistic", "emotional", "trait"))


@job("realism_table", with_(inputs.TRACES_SQL, inputs.REALISM_SCORES_SQL, f"""
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, name ORDER BY ts DESC) AS rn
                          FROM scores WHERE value IS NOT NULL) WHERE rn = 1),
s AS (SELECT trace_id, CASE WHEN name IN ({_LING}) THEN 'linguistic' WHEN name IN ({_EMO}) THEN 'emotional'
                            WHEN name = '{sc.TRAIT_KEY}' THEN 'trait' END AS metric,
             TRY_CAST(value AS DOUBLE) AS x FROM latest),
pt AS (SELECT trace_id, metric, avg(x) AS x FROM s WHERE metric IS NOT NULL AND x IS NOT NULL GROUP BY trace_id, metric),
b AS (SELECT pt.*, CASE WHEN lower(coalesce(t.category, 'other')) IN ({_TARGETS})
                        THEN upper(substr(lower(t.category), 1, 1)) || substr(lower(t.category), 2) ELSE 'Other' END AS bucket
      FROM pt JOIN traces t USING (trace_id)),
st AS (SELECT bucket, metric, count(x) AS n, avg(x) AS mean, stddev_samp(x) / sqrt(count(x)) AS sem
       FROM b GROUP BY bucket, metric),
dim AS (SELECT * FROM (VALUES {_DIM}) d(bucket, display_pos, metric))""") + f"""
SELECT d.bucket, d.display_pos, d.metric, coalesce(n, 0) AS n, round(mean, 6) AS mean,
       round(CASE WHEN n >= 2 THEN mean - {t975_sql('(n - 1)')} * sem ELSE mean END, 6) AS ci_lower,
       round(CASE WHEN n >= 2 THEN mean + {t975_sql('(n - 1)')} * sem ELSE mean END, 6) AS ci_upper
FROM dim d LEFT JOIN st USING (bucket, metric)""")
def realism_table(spark, d):
    """Per concern bucket: linguistic / emotional / trait realism mean with 95 % t interval."""
    return sc.realism_table(inputs.traces(spark, d), inputs.realism_scores(spark, d))


_AGE_CASE = " ".join(f"WHEN age >= {lo} AND age < {hi} THEN '{lab}'" for lo, hi, lab in sc.AGE_BINS)


@job("demographic_summary", with_(inputs.PATIENT_SUMMARIES_SQL, f"""
pj AS (SELECT line::JSON AS j FROM patients),
e AS (SELECT json_extract(j, '$."' || k || '"') AS det FROM (SELECT j, unnest(json_keys(j)) AS k FROM pj)),
f AS (SELECT coalesce(CAST(trunc(TRY_CAST(json_extract_string(det, '$.age') AS DOUBLE)) AS INTEGER), 0) AS age,
             coalesce(json_extract_string(det, '$.gender'), 'Unknown') AS gender,
             coalesce(json_extract_string(det, '$.presenting_concern'), 'Unknown') AS concern FROM e),
cells AS (
  SELECT 'Demographic Factors - Age Group' AS characteristic, CASE {_AGE_CASE} END AS key, CASE {_AGE_CASE} END AS category FROM f
  UNION ALL SELECT 'Demographic Factors - Gender', gender, upper(substr(gender, 1, 1)) || lower(substr(gender, 2)) FROM f
  UNION ALL SELECT 'Presenting Concerns - Primary Concern', concern, concern FROM f),
counts AS (SELECT characteristic, key, category, count(*) AS n FROM cells GROUP BY characteristic, key, category)""") + """
SELECT characteristic, category, n, round(n * 100.0 / sum(n) OVER (PARTITION BY characteristic), 6) AS pct,
       printf('%d (%.1f%%)', n, round(n * 100.0 / sum(n) OVER (PARTITION BY characteristic), 6)) AS n_pct,
       CASE WHEN characteristic = 'Demographic Factors - Age Group' THEN
         CASE category """ + " ".join(f"WHEN '{lab}' THEN {a}" for a, b, lab in sc.AGE_BINS) + """ END END AS age_lo,
       CASE WHEN characteristic = 'Demographic Factors - Age Group' THEN
         CASE category """ + " ".join(f"WHEN '{lab}' THEN {b}" for a, b, lab in sc.AGE_BINS) + """ END END AS age_hi_excl
FROM counts""")
def demographic_summary(spark, d):
    """Patient summaries -> age-group / gender / concern counts with share of the total."""
    lines = inputs.patient_summaries(spark, d)
    parsed = lines.select(variant_entries(F.try_parse_json("line")).alias("patient", "det"))
    patients = parsed.select(F.try_variant_get("det", "$.age", "string").alias("age"),
                             F.try_variant_get("det", "$.gender", "string").alias("gender"),
                             F.try_variant_get("det", "$.presenting_concern", "string").alias("presenting_concern"))
    return sc.demographic_summary(patients)
