"""JSON jobs: judge score flattening, parse report, completion extraction, eval unpivot."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import judge as jg
from parley.plans import inputs
from parley.plans.registry import job
from parley.plans.sqlparts import BRACE, fence_strip, json_block, num, strict_json, with_

FLATTEN_SQL = f"""
jb AS (SELECT *, {fence_strip('raw')} AS s FROM judge),
jp AS (SELECT trace_id, source_trace_id, eval_name, model, {json_block('s')} AS doc FROM jb),
obj AS (SELECT *, (json_type(doc, '$.score') IS NOT NULL AND json_type(doc, '$.score') <> 'OBJECT') AS single
        FROM jp WHERE json_type(doc) = 'OBJECT'),
ent AS (
  SELECT trace_id, source_trace_id, eval_name, model, doc, 'score' AS metric, doc AS val FROM obj WHERE single
  UNION ALL
  SELECT trace_id, source_trace_id, eval_name, model, doc, k AS metric, json_extract(doc, '$."' || k || '"') AS val
  FROM (SELECT *, unnest(json_keys(doc)) AS k FROM obj WHERE NOT single)),
vals AS (
  SELECT *, CASE WHEN json_type(val) = 'OBJECT' THEN {num('val', '$.score')} ELSE {num('val')} END AS value,
         CASE WHEN json_type(val) = 'OBJECT'
              THEN coalesce(json_extract_string(val, '$.rationale'), json_extract_string(val, '$.justification'))
              ELSE json_extract_string(doc, '$."' || substr(metric, 1, 1) || '_justification"') END AS cmt
  FROM ent),
flat AS (
  SELECT trace_id, source_trace_id, eval_name, model,
         CASE WHEN starts_with(metric, eval_name) THEN metric ELSE eval_name || '.' || metric END AS score_name,
         value, nullif(substr(coalesce(cmt, ''), 1, 1000), '') AS comment
  FROM vals WHERE value IS NOT NULL)"""


def _flat(spark, d):
    return jg.flatten_scores(inputs.judge_replies(spark, d))


@job("parse_judge_scores", with_(inputs.JUDGE_REPLIES_SQL, FLATTEN_SQL) + """
SELECT eval_name, model, score_name, round(value, 6) AS value, comment, r.target_trace_id AS target_trace_id, r.target AS target
FROM (SELECT *, unnest([{'target_trace_id': trace_id, 'target': 'run'},
                        {'target_trace_id': source_trace_id, 'target': 'source'}]) AS r FROM flat)
WHERE r.target_trace_id IS NOT NULL""")
def parse_judge_scores(spark, d):
    """Judge reply text -> fences stripped -> JSON (whole or brace span) -> long scores -> stored on run and source trace."""
    dual = jg.scores_dual(_flat(spark, d))
    return dual.withColumn("value", F.round("value", 6))


STATIC_FLATTEN_SQL = f"""
jb AS (SELECT *, {fence_strip('raw')} AS s FROM judge),
jp AS (SELECT trace_id, eval_name, {json_block('s')} AS doc FROM jb),
ent AS (SELECT trace_id, eval_name, k AS metric, json_extract(doc, '$."' || k || '"') AS val
        FROM (SELECT *, unnest(json_keys(doc)) AS k FROM jp WHERE json_type(doc) = 'OBJECT')),
vals AS (SELECT *, CASE WHEN json_type(val) = 'OBJECT' THEN {num('val', '$.score')} ELSE {num('val')} END AS value,
                CASE WHEN json_type(val) = 'OBJECT' THEN json_extract_string(val, '$.justification') END AS cmt FROM ent)"""


@job("parse_judge_scores_static", with_(inputs.JUDGE_REPLIES_SQL, STATIC_FLATTEN_SQL) + """
SELECT trace_id, eval_name, CASE WHEN contains(metric, eval_name) THEN metric ELSE eval_name || '.' || metric END AS score_name,
       round(value, 6) AS value, nullif(substr(coalesce(cmt, ''), 1, 1000), '') AS comment
FROM vals WHERE value IS NOT NULL""")
def parse_judge_scores_static(spark, d):
    """Single-turn flavour: every top-level key is a metric, name test is a substring match."""
    replies = inputs.judge_replies(spark, d).select("trace_id", "eval_name", "raw")
    return jg.flatten_scores(replies, static=True).withColumn("value", F.round("value", 6))


@job("parse_report", with_(inputs.JUDGE_REPLIES_SQL, f"""
jb AS (SELECT *, {fence_strip('raw')} AS s FROM judge)""") + f"""
SELECT eval_name, model,
       CASE WHEN {strict_json('s')} IS NOT NULL THEN 'whole'
            WHEN {strict_json(BRACE.format(s='s'))} IS NOT NULL THEN 'brace' ELSE 'failed' END AS parse_path,
       count(*) AS n_replies
FROM jb GROUP BY ALL""")
def parse_report(spark, d):
    """Per eval and model: how many replies parsed as whole text, via the brace span, or failed."""
    return jg.parse_report(inputs.judge_replies(spark, d), keys=("eval_name", "model"))


_NORM_SQL = """coalesce(
  CASE WHEN json_array_length(r, '$.candidates[0].content.parts') > 0 THEN
    array_to_string(list_transform(CAST(json_extract(r, '$.candidates[0].content.parts') AS JSON[]),
                                   lambda p: coalesce(json_extract_string(p, '$.text'), '')), '') END,
  CASE WHEN json_type(r, '$.content') = 'ARRAY' AND json_array_length(r, '$.content') > 0 THEN
    array_to_string(list_transform(list_filter(CAST(json_extract(r, '$.content') AS JSON[]),
                                               lambda p: json_extract_string(p, '$.type') = 'text'),
                                   lambda p: json_extract_string(p, '$.text')), '') END,
  json_extract_string(r, '$.completion'), json_extract_string(r, '$.choices[0].message.content'),
  json_extract_string(r, '$.choices[0].text'), '')"""


@job("extract_completions", with_(inputs.COMPLETION_LINES_SQL, f"""
p AS (SELECT regexp_replace(file_name, '\\.jsonl$', '') AS file_name, line_no, {strict_json('line')} AS v
      FROM clines WHERE length(trim(line)) > 0),
c AS (SELECT *, coalesce(json_type(v) = 'OBJECT' AND json_type(v, '$.completion') IS NOT NULL, false) AS flat,
             coalesce(json_type(v) = 'ARRAY' AND json_array_length(v) = 3, false) AS three FROM p),
s AS (SELECT *, CASE WHEN flat THEN 'ok'
                     WHEN three AND json_type(v, '$[1].choices[0].message') IS NOT NULL THEN 'ok'
                     WHEN three AND json_type(v, '$[1]') = 'ARRAY' THEN 'failed' ELSE 'unparsed' END AS status,
             CASE WHEN flat THEN v ELSE json_extract(v, '$[1]') END AS r FROM c)""") + f"""
SELECT coalesce(CASE WHEN flat THEN json_extract_string(v, '$.uid') WHEN three THEN json_extract_string(v, '$[2].metadata.uid') END,
                sha256(concat_ws(':', file_name, CAST(line_no AS VARCHAR)))) AS uid,
       coalesce(CASE WHEN flat THEN json_extract_string(v, '$.prompt_template_name')
                     WHEN three THEN json_extract_string(v, '$[2].metadata.prompt_template_name') END, '') AS prompt_template_name,
       CASE WHEN status = 'ok' THEN CASE WHEN flat THEN json_extract_string(v, '$.completion')
                                         ELSE json_extract_string(v, '$[1].choices[0].message.content') END END AS content,
       file_name,
       coalesce(CASE WHEN flat THEN json_extract_string(v, '$.input_file_name')
                     WHEN three THEN json_extract_string(v, '$[2].metadata.input_file_name') END, '') AS input_file_name,
       status,
       CASE WHEN status = 'failed' THEN array_to_string(CAST(json_extract(v, '$[1]') AS VARCHAR[]), '; ') END AS error,
       {_NORM_SQL} AS normalized_text
FROM s""")
def extract_completions(spark, d):
    """Completion JSONL (flat, array and failure shapes) -> extracted rows with status and normalised text."""
    return jg.completion_extract(inputs.completion_lines(spark, d))


def _unit_score_sql():
    return "coalesce(" + ", ".join(num("val", f"$.{k}") for k in jg.UNIT_TEST_SCORE_KEYS) + ")"


EVAL_FILES_SQL = """
pf AS (SELECT file_name, count(*) AS n, max(CASE WHEN line_no = 0 THEN text END) AS pe,
              max(CASE WHEN line_no = 1 THEN text END) AS ut, max(CASE WHEN line_no = 2 THEN text END) AS ce
       FROM efiles GROUP BY file_name),
m AS (SELECT *, string_split(file_name, '|') AS parts FROM pf),
m2 AS (SELECT *, string_split(parts[2], '_') AS prof,
              coalesce(len(parts) >= 6 AND len(string_split(parts[2], '_')) >= 4, false) AS name_ok,
              coalesce((CASE WHEN json_valid(pe) THEN json_type(pe) END) = 'OBJECT'
                       AND (CASE WHEN json_valid(ut) THEN json_type(ut) END) = 'OBJECT'
                       AND (CASE WHEN json_valid(ce) THEN json_type(ce) END) = 'OBJECT', false) AS docs_ok
       FROM m)"""


@job("eval_unpivot", with_(inputs.DIALOGUE_EVAL_FILES_SQL, EVAL_FILES_SQL, """
docs AS (SELECT file_name, prof, parts,
                unnest([{'t': 'patient_eval', 'doc': pe}, {'t': 'counselor_unit_test', 'doc': ut},
                        {'t': 'counselor_eval', 'doc': ce}]) AS r
         FROM m2 WHERE name_ok AND n = 3 AND docs_ok),
kv AS (SELECT file_name, prof, parts, r.t AS evaluation_type, k AS category,
              json_extract(r.doc, '$."' || k || '"') AS val
       FROM (SELECT *, unnest(json_keys(r.doc)) AS k FROM docs))""") + f"""
SELECT file_name, prof[1] AS dialogue_name, prof[3] || '_' || prof[4] AS patient_type, parts[3] AS counselor_prompt,
       parts[4] AS editor_prompt, parts[5] AS model_name, string_split(parts[6], '.')[1] AS timestamp,
       evaluation_type, category,
       CASE WHEN evaluation_type = 'counselor_unit_test' THEN {_unit_score_sql()} ELSE {num('val', '$.score')} END AS score,
       CASE WHEN evaluation_type = 'counselor_unit_test'
            THEN coalesce(nullif(json_extract_string(val, '$.rationale'), ''), json_extract_string(val, '$.explanation'))
            ELSE json_extract_string(val, '$.rationale') END AS rationale
FROM kv WHERE json_type(val) = 'OBJECT'""")
def eval_unpivot(spark, d):
    """Dialogue eval files -> file-name metadata x (patient eval, unit tests, counselor eval) long rows."""
    out, _ = jg.eval_unpivot(inputs.dialogue_eval_files(spark, d))
    return out


@job("eval_unpivot_errors", with_(inputs.DIALOGUE_EVAL_FILES_SQL, EVAL_FILES_SQL) + """
SELECT file_name, CASE WHEN NOT name_ok THEN 'bad file name' WHEN n <> 3 THEN 'not 3 lines' ELSE 'unparsable line' END AS error
FROM m2 WHERE NOT (name_ok AND n = 3 AND docs_ok)""")
def eval_unpivot_errors(spark, d):
    """Dialogue eval files that could not be read (malformed name, missing line, bad JSON)."""
    _, errors = jg.eval_unpivot(inputs.dialogue_eval_files(spark, d))
    return errors


@job("prediction_rows", """
WITH u AS (SELECT conv_id, turn, text AS u FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS a FROM conversations WHERE role = 'assistant'),
j AS (SELECT u.conv_id, u.turn, u.u, a.a FROM u LEFT JOIN a USING (conv_id, turn))
SELECT 'p' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS uid, 'tmpl' AS prompt_template_name,
       u AS user_message, a AS assistant_message, 'gemini-test-001' AS model_version,
       CASE WHEN a IS NULL THEN 0 ELSE 2 END AS n_safety_ratings, CAST(length(u) AS BIGINT) AS total_tokens,
       CASE WHEN u IS NOT NULL AND a IS NOT NULL THEN 'ok' ELSE 'error' END AS status
FROM j""")
def prediction_rows(spark, d):
    """Batch-prediction table -> request text, candidate text, model metadata (+ error rows)."""
    return jg.parse_prediction_rows(inputs.prediction_table(spark, d))
