"""User-function jobs: completion over request rows, judge consistency."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from parley.operators import prompts as pr
from parley.operators import udfs
from parley.plans import inputs
from parley.plans.join_jobs import FIXTURE_TEMPLATES, MAX_TOKENS, SQL_BUILD_REQUESTS
from parley.plans.registry import job

_REQ = SQL_BUILD_REQUESTS.strip()
assert _REQ.startswith("WITH ")
_REQ_CTES, _REQ_SELECT = _REQ[len("WITH "):].split("\nSELECT ", 1)


@job("complete_batch", f"""
WITH {_REQ_CTES},
req AS (SELECT {_REQ_SELECT})
SELECT uid, prompt_template_name, model,
       CASE WHEN length(prompt) % 11 = 0 THEN NULL
            ELSE 'reply ' || CAST(length(prompt) % 97 AS VARCHAR) || ' // ' || right(prompt, 12) END AS content,
       CASE WHEN length(prompt) % 11 = 0 THEN 5 ELSE 1 END AS attempts,
       CASE WHEN length(prompt) % 11 = 0 THEN 'ValueError: stub overloaded' END AS error
FROM req""")
def complete_batch(spark, d):
    """Request rows -> injected completion function over Arrow batches (5 attempts, errors recorded per row)."""
    reqs = pr.build_requests(inputs.benchmark_rows(spark, d), FIXTURE_TEMPLATES, "text", file_col="file_name",
                             index_col="row_index", max_tokens=MAX_TOKENS)
    out = udfs.complete_batch(reqs.select("uid", "prompt_template_name", "model", "prompt"), inputs.stub_complete,
                              max_attempts=5)
    return out.select("uid", "prompt_template_name", "model", "content", "attempts", "error")


@job("complete_resume", f"""
WITH {_REQ_CTES},
req AS (SELECT {_REQ_SELECT}),
open AS (SELECT * FROM req WHERE NOT (length(prompt) % 3 = 0))
SELECT uid, prompt_template_name, model,
       CASE WHEN length(prompt) % 11 = 0 THEN NULL
            ELSE 'reply ' || CAST(length(prompt) % 97 AS VARCHAR) || ' // ' || right(prompt, 12) END AS content,
       CASE WHEN length(prompt) % 11 = 0 THEN 5 ELSE 1 END AS attempts
FROM open""")
def complete_resume(spark, d):
    """Request rows of which an earlier run answered some: only the open (uid, template) pairs are completed."""
    reqs = pr.build_requests(inputs.benchmark_rows(spark, d), FIXTURE_TEMPLATES, "text", file_col="file_name",
                             index_col="row_index", max_tokens=MAX_TOKENS).select("uid", "prompt_template_name", "model", "prompt")
    earlier = reqs.where(F.length("prompt") % 3 == 0)
    out = udfs.complete_batch(reqs, inputs.stub_complete, max_attempts=5, done=earlier)
    return out.select("uid", "prompt_template_name", "model", "content", "attempts")


N_SAMPLES = 3
_CFG = ", ".join(f"('{c}')" for c in inputs.STABILITY_CONFIGS)
_RESP = ("CASE WHEN length(req) % 11 = 0 THEN '[ERROR] ValueError: stub overloaded' "
         "ELSE replace(trim('reply ' || CAST(length(req) % 97 AS VARCHAR) || ' // ' || right(req, 12)), '//', '') END")
_JUDGE = ("CASE WHEN length(judge_input) % 13 = 0 THEN 'I cannot judge this.' ELSE '```json' || chr(10) "
          "|| '[{\"question\": \"consistency\", \"score\": ' || CAST(length(judge_input) % 5 + 1 AS VARCHAR) "
          "|| '}, {\"question\": \"tone\", \"score\": ' || CAST(length(judge_input) % 3 + 1 AS VARCHAR) || '}]' "
          "|| chr(10) || '```' END")
STABILITY_SQL = f"""
WITH r AS (SELECT c.config, b.item_id, '[' || c.config || '] ' || b.text AS prompt FROM benchmark b, (VALUES {_CFG}) c(config)),
s AS (SELECT *, '#' || CAST(sample AS VARCHAR) || ' ' || prompt AS req FROM (SELECT *, unnest(range(1, {N_SAMPLES + 1})) AS sample FROM r)),
rs AS (SELECT *, {_RESP} AS response FROM s),
g AS (SELECT config, item_id, prompt, count(*) AS n_responses, CAST(count_if(contains(lower(response), '[error]')) AS BIGINT) AS n_errors,
             string_agg(CASE WHEN NOT contains(lower(response), '[error]') THEN response END, ' || ' ORDER BY sample) AS kept
      FROM rs GROUP BY config, item_id, prompt),
j AS (SELECT *, 'PROMPTED WITH: ' || prompt || chr(10) || 'RESPONSES: ' || coalesce(kept, '') AS judge_input FROM g),
jo AS (SELECT *, {_JUDGE} AS content FROM j),
p AS (SELECT *, CASE WHEN json_valid(regexp_extract(content, '(?s)```json\\s*(\\[[\\s\\S]*?\\])\\s*```', 1))
                     THEN regexp_extract(content, '(?s)```json\\s*(\\[[\\s\\S]*?\\])\\s*```', 1)::JSON END AS lst FROM jo)"""


@job("judge_consistency", STABILITY_SQL + """,
it AS (SELECT config, item_id, unnest(CAST(lst AS JSON[])) AS o FROM p WHERE lst IS NOT NULL)
SELECT config, json_extract_string(o, '$.question') AS question, count(*) AS n_prompts,
       round(avg(TRY_CAST(json_extract_string(o, '$.score') AS DOUBLE)), 6) AS mean_score
FROM it GROUP BY config, json_extract_string(o, '$.question')""")
def judge_consistency(spark, d):
    """Prompts x configs -> 3 sampled replies each -> errors set apart -> judge -> fenced JSON list -> mean score
    per config and question."""
    judged = udfs.judge_consistency(inputs.stability_requests(spark, d), inputs.stub_complete, inputs.stub_judge,
                                    N_SAMPLES, ["config", "item_id"])
    return (udfs.consistency_scores(judged, ["config", "item_id"]).groupBy("config", "question")
            .agg(F.count(F.lit(1)).alias("n_prompts"), F.round(F.avg("score"), 6).alias("mean_score")))


@job("judge_consistency_status", STABILITY_SQL + """
SELECT config, item_id, prompt, n_responses, n_errors,
       CASE WHEN lst IS NOT NULL AND json_type(lst) = 'ARRAY' THEN 'ok' ELSE 'parse_error' END AS judge_status FROM p""")
def judge_consistency_status(spark, d):
    """Per prompt and config: replies, failed replies and whether the judge's list parsed."""
    return udfs.judge_consistency(inputs.stability_requests(spark, d), inputs.stub_complete, inputs.stub_judge,
                                  N_SAMPLES, ["config", "item_id"]).drop("items")


@job("embed_requests", """
SELECT doc_id, round(CAST(CAST(length(t) / 1000.0 AS FLOAT) AS DOUBLE), 6) AS e0,
       round(CAST(CAST((length(t) - length(regexp_replace(t, '[aeiouAEIOU]', '', 'g'))) / greatest(length(t), 1) AS FLOAT) AS DOUBLE), 6) AS e1,
       round(CAST(CAST((length(t) - length(replace(t, ' ', ''))) / greatest(length(t), 1) AS FLOAT) AS DOUBLE), 6) AS e2,
       round(CAST(CAST((length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) / greatest(length(t), 1) AS FLOAT) AS DOUBLE), 6) AS e3
FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\s]') THEN text ELSE ' ' END AS t FROM documents)""")
def embed_requests(spark, d):
    """Documents embedded (stub model) through requests of at most 2048 texts and 250,000 tokens."""
    docs = inputs.table(spark, d, "documents").select("doc_id", "text")
    embed = udfs.request_embedder(lambda texts: udfs.feature_embedding(pd.Series(texts)))
    out = docs.select("doc_id", embed(F.col("text")).alias("e"))
    return out.select("doc_id", *[F.round(F.col("e")[i].cast("double"), 6).alias(f"e{i}") for i in range(4)])
