"""Cost jobs: token/cost estimate with tiers, request limits, token-capped batch packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import cost as cs
from parley.plans import inputs
from parley.plans.registry import job


def _sql_list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_PRICE_VALUES = ", ".join(f"('{m}', {a}, {b}, {c}, {e})" for m, (a, b, c, e) in cs.MODEL_PRICING.items())
_OUT_VALUES = ", ".join(f"('{k}', {v})" for k, v in cs.ESTIMATED_OUTPUT_TOKENS.items())
_EVAL_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in inputs.COST_EVALS.items())
_TOK = "CAST(coalesce(ceil(length({x}) / 4.0), 0) AS BIGINT)"
_DI, _DO, _DBI, _DBO = cs.DEFAULT_PRICING


@job("cost_estimate", f"""
WITH r AS (
  SELECT doc_id, {_sql_list(inputs.COST_MODELS)}[TRY_CAST(substr(source, 4) AS INTEGER) % {len(inputs.COST_MODELS)} + 1] AS model,
         CASE lang {_EVAL_CASE} ELSE 'unlisted_eval' END AS eval_name, text FROM documents),
t AS (
  SELECT r.model,
         CAST(3 + (4 + {_TOK.format(x="'system'")} + {_TOK.format(x=repr(inputs.SYSTEM_PROMPT))})
                + (4 + {_TOK.format(x="'user'")} + {_TOK.format(x="text")}) AS BIGINT) AS in_tok,
         CAST(coalesce(o.n, {cs.DEFAULT_OUTPUT_TOKENS}) AS BIGINT) AS out_tok,
         coalesce(p.i, {_DI}) AS pi, coalesce(p.o, {_DO}) AS po, coalesce(p.bi, {_DBI}) AS pbi, coalesce(p.bo, {_DBO}) AS pbo
  FROM r LEFT JOIN (VALUES {_PRICE_VALUES}) p(m, i, o, bi, bo) ON p.m = r.model
         LEFT JOIN (VALUES {_OUT_VALUES}) o(e, n) ON o.e = r.eval_name),
x AS (SELECT model, 'standard' AS tier, in_tok, out_tok, in_tok / 1e6 * pi AS in_cost, out_tok / 1e6 * po AS out_cost,
             in_tok / 1e6 * pbi + out_tok / 1e6 * pbo AS other FROM t
      UNION ALL
      SELECT model, 'batch', in_tok, out_tok, in_tok / 1e6 * pbi, out_tok / 1e6 * pbo, in_tok / 1e6 * pi + out_tok / 1e6 * po FROM t)
SELECT coalesce(model, 'ALL') AS model, tier, count(*) AS n_requests, CAST(sum(in_tok) AS BIGINT) AS total_input_tokens,
       CAST(sum(out_tok) AS BIGINT) AS total_output_tokens, round(sum(in_cost), 8) AS input_cost,
       round(sum(out_cost), 8) AS output_cost, round(sum(in_cost) + sum(out_cost), 8) AS total_cost,
       round(sum(other) - (sum(in_cost) + sum(out_cost)), 8) AS savings,
       round((sum(other) - (sum(in_cost) + sum(out_cost))) / nullif(sum(other), 0) * 100, 6) AS savings_percent
FROM x GROUP BY GROUPING SETS ((model, tier), (tier))""")
def cost_estimate(spark, d):
    """Judge requests -> message tokens (+4 per message, +3 primer) and output estimates -> $ per model and tier."""
    return cs.cost_estimate(inputs.cost_requests(spark, d))


USER_MODEL, TPM, MAX_TOKENS, THRESHOLD = "gpt-4.1", 80_000, 16, 100.0
_LIM_VALUES = ", ".join(f"('{m}', {i}, {o})" for m, (i, o) in cs.LIMIT_PRICING.items())
_UI, _UO = cs.LIMIT_PRICING[USER_MODEL]


@job("limits_estimate", f"""
WITH l AS (SELECT {_TOK.format(x="text")} AS n FROM documents),
g AS (SELECT count(*) AS n_prompts, CAST(sum(n) AS BIGINT) AS total_tokens, avg(n) AS mean_n, max(n) AS mx, min(n) AS mn FROM l),
h AS (SELECT n_prompts, total_tokens, n_prompts * {MAX_TOKENS} AS worst_case_output_tokens,
             total_tokens / {TPM} AS idealized_minutes,
             {MAX_TOKENS} + mean_n + (2 * (mx - mn)) / 4 AS est FROM g)
SELECT p.m AS pricing_model, n_prompts, total_tokens, worst_case_output_tokens, round(idealized_minutes, 6) AS idealized_minutes,
       round(est, 6) AS est_completion_tokens, round({TPM} / est, 6) AS est_request_rate,
       round(total_tokens / 1000 * p.i, 6) AS input_cost, round(worst_case_output_tokens / 1000 * p.o, 6) AS output_cost,
       round(total_tokens / 1000 * p.i + worst_case_output_tokens / 1000 * p.o, 6) AS total_cost,
       floor(total_tokens / 1000 * {_UI} + worst_case_output_tokens / 1000 * {_UO}) > {THRESHOLD} AS exceeds_threshold
FROM h, (VALUES {_LIM_VALUES}) p(m, i, o)""")
def limits_estimate(spark, d):
    """Prompt set -> request-rate estimate and worst-case cost for every priced model; cost guard flag."""
    docs = inputs.table(spark, d, "documents").select("text")
    return cs.limits_estimate(docs, "text", USER_MODEL, TPM, MAX_TOKENS, THRESHOLD)


PACK_MAX_TOKENS = 40_000


@job("pack_batches", f"""
WITH t AS (SELECT doc_id, {_TOK.format(x="text")} AS tokens FROM documents),
s AS (SELECT *, CAST(1 AS BIGINT) << greatest(0, length(bin(tokens)) - 4) AS step FROM t),
c AS (SELECT doc_id, tokens, CAST(ceil(tokens / step) * step AS BIGINT) AS size_class FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY size_class ORDER BY tokens, doc_id) - 1 AS i,
             greatest(1, {PACK_MAX_TOKENS} // greatest(1, size_class)) AS fits FROM c)
SELECT doc_id, tokens, size_class, i // fits AS batch_in_class, i % fits AS pos_in_batch,
       CAST(size_class AS VARCHAR) || '-' || CAST(i // fits AS VARCHAR) AS batch_id FROM n""")
def pack_batches(spark, d):
    """Prompts -> estimated tokens -> batches of similar length and at most 40k tokens, shortest first."""
    docs = inputs.table(spark, d, "documents").select("doc_id", cs.estimate_tokens(F.col("text")).alias("tokens"))
    return cs.pack_batches(docs, "doc_id", "tokens", PACK_MAX_TOKENS)


@job("greedy_batches", f"""
WITH RECURSIVE t AS (SELECT doc_id, {_TOK.format(x="text")} AS tokens FROM documents),
s AS (SELECT doc_id, tokens, row_number() OVER (ORDER BY tokens, doc_id) AS i FROM t),
g AS (
  SELECT i, doc_id, tokens, tokens AS used, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS pos FROM s WHERE i = 1
  UNION ALL
  SELECT s.i, s.doc_id, s.tokens, CASE WHEN g.used + s.tokens > {PACK_MAX_TOKENS} THEN s.tokens ELSE g.used + s.tokens END,
         CASE WHEN g.used + s.tokens > {PACK_MAX_TOKENS} THEN g.batch + 1 ELSE g.batch END,
         CASE WHEN g.used + s.tokens > {PACK_MAX_TOKENS} THEN 0 ELSE g.pos + 1 END
  FROM g JOIN s ON s.i = g.i + 1)
SELECT doc_id, tokens, batch, pos AS pos_in_batch FROM g""")
def greedy_batches(spark, d):
    """Prompts -> estimated tokens -> the batches of one pass over them, shortest first, of at most 40k tokens."""
    docs = inputs.table(spark, d, "documents").select("doc_id", cs.estimate_tokens(F.col("text")).alias("tokens"))
    return cs.greedy_batches(docs, "doc_id", "tokens", PACK_MAX_TOKENS)
