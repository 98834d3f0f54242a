"""Latency job."""

from __future__ import annotations

from parley.operators import latency as lt
from parley.plans import inputs
from parley.plans.registry import job

D = inputs.LATENCY_DATASET
_TURN = "TRY_CAST(nullif(regexp_extract(name, '^(?:{alts})-(\\d+)$', 1), '') AS BIGINT)"


def _turn(prefixes):
    return _TURN.format(alts="|".join(p.replace("-", "\\-") for p in prefixes))


@job("latency_metrics", f"""
WITH tr AS (
  SELECT c_custkey AS trace_id, CASE WHEN c_custkey % 10 = 0 THEN 'other' ELSE 'generated-conversation' END AS name,
         ['{D}/run-' || CAST(c_nationkey % 3 AS VARCHAR), 'misc'] AS tags,
         CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 7 WHEN c_custkey % 4 = 1 THEN -1 END AS turn_count,
         CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal / 100.0 END AS latency
  FROM customer),
base AS (
  SELECT CASE WHEN event_type = 'view' AND value > 45 THEN NULL ELSE 'obs-' || CAST(event_id AS VARCHAR) END AS id,
         user_id AS trace_id,
         CASE WHEN value > 40 THEN 'event' WHEN event_type = 'signup' THEN 'span' ELSE 'generation' END AS type,
         CASE event_type WHEN 'view' THEN 'patient-turn-' WHEN 'click' THEN 'counselor-turn-'
                          WHEN 'purchase' THEN 'counselor-editor-turn-' WHEN 'signup' THEN 'rag-embedding-turn-'
                          ELSE 'patient-editor-turn-' END
           || CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 + 1 AS VARCHAR) AS name,
         CASE WHEN value >= 1 THEN value END AS latency, ts AS start_time, event_type
  FROM events),
obs AS (SELECT id, trace_id, type, name, latency, start_time FROM base
        UNION ALL
        SELECT id, trace_id, type, name, latency * 2, start_time + INTERVAL 1 SECOND FROM base WHERE event_type = 'click'),
kept AS (SELECT * FROM obs WHERE lower(coalesce(type, '')) IN ('', 'generation')
                              OR (lower(type) = 'span' AND contains(lower(coalesce(name, '')), 'embed'))),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, id ORDER BY start_time, name) AS rn
                      FROM kept WHERE id IS NOT NULL) WHERE rn = 1
       UNION ALL SELECT *, 1 FROM kept WHERE id IS NULL),
cl AS (SELECT trace_id, {_turn(lt.PATIENT_PREFIXES)} AS p,
              CASE WHEN contains(lower(name), 'embed') THEN coalesce({_turn(lt.EMBEDDING_PREFIXES)},
                   TRY_CAST(regexp_extract_all(lower(name), 'turn-(\\d+)', 1)[-1] AS BIGINT)) END AS e,
              {_turn(lt.COUNSELOR_PREFIXES)} AS c, TRY_CAST(CAST(latency AS VARCHAR) AS DOUBLE) AS lat
       FROM (SELECT trace_id, coalesce(name, '') AS name, latency FROM dd)),
c2 AS (SELECT trace_id, CASE WHEN p IS NOT NULL THEN 'patient' WHEN e IS NOT NULL OR c IS NOT NULL THEN 'counselor' END AS side,
              coalesce(p, e, c) AS turn, lat FROM cl),
pt AS (SELECT trace_id, turn, max(CASE WHEN side = 'patient' THEN 1 ELSE 0 END) AS has_p,
              max(CASE WHEN side = 'counselor' THEN 1 ELSE 0 END) AS has_c, count(lat) AS n_lat, coalesce(sum(lat), 0.0) AS lat_sum
       FROM c2 WHERE side IS NOT NULL GROUP BY trace_id, turn),
ptr AS (SELECT trace_id, count(*) AS n_turns, sum(has_p) AS n_p, sum(has_c) AS n_c,
               sum(CASE WHEN n_lat > 0 THEN lat_sum END) AS x_sum, CAST(count_if(n_lat > 0) AS BIGINT) AS x_n FROM pt GROUP BY trace_id),
tg AS (SELECT trace_id, name, turn_count, latency, unnest(tags) AS tag FROM tr),
runs AS (SELECT DISTINCT substr(tag, {len(D) + 2}) AS run_name FROM tg WHERE starts_with(tag, '{D}/')),
rt AS (SELECT r.run_name, t.trace_id, t.turn_count, t.latency FROM runs r
       LEFT JOIN tg t ON t.tag = '{D}/' || r.run_name AND t.name = 'generated-conversation'),
t AS (SELECT rt.run_name, rt.trace_id,
             coalesce(CASE WHEN rt.turn_count >= 0 THEN rt.turn_count END, ptr.n_turns, 0) AS counselor_turns,
             coalesce(CASE WHEN rt.turn_count >= 0 THEN rt.turn_count * 2 END, ptr.n_p + ptr.n_c, 0) AS conversation_turns,
             rt.latency AS trace_latency, ptr.x_sum, ptr.x_n
      FROM rt LEFT JOIN ptr ON ptr.trace_id = rt.trace_id)
SELECT run_name, count(trace_id) AS n_traces,
       round(coalesce(sum(x_sum) / sum(x_n), 0.0), 6) AS avg_exchange_latency,
       round(coalesce(avg(CASE WHEN trace_id IS NOT NULL THEN counselor_turns END), 0.0), 6) AS avg_counselor_turns,
       round(coalesce(avg(trace_latency), 0.0), 6) AS avg_conversation_latency,
       round(coalesce(avg(CASE WHEN trace_id IS NOT NULL THEN conversation_turns END), 0.0), 6) AS avg_conversation_turns
FROM t GROUP BY run_name""")
def latency_metrics(spark, d):
    """Observation log + traces -> per run: pooled exchange latency, counselor turns, trace latency, conversation turns."""
    return lt.latency_metrics(inputs.obs_traces(spark, d), inputs.observations(spark, d), D)
