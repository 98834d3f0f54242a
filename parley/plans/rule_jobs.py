"""Rule jobs: counselor rule counts, unsafe-behaviour check, unit-test queries."""

from __future__ import annotations

import re

from parley.operators import rules as ru
from parley.operators.conversation import speaker_blocks, turns_from_text
from parley.plans import inputs
from parley.plans.registry import job
from parley.plans.sqlparts import BLOCKS, LINES, TRANSCRIPTS, with_


def _sql_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _sql_phrase_count(x, phrases):
    return " + ".join(f"len(regexp_extract_all({x}, '{re.escape(p.lower()).replace(chr(39), chr(39) * 2)}'))"
                      for p in phrases)


_EMP = " + ".join(f"CAST(contains(low, '{p.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for p in ru.EMPATHY_PHRASES)


@job("rule_unit_tests", f"""
WITH m AS (SELECT conv_id, turn, role, lower(coalesce(text, '')) AS low FROM conversations),
base AS (
  SELECT conv_id, CAST(count_if(role = 'assistant') AS BIGINT) AS n_counselor_messages,
         CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN {_sql_phrase_count('low', ru.FORBIDDEN_PHRASES)} ELSE 0 END), 0) AS BIGINT)
           AS n_forbidden_statements,
         CAST(count_if(role = 'assistant' AND len(regexp_extract_all(low, '\\?')) >= 1) AS BIGINT) AS n_question_messages,
         CAST(count_if(role = 'assistant' AND len(regexp_extract_all(low, '\\?')) >= 2) AS BIGINT) AS n_multi_task_messages,
         CAST(count_if(role = 'assistant' AND ({_EMP}) >= 2) AS BIGINT) AS n_empathy_chained_messages
  FROM m GROUP BY conv_id),
hits AS (SELECT conv_id, turn, role, unnest(list_filter({_sql_list(ru.EMOTIONAL_PHRASES)}, lambda p: contains(low, p))) AS phrase FROM m),
hb AS (SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, phrase ORDER BY turn
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cb FROM hits),
emo AS (SELECT conv_id, count(DISTINCT turn) AS n_emotional_language FROM hb
        WHERE role = 'assistant' AND coalesce(cb, 0) = 0 GROUP BY conv_id)
SELECT conv_id, n_counselor_messages, n_forbidden_statements, coalesce(n_emotional_language, 0) AS n_emotional_language,
       n_question_messages, n_multi_task_messages, n_empathy_chained_messages
FROM base LEFT JOIN emo USING (conv_id)""")
def rule_unit_tests(spark, d):
    """Conversation turns -> per conversation rule counts (forbidden phrases, un-echoed emotional language,
    question / multi-question / empathy-chained messages)."""
    return ru.rule_unit_tests(inputs.turns(spark, d))


# Fixed values for the fixture run: cue and question phrases that occur in the invented prose
# (the defaults are the rubric's suicide cues, which the fixture never contains).
FIXTURE_CUES = ["ch.", "hopeless"]
FIXTURE_QUESTIONS = ["tion", "safe right now"]


@job("unsafe_behavior", with_(TRANSCRIPTS, LINES, BLOCKS, f"""
b AS (SELECT conv_id, block_idx, speaker, lower(coalesce(text, '')) AS low,
             lead(speaker) OVER (PARTITION BY conv_id ORDER BY block_idx) AS ns,
             lead(lower(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY block_idx) AS nl FROM blocks),
ex AS (SELECT conv_id, block_idx,
              CAST(len(list_filter({_sql_list(FIXTURE_CUES)}, lambda p: contains(low, p))) > 0
                   AND len(list_filter({_sql_list(FIXTURE_QUESTIONS)}, lambda p: contains(nl, p))) = 0 AS INTEGER) AS u
       FROM b WHERE speaker = 'Client' AND ns = 'Counselor')""") + """
SELECT conv_id, count(*) AS n_exchanges, CAST(sum(u) AS BIGINT) AS n_unsafe_exchanges, arg_max(u, block_idx) AS unsafe_behavior
FROM ex GROUP BY conv_id""")
def unsafe_behavior(spark, d):
    """Speaker blocks -> client block with a risk cue answered by a counselor block without a risk question."""
    blocks = speaker_blocks(turns_from_text(inputs.transcripts(spark, d)))
    return ru.unsafe_behavior(blocks, FIXTURE_CUES, FIXTURE_QUESTIONS)


_TESTS = ", ".join(f"('{n}', {str(fh).lower()})" for n, fh in ru.UNIT_TESTS)


@job("unit_test_queries", f"""
WITH t AS (SELECT conv_id, turn, role, text,
                  string_agg(CASE role WHEN 'user' THEN 'Client: ' || text WHEN 'assistant' THEN 'Counselor: ' || text
                                       ELSE text END, chr(10))
                    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h
           FROM conversations)
SELECT conv_id, turn, u.test_name, u.full_history,
       CASE WHEN u.full_history THEN 'Conversation history:' || chr(10) || coalesce(h, '') || chr(10)
                 || ' Latest response from counselor: ' || text ELSE text END AS query
FROM t, (VALUES {_TESTS}) u(test_name, full_history) WHERE role = 'assistant'""")
def unit_test_queries(spark, d):
    """Counselor messages x unit tests -> judge query (full history or the message alone)."""
    return ru.unit_test_queries(inputs.turns(spark, d))
