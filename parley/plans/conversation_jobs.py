"""Conversation jobs: blocks, pairs, evaluation items, client runs, cleanup, head per ticket."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import conversation as conv
from parley.operators import transcripts
from parley.plans import inputs
from parley.plans.registry import job
from parley.plans.sqlparts import BLOCKS, LINES, PAIRS, TRANSCRIPTS, strip, with_

SQL_SPEAKER_BLOCKS = with_(TRANSCRIPTS, LINES, BLOCKS) + "SELECT * FROM blocks"


@job("speaker_blocks", SQL_SPEAKER_BLOCKS)
def speaker_blocks(spark, d):
    """turns -> rendered transcript -> lines -> speaker blocks."""
    lines = conv.turns_from_text(inputs.transcripts(spark, d))
    return conv.speaker_blocks(lines).select("conv_id", F.col("block_idx").cast("bigint"), "speaker", "text")


SQL_HISTORY_PAIRS = with_(TRANSCRIPTS, LINES, BLOCKS, PAIRS) + "SELECT * FROM pairs"


@job("history_pairs", SQL_HISTORY_PAIRS)
def history_pairs(spark, d):
    """Speaker blocks -> (history, counselor message) per counselor block, prefix stripped."""
    tr = inputs.transcripts(spark, d)
    blocks = conv.speaker_blocks(conv.turns_from_text(tr))
    return conv.history_pairs(blocks, tr).select(
        "conversation_id", F.col("pair_idx").cast("bigint"), F.col("block_idx").cast("bigint"),
        "convo_history", "counselor_message")


TAIL_CHARS = 2000


@job("history_tails", with_(TRANSCRIPTS, LINES, BLOCKS, PAIRS) + f"""
SELECT conversation_id, pair_idx, length(convo_history) AS history_chars,
       CASE WHEN length(convo_history) > {TAIL_CHARS} THEN right(convo_history, {TAIL_CHARS}) ELSE convo_history END AS history_tail,
       counselor_message AS message
FROM pairs""")
def history_tails(spark, d):
    """Turns -> lines, chunks and ranges -> the last 2000 characters before each counselor block (no transcript string)."""
    return transcripts.history_tails(inputs.turns(spark, d), TAIL_CHARS)


SQL_EVAL_ITEMS = with_(TRANSCRIPTS, LINES, BLOCKS, PAIRS, """
t AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY pair_idx) AS rn,
             count(*) OVER (PARTITION BY conversation_id) AS cnt FROM pairs),
k AS (SELECT * FROM t WHERE rn > 1 AND rn <= cnt - 1),
s AS (SELECT *, row_number() OVER (PARTITION BY conversation_id
        ORDER BY md5(concat_ws(':', CAST(conversation_id AS VARCHAR), CAST(pair_idx AS VARCHAR), '16')), pair_idx) AS rk
      FROM k)""") + """
SELECT sha256(concat_ws(':', CAST(conversation_id AS VARCHAR), CAST(pair_idx AS VARCHAR))) AS uid,
       conversation_id, pair_idx, convo_history, counselor_message
FROM s WHERE rk <= 2"""


@job("eval_items", SQL_EVAL_ITEMS)
def eval_items(spark, d):
    """Pairs -> drop first/last 1 counselor message -> at most 2 per conversation (seed 16) -> hashed uid."""
    items = conv.eval_items(inputs.transcripts(spark, d), n_trim=1, max_per_conv=2, seed=16)
    return items.withColumn("pair_idx", F.col("pair_idx").cast("bigint"))


SQL_CLIENT_MESSAGES = with_(TRANSCRIPTS, """
cl AS (
  SELECT conv_id, pos - 1 AS line_no, """ + strip("parts[pos]") + """ AS line
  FROM (SELECT conv_id, parts, unnest(generate_series(1, len(parts))) AS pos
        FROM (SELECT conv_id, string_split(""" + strip("conversation") + """, chr(10)) AS parts FROM tr))
),
f AS (SELECT *, starts_with(lower(line), 'client:') AS is_client FROM cl),
r AS (SELECT *, sum(CASE WHEN is_client THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY line_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f),
g AS (SELECT conv_id, run, min(line_no) AS first_line,
             string_agg(regexp_replace(line, '(?i)^client:\\s*', ''), ' // ' ORDER BY line_no) AS message
      FROM r WHERE is_client GROUP BY conv_id, run)""") + """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY first_line) - 1 AS msg_idx, message FROM g"""


@job("client_messages", SQL_CLIENT_MESSAGES)
def client_messages(spark, d):
    """Transcript -> runs of consecutive client lines joined by ' // '."""
    out = conv.client_messages(inputs.transcripts(spark, d))
    return out.withColumn("msg_idx", F.col("msg_idx").cast("bigint"))


CLEANUP_MAX_MESSAGES = 3
CLEANUP_MARKER = "ch."
CLEANUP_DELIMITER = "\n"

SQL_DIALOGUE_CLEANUP = f"""
WITH r AS (
  SELECT conv_id, turn, role, string_split(text, chr(10)) AS parts, len(string_split(text, chr(10))) AS n,
         CASE WHEN contains(lower(text), '{CLEANUP_MARKER}') THEN 1 ELSE 0 END AS e
  FROM conversations WHERE role IN ('user', 'assistant')),
w AS (
  SELECT *, coalesce(max(e) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended,
         1 + 2 * coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hist
  FROM r),
g AS (
  SELECT *, coalesce(last_value(CASE WHEN role = 'user' THEN hist < {2 * CLEANUP_MAX_MESSAGES} END IGNORE NULLS)
                       OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     hist < {2 * CLEANUP_MAX_MESSAGES}) AS gate
  FROM w),
k AS (
  SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS nx
  FROM g WHERE ended = 0 AND gate)
SELECT conv_id, turn, role, pos - 1 AS part_idx, parts[pos] AS message,
       CAST(nx AS BIGINT) AS n_exchanges, CAST(nx * 2 AS BIGINT) AS n_conversation_turns
FROM (SELECT *, unnest(generate_series(1, len(parts))) AS pos FROM k)"""


@job("dialogue_cleanup", SQL_DIALOGUE_CLEANUP)
def dialogue_cleanup(spark, d):
    """Replies -> end-marker / length cut -> multi-part split -> exchange counts."""
    out = conv.dialogue_cleanup(inputs.turns(spark, d), max_messages=CLEANUP_MAX_MESSAGES,
                                marker=CLEANUP_MARKER, delimiter=CLEANUP_DELIMITER)
    return out.withColumn("part_idx", F.col("part_idx").cast("bigint"))


SQL_FIRST_N = """
WITH log AS (
  SELECT o_orderkey AS ID, o_custkey AS Ticket_ID,
         CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'O' THEN 'None' ELSE o_orderpriority END AS Agent_ID,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS Sent_Date_And_Time,
         concat_ws(' ', o_orderstatus, o_orderpriority) AS Thread_Content
  FROM orders),
d AS (SELECT ID AS id, Ticket_ID AS ticket_id, Agent_ID AS agent_id,
             try_cast(Sent_Date_And_Time AS TIMESTAMP) AS sent_date, Thread_Content AS message FROM log),
h AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY sent_date NULLS LAST, id) AS rn FROM d)
SELECT id, ticket_id, sent_date,
       CASE WHEN agent_id IS NULL OR agent_id = 'None' THEN 'client' ELSE 'counselor' END AS speaker,
       message, rn - 1 AS row_in_ticket
FROM h WHERE rn <= 10 AND message IS NOT NULL"""


@job("first_n_per_group", SQL_FIRST_N)
def first_n_per_group(spark, d):
    """Message log -> normalised columns -> first 10 messages per ticket by time."""
    out = conv.first_n_per_group(inputs.message_log(spark, d), n=10)
    return (out.withColumn("row_in_ticket", F.col("row_in_ticket").cast("bigint"))
            .withColumn("sent_date", F.col("sent_date").cast("timestamp_ntz")))
