"""Conversation operators: transcripts -> lines -> speaker blocks -> (history, response) pairs.

All operators are windowed per conversation. The windows share one hash
partitioning on the conversation id, so a chain like
``speaker_blocks -> history_pairs -> trim_edges -> sample_per_group`` costs a
single shuffle: later ``groupBy(conv, block)`` / ``Window.partitionBy(conv)``
steps are satisfied by the existing partitioning.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.ranking import segmented_scan
from parley.functions.text import NL, lines, py_strip, stable_id

SPEAKER_PREFIXES = ("Counselor", "Patient", "Therapist", "Client")
SPEAKER_RE = "^(" + "|".join(SPEAKER_PREFIXES) + "):"

# Fixed role labels used when rendering a turn table as a transcript.
ROLE_LABELS = {"user": "Client", "assistant": "Counselor"}


def _role_label(role_col, labels: dict[str, str]):
    expr = None
    for role, label in labels.items():
        expr = (F.when(role_col == role, F.lit(label)) if expr is None
                else expr.when(role_col == role, F.lit(label)))
    return expr


def render_transcript(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role", text_col: str = "text",
                      labels: dict[str, str] | None = None, sep: str = ": ",
                      out_col: str = "conversation") -> DataFrame:
    """``role: text`` lines joined by newline in turn order; unlabelled roles render bare (preamble)."""
    labels = labels or ROLE_LABELS
    label = _role_label(F.col(role_col), labels)
    line = F.when(label.isNull(), F.col(text_col)).otherwise(F.concat(label, F.lit(sep), F.col(text_col)))
    return (turns.select(conv_col, turn_col, line.alias("_line"))
            .groupBy(conv_col)
            .agg(F.expr(f"listagg(_line, '\\n') WITHIN GROUP (ORDER BY {turn_col})").alias(out_col)))


def turns_from_text(transcripts: DataFrame, id_col: str = "conv_id",
                    text_col: str = "conversation") -> DataFrame:
    """One row per line: (id, line_no, line, speaker); speaker is the case-sensitive prefix or NULL."""
    return (transcripts
            .select(id_col, F.posexplode(lines(text_col)).alias("line_no", "line"))
            .withColumn("speaker", F.nullif(F.regexp_extract("line", SPEAKER_RE, 1), F.lit(""))))


def speaker_scan(line_rows: DataFrame, id_col: str = "conv_id", counselor: str = "Counselor",
                 chunk_rows: int = 1_000_000) -> DataFrame:
    """Line rows -> + block_idx, counselor block ordinal (``c_ord``, 1-based), its per-conversation total
    (``c_total``) and the 1-based character offset of each line (``start_char``), in one chunk-parallel pass.

    Gaps-and-islands as a parallel prefix scan: inside each (conversation,
    chunk of ``chunk_rows`` lines) a window finds the block starts it can decide
    locally (a prefixed line whose speaker differs from the previous prefixed
    line of the chunk); a per-chunk summary (one row per chunk) carries the last
    speaker forward, which decides whether each chunk's first prefixed line
    starts a block, and accumulates block / counselor-block / character counts.
    A conversation holding a third of all lines is scanned by many tasks.
    """
    pos = "line_no"
    d = (line_rows.withColumn("_chunk", F.floor(F.col(pos) / F.lit(chunk_rows)).cast("bigint"))
         .withColumn("_len1", F.length("line") + 1))
    w = Window.partitionBy(id_col, "_chunk").orderBy(pos)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sp = F.col("speaker")
    d = d.withColumn("_lprev", F.last(sp, ignorenulls=True).over(before))
    local_start = sp.isNotNull() & F.col("_lprev").isNotNull() & (sp != F.col("_lprev"))
    d = (d.withColumn("_first_p", sp.isNotNull() & F.col("_lprev").isNull())
         .withColumn("_ls", local_start.cast("int"))
         .withColumn("_lcs", (local_start & (sp == counselor)).cast("int")))
    d = (d.withColumn("_ls_cum", F.sum("_ls").over(upto))
         .withColumn("_lcs_cum", F.sum("_lcs").over(upto))
         .withColumn("_chars_l", F.coalesce(F.sum("_len1").over(before), F.lit(0))))
    summ = d.groupBy(id_col, "_chunk").agg(
        F.min_by(sp, F.when(sp.isNotNull(), F.col(pos))).alias("_first_sp"),
        F.min(F.when(sp.isNotNull(), F.col(pos))).alias("_first_pos"),
        F.max_by(sp, F.when(sp.isNotNull(), F.col(pos))).alias("_last_sp"),
        F.sum("_ls").alias("_n_ls"), F.sum("_lcs").alias("_n_lcs"), F.sum("_len1").alias("_n_chars"))
    wc = Window.partitionBy(id_col).orderBy("_chunk")
    prev_chunks = wc.rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_carry_last", F.last("_last_sp", ignorenulls=True).over(prev_chunks))
    fis = (F.col("_first_sp").isNotNull()
           & (F.col("_carry_last").isNull() | (F.col("_first_sp") != F.col("_carry_last"))))
    summ = (summ.withColumn("_fis", fis.cast("int"))
            .withColumn("_fics", (fis & (F.col("_first_sp") == counselor)).cast("int")))
    summ = summ.select(
        id_col, "_chunk", "_first_pos", "_fis", "_fics",
        F.coalesce(F.sum(F.col("_n_ls") + F.col("_fis")).over(prev_chunks), F.lit(0)).alias("_c_starts"),
        F.coalesce(F.sum(F.col("_n_lcs") + F.col("_fics")).over(prev_chunks), F.lit(0)).alias("_c_cstarts"),
        F.coalesce(F.sum("_n_chars").over(prev_chunks), F.lit(0)).alias("_c_chars"),
        F.sum(F.col("_n_lcs") + F.col("_fics")).over(Window.partitionBy(id_col)).alias("c_total"))
    d = d.join(summ, [id_col, "_chunk"], "left")
    after_first = F.coalesce((F.col(pos) >= F.col("_first_pos")).cast("int"), F.lit(0))
    return d.select(
        *line_rows.columns,
        (F.col("_c_starts") + F.col("_ls_cum") + F.col("_fis") * after_first).alias("block_idx"),
        (F.col("_c_cstarts") + F.col("_lcs_cum") + F.col("_fics") * after_first).alias("c_ord"),
        "c_total",
        (F.col("_c_chars") + F.col("_chars_l") + 1).alias("start_char"))


def speaker_blocks(line_rows: DataFrame, id_col: str = "conv_id", chunk_rows: int = 1_000_000,
                   counselor: str = "Counselor") -> DataFrame:
    """Group lines into speaker blocks.

    A new block starts only on a *prefixed* line whose speaker differs from the
    current speaker; unprefixed lines continue the current block; lines before
    the first prefix form block 0 (preamble, speaker NULL). Blocks are numbered
    1.. after an optional preamble 0. ``start_char`` is the block's 1-based
    character offset in the transcript; ``c_ord`` / ``c_total`` number the
    ``counselor`` blocks (see :func:`speaker_scan`).
    """
    s = speaker_scan(line_rows, id_col, counselor, chunk_rows)
    return (s.groupBy(id_col, "block_idx")
            .agg(F.max("speaker").alias("speaker"),
                 F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY line_no)").alias("text"),
                 F.min("start_char").alias("start_char"), F.max("c_ord").alias("c_ord"),
                 F.max("c_total").alias("c_total")))


def strip_speaker_prefix(c, prefix: str = "Counselor:"):
    """Remove ``prefix`` from every line that starts with it (and strip that line), then strip the whole."""
    n = len(prefix)
    fixed = F.transform(lines(c), lambda l: F.when(l.startswith(prefix), py_strip(l.substr(F.lit(n + 1), F.length(l))))
                        .otherwise(l))
    return py_strip(F.array_join(fixed, NL))


def history_pairs(blocks: DataFrame, transcripts: DataFrame, id_col: str = "conv_id", speaker: str = "Counselor",
                  text_col: str = "conversation", keep_block: bool = False) -> DataFrame:
    """For every ``speaker`` block i: history = blocks before i joined by newline ('' for the first).

    Blocks are consecutive line groups, so the history is the transcript
    prefix before the block's first character - a substring of the
    transcript, joined back by conversation id (AQE splits a hot
    conversation), instead of a per-conversation collect over earlier blocks.
    ``pair_idx`` / ``n_pairs`` come from the speaker scan's counselor-block
    ordinal (blocks must come from :func:`speaker_blocks` with the same
    ``speaker``). ``keep_block`` also returns the raw block text.
    """
    sb = blocks.filter(F.col("speaker") == speaker)
    j = sb.join(transcripts.select(id_col, F.col(text_col).alias("_t")), id_col, "inner")
    hist = F.substring(F.col("_t"), 1, F.greatest(F.col("start_char") - 2, F.lit(0)))
    return j.select(
        F.col(id_col).alias("conversation_id"),
        (F.col("c_ord") - 1).alias("pair_idx"),
        "block_idx",
        hist.alias("convo_history"),
        strip_speaker_prefix(py_strip("text"), speaker + ":").alias("counselor_message"),
        F.col("c_total").alias("n_pairs"),
        *([F.col("text").alias("block_text")] if keep_block else []),
    )


def trim_edges(pairs: DataFrame, n: int, id_col: str = "conversation_id", order_col: str = "pair_idx",
               count_col: str = "n_pairs") -> DataFrame:
    """Drop the first and last ``n`` pairs per conversation; conversations with <= 2n pairs vanish.

    ``order_col`` is the dense 0-based pair index and ``count_col`` the pairs per
    conversation (both produced by :func:`history_pairs`), so trimming is a
    row-local filter. Without a count column the count is a partial aggregate
    joined back. n = 0 keeps everything (the reference's ``[0:-0]`` slip that
    drops all is not reproduced).
    """
    if n <= 0:
        return pairs
    if count_col not in pairs.columns:
        counts = pairs.groupBy(id_col).agg(F.count(F.lit(1)).alias(count_col))
        pairs = pairs.join(counts, id_col)
    return pairs.filter((F.col(order_col) >= n) & (F.col(order_col) < F.col(count_col) - n))


def sample_per_group(df: DataFrame, m: int, seed: int, id_col: str, order_col: str) -> DataFrame:
    """At most ``m`` rows per group, chosen by a seeded hash order (same set on any cluster layout)."""
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col(order_col).cast("string"), F.lit(str(seed))))
    w = Window.partitionBy(id_col).orderBy(key, order_col)
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= m).drop("_rk")


def eval_items(transcripts: DataFrame, n_trim: int = 5, max_per_conv: int | None = None,
               seed: int = 16, id_col: str = "conv_id", text_col: str = "conversation") -> DataFrame:
    """Transcripts -> static evaluation items (uid, conversation_id, convo_history, counselor_message)."""
    blocks = speaker_blocks(turns_from_text(transcripts, id_col, text_col), id_col)
    pairs = history_pairs(blocks, transcripts, id_col, text_col=text_col)
    kept = trim_edges(pairs, n_trim)
    if max_per_conv:
        kept = sample_per_group(kept, max_per_conv, seed, "conversation_id", "pair_idx")
    return kept.select(stable_id("conversation_id", "pair_idx").alias("uid"), "conversation_id", "pair_idx",
                       "convo_history", "counselor_message")


def client_messages(transcripts: DataFrame, id_col: str = "conv_id", text_col: str = "conversation",
                    joiner: str = " // ", chunk_rows: int = 1_000_000) -> DataFrame:
    """Runs of consecutive ``client:`` lines (any case) joined by `` // ``; any other line ends a run."""
    rows = transcripts.select(id_col, F.posexplode(lines(py_strip(text_col))).alias("line_no", "line"))
    rows = rows.withColumn("line", py_strip("line"))
    rows = rows.withColumn("_client", F.lower(F.col("line")).startswith("client:"))
    rows = rows.withColumn("_other", (~F.col("_client")).cast("int"))
    rows = segmented_scan(rows, [id_col], "line_no", [("_run", "sum", "_other", True)], chunk_rows)
    msg = F.regexp_replace("line", r"(?i)^client:\s*", "")
    runs = (rows.filter("_client").withColumn("msg", msg)
            .groupBy(id_col, "_run")
            .agg(F.min("line_no").alias("_first"),
                 F.expr(f"listagg(msg, '{joiner}') WITHIN GROUP (ORDER BY line_no)").alias("message")))
    runs = segmented_scan(runs.withColumn("_one", F.lit(1)), [id_col], "_first", [("_k", "sum", "_one", True)],
                          chunk_rows)
    return runs.select(id_col, (F.col("_k") - 1).alias("msg_idx"), "message")


def dialogue_cleanup(replies: DataFrame, max_messages: int = 100, marker: str = "[end conversation]",
                     delimiter: str = "//", id_col: str = "conv_id", chunk_rows: int = 1_000_000) -> DataFrame:
    """Cut a generated dialogue where the simulator loop would have stopped, then split multi-part replies.

    Replies (user = patient, assistant = counselor) are processed in turn order
    after one opening counselor message (history length 1). Before each patient
    reply the loop continues only while no earlier reply contained ``marker``
    (any case) and history length < 2*max_messages, where every message part
    adds two history entries. A patient reply with the marker ends the dialogue
    (no counselor reply follows); a counselor reply is kept when its patient
    reply was. Output: one row per kept message part plus the exchange count.
    Running state is computed with chunk-parallel prefix scans.
    """
    r = replies.filter(F.col("role").isin("user", "assistant"))
    r = (r.withColumn("_parts", F.split("text", _java_quote(delimiter), -1))
         .withColumn("_n", F.size("_parts"))
         .withColumn("_end", F.lower("text").contains(marker.lower()).cast("int")))
    r = segmented_scan(r, [id_col], "turn", [("_ended", "max", "_end", False), ("_before", "sum", "_n", False)],
                       chunk_rows)
    r = (r.withColumn("_ended", F.coalesce("_ended", F.lit(0)))
         .withColumn("_hist", 1 + 2 * F.col("_before")))
    r = r.withColumn("_gate_p", F.when(F.col("role") == "user", F.col("_hist") < 2 * max_messages))
    r = segmented_scan(r, [id_col], "turn", [("_gate_l", "last", "_gate_p", True)], chunk_rows)
    r = r.withColumn("_gate", F.coalesce(F.col("_gate_l"), F.col("_hist") < 2 * max_messages))
    kept = r.filter((F.col("_ended") == 0) & F.col("_gate"))
    kept = kept.join(turn_count(kept, id_col, "user"), id_col)
    return kept.select(id_col, "turn", "role", F.posexplode("_parts").alias("part_idx", "message"),
                       "n_exchanges", "n_conversation_turns")


def _java_quote(s: str) -> str:
    """Quote a literal for a Java regex."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", s)


def first_n_per_group(log: DataFrame, n: int = 10) -> DataFrame:
    """Message log -> first ``n`` messages per ticket by time (WindowGroupLimit-friendly).

    Columns are lower-cased and renamed (sent_date_and_time -> sent_date,
    thread_content -> message), the date parsed (bad dates -> NULL), the speaker
    derived from agent_id (NULL or 'None' -> client) and rows without a message
    dropped after the head is taken. Ties on time break by id.
    """
    df = log.toDF(*[c.lower() for c in log.columns])
    df = df.withColumnsRenamed({"sent_date_and_time": "sent_date", "thread_content": "message"})
    df = df.withColumn("sent_date", F.try_to_timestamp(F.col("sent_date").cast("string")))
    w = Window.partitionBy("ticket_id").orderBy(F.col("sent_date").asc_nulls_last(), F.col("id"))
    head = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    speaker = F.when(F.col("agent_id").isNull() | (F.col("agent_id").cast("string") == "None"),
                     F.lit("client")).otherwise(F.lit("counselor"))
    return (head.withColumn("speaker", speaker)
            .filter(F.col("message").isNotNull())
            .select("id", "ticket_id", "sent_date", "speaker", "message", (F.col("_rn") - 1).alias("row_in_ticket")))


def turn_count(replies: DataFrame, id_col: str = "conv_id", role: str = "assistant") -> DataFrame:
    """Exchanges per conversation (= replies of ``role``); conversation turns = 2x that."""
    return (replies.groupBy(id_col)
            .agg(F.count_if(F.col("role") == role).alias("n_exchanges"))
            .withColumn("n_conversation_turns", F.col("n_exchanges") * 2))
