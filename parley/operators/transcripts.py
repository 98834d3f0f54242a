"""Transcripts as tables of lines and chunks, never one string per conversation.

Lines are numbered over the turns of a conversation by a chunk-parallel scan,
their offsets in the transcript come from the speaker scan, and the text is kept
in chunks of a fixed number of characters. A history is a range of characters: two
numbers, until the last step joins the chunks it touches and cuts them. So a
conversation that holds a third of all turns is worked on by many tasks, and
taking the last characters before each message (what a model's window holds) is
linear, not quadratic, in the length of the conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.ranking import segmented_scan
from parley.functions.text import lines, py_strip
from parley.operators.conversation import ROLE_LABELS, SPEAKER_RE, _role_label, speaker_scan, strip_speaker_prefix

CHUNK_CHARS = 1 << 16


def transcript_lines(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                     labels: dict[str, str] | None = None, sep: str = ": ", chunk_rows: int = 1_000_000) -> DataFrame:
    """Turns -> (conv, line_no, line, speaker), the lines of ``render_transcript`` without its string. Turns are numbered by
    integers; a turn without text has no line."""
    label = _role_label(F.col(role_col), labels or ROLE_LABELS)
    said = F.when(label.isNull(), F.col(text_col)).otherwise(F.concat(label, F.lit(sep), F.col(text_col)))
    rows = turns.select(F.col(conv_col), F.col(turn_col).alias("_turn"), lines(said).alias("_lines")).where("_lines IS NOT NULL")
    rows = segmented_scan(rows.withColumn("_n", F.size("_lines")), [conv_col], "_turn", [("_before", "sum", "_n", False)], chunk_rows)
    out = rows.select(conv_col, "_before", F.posexplode("_lines").alias("_at", "line"))
    return out.select(conv_col, (F.col("_before") + F.col("_at")).cast("bigint").alias("line_no"), "line",
                      F.nullif(F.regexp_extract("line", SPEAKER_RE, 1), F.lit("")).alias("speaker"))


def transcript_chunks(scanned: DataFrame, conv_col: str = "conv_id", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Lines with ``start_char`` (see ``speaker_scan``) -> (conv, chunk_no, text): characters k * chunk_chars + 1 and on."""
    text, first = F.concat("line", F.lit("\n")), F.col("start_char") - 1
    last = first + F.length("line")  # the line end
    rows = scanned.select(conv_col, "line_no", "start_char", text.alias("_text"),
                          F.explode(F.sequence(F.expr(f"(start_char - 1) DIV {chunk_chars}"), (last / chunk_chars).cast("bigint"))).alias("chunk_no"))
    lo = F.greatest(F.col("chunk_no") * chunk_chars - first, F.lit(0))
    hi = (F.col("chunk_no") + 1) * chunk_chars - first
    piece = F.substr("_text", (lo + 1).cast("int"), (hi - lo).cast("int"))
    return rows.select(conv_col, "chunk_no", "line_no", piece.alias("_piece")).groupBy(conv_col, "chunk_no").agg(
        F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY line_no)").alias("text"))


def cut_ranges(ranges: DataFrame, chunks: DataFrame, keys: list[str], conv_col: str = "conv_id", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Rows (keys..., conv, lo, hi: 1-based characters, both included) -> keys and the ``text`` of their range ('' where hi < lo).

    ``keys`` name a range uniquely. Each range meets the chunks it touches by their number.
    """
    touched = F.when(F.col("hi") >= F.col("lo"), F.sequence(F.expr(f"(lo - 1) DIV {chunk_chars}"), F.expr(f"(hi - 1) DIV {chunk_chars}")))
    rows = ranges.select(*keys, *([conv_col] if conv_col not in keys else []), "lo", "hi", F.explode_outer(touched).alias("chunk_no"))
    met = rows.join(chunks, [conv_col, "chunk_no"], "left")
    start = F.col("chunk_no") * chunk_chars
    lo = F.greatest(F.col("lo") - start, F.lit(1))
    piece = F.substr("text", lo.cast("int"), (F.least(F.col("hi") - start, F.lit(chunk_chars)) - lo + 1).cast("int"))
    return met.select(*keys, "chunk_no", piece.alias("_piece")).groupBy(*keys).agg(
        F.coalesce(F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY chunk_no)"), F.lit("")).alias("text"))


def history_tails(turns: DataFrame, max_chars: int, speaker: str = "Counselor", conv_col: str = "conv_id", chunk_chars: int = CHUNK_CHARS,
                  chunk_rows: int = 1_000_000, **render) -> DataFrame:
    """For every ``speaker`` block: the last ``max_chars`` characters of what was said before, and its message without prefixes.

    (conversation_id, pair_idx, history_chars, history_tail, message), as from ``history_pairs`` cut at the end.
    """
    scanned = speaker_scan(transcript_lines(turns, conv_col, chunk_rows=chunk_rows, **render), conv_col, speaker, chunk_rows)
    chunks = transcript_chunks(scanned, conv_col, chunk_chars)
    blocks = scanned.groupBy(conv_col, "block_idx").agg(
        F.max("speaker").alias("speaker"), F.min("start_char").alias("start_char"), F.max("c_ord").alias("c_ord"),
        F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY line_no)").alias("block")).where(F.col("speaker") == speaker)
    hi = F.greatest(F.col("start_char") - 2, F.lit(0))
    pairs = blocks.select(conv_col, (F.col("c_ord") - 1).alias("pair_idx"), hi.alias("hi"), F.greatest(hi - max_chars + 1, F.lit(1)).alias("lo"), "block")
    tails = cut_ranges(pairs.drop("block"), chunks, [conv_col, "pair_idx"], conv_col, chunk_chars)
    out = pairs.join(tails, [conv_col, "pair_idx"])
    return out.select(F.col(conv_col).alias("conversation_id"), F.col("pair_idx").cast("bigint").alias("pair_idx"), F.col("hi").cast("bigint").alias("history_chars"),
                      F.col("text").alias("history_tail"), strip_speaker_prefix(py_strip("block"), speaker + ":").alias("message"))
