"""JSON helpers over VARIANT (judge replies, completions, free-form metadata).

Judge output has free keys and several shapes, so it is parsed to VARIANT with
``try_parse_json`` (never an inferred schema) and read with ``try_variant_get``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import col_


def strict_parse_json(c) -> Column:
    """Parse like Python's ``json.loads``: the whole text must be exactly one JSON value.

    ``try_parse_json`` stops after the first complete value and ignores what
    follows (``{"a":1} thanks`` parses). Wrapping the text as
    ``[text\n,0]`` and requiring a two-element array rejects any trailing
    content, and a second top-level value, while keeping JVM-side parsing.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), col_(c), F.lit("\n,0]")))
    arr = F.try_variant_get(wrapped, "$", "array<variant>")
    return F.when(F.size(arr) == 2, F.element_at(arr, 1))


def unfence(c) -> Column:
    """Drop a leading ```` ```json\\n ```` and a trailing ```` \\n``` ````."""
    return F.regexp_replace(F.regexp_replace(col_(c), r"^```json\n", ""), r"\n```$", "")


def strip_fences(c) -> Column:
    """Drop every ```` ``` ```` / ```` ```json ```` fence with the white space after it, then strip."""
    return F.regexp_replace(F.regexp_replace(col_(c), r"```(?:json)?\s*", ""), r"^\s+|\s+$", "")


def brace_span(c) -> Column:
    """First ``{`` to last ``}`` (greedy, dot matches newline); '' when absent."""
    return F.regexp_extract(col_(c), r"(?s)(\{.*\})", 1)


def json_from_text(c) -> Column:
    """Parse the brace span of free text; NULL when there is none or it does not parse."""
    return strict_parse_json(F.nullif(brace_span(c), F.lit("")))


def json_block(c) -> Column:
    """Fences removed, then whole text, then the brace span; NULL when neither parses."""
    s = strip_fences(c)
    return F.coalesce(strict_parse_json(s), strict_parse_json(F.nullif(brace_span(s), F.lit(""))))


def json_block_path(c) -> Column:
    """Which path of :func:`json_block` succeeded: 'whole', 'brace' or 'failed'."""
    s = strip_fences(c)
    return (F.when(strict_parse_json(s).isNotNull(), F.lit("whole"))
            .when(strict_parse_json(F.nullif(brace_span(s), F.lit(""))).isNotNull(), F.lit("brace"))
            .otherwise(F.lit("failed")))


def with_json_block(df: DataFrame, text_col: str, out: str, path: str | None = None) -> DataFrame:
    """:func:`json_block` of a column as staged columns: each step reads the one before, and the brace span is looked for
    only where the whole text does not parse. ``path`` names a column for which step succeeded."""
    def parsed(d: DataFrame, source: str, name: str) -> DataFrame:
        wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(source), F.lit("\n,0]")))
        d = d.withColumn("_jb_array", F.try_variant_get(wrapped, "$", "array<variant>"))
        return d.withColumn(name, F.when(F.size("_jb_array") == 2, F.element_at("_jb_array", 1))).drop("_jb_array")

    d = parsed(df.withColumn("_jb_text", strip_fences(text_col)), "_jb_text", "_jb_whole")
    d = d.withColumn("_jb_span", F.when(F.col("_jb_whole").isNull(), F.nullif(brace_span("_jb_text"), F.lit(""))))
    d = parsed(d, "_jb_span", "_jb_brace").withColumn(out, F.coalesce("_jb_whole", "_jb_brace"))
    if path:
        d = d.withColumn(path, F.when(F.col("_jb_whole").isNotNull(), "whole").when(F.col("_jb_brace").isNotNull(), "brace").otherwise("failed"))
    return d.drop("_jb_text", "_jb_whole", "_jb_span", "_jb_brace")


def judge_document(c) -> Column:
    """Comparison-judge reply -> VARIANT: unfence, parse, and unwrap a chat-completion
    envelope (``choices[0].message.content`` parsed again). Parse failures -> NULL."""
    outer = strict_parse_json(unfence(c))
    content = F.try_variant_get(outer, "$.choices[0].message.content", "string")
    return F.when(content.isNotNull(), strict_parse_json(content)).otherwise(outer)


def vget(v, path: str, typ: str = "string") -> Column:
    return F.try_variant_get(col_(v), path, typ)


def variant_entries(v) -> Column:
    """Generator over the (key, value) pairs of a VARIANT object (nothing for non-objects).

    Use as ``df.select(..., variant_entries(v).alias("key", "value"))``.
    """
    return F.explode(F.try_variant_get(col_(v), "$", "map<string,variant>"))


def is_json_null(v) -> Column:
    return F.is_variant_null(col_(v))
