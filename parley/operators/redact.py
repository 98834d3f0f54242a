"""Redaction and its evaluation: names, placeholder extension, patterns, spans, accuracy report.

Everything is a row-local JVM expression (``regexp_replace`` / ``regexp_count``
/ ``aggregate`` + ``overlay``) except the injected span detector, which runs over
Arrow batches of texts, or of windows of long texts, and the name list, which
is joined with the words of the texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import col_, collapse_ws

NAME_TOKEN = "[NAME]"

# Patterns that catch letters/digits glued to a placeholder, applied in this order; the
# reference's label -> placeholder lookup never matches these labels, so every hit becomes "<PHI>".
_PUNCT = r'[.,;:!?"]'
EXTEND_PATTERNS = [
    ("PERSON", rf"<PERSON>[a-zA-Z]+{_PUNCT}?|[a-zA-Z]+<PERSON>{_PUNCT}?"),
    ("ORGANIZATION", rf"<ORGANIZATION>[a-zA-Z0-9\s]+{_PUNCT}?|[a-zA-Z0-9\s]+<ORGANIZATION>{_PUNCT}?"),
    ("DATE_TIME", rf"<DATE_TIME>\d+[\/\-]\d+[\/\-]\d+{_PUNCT}?|\d+[\/\-]\d+[\/\-]\d+<DATE_TIME>{_PUNCT}?"),
    ("PHI", rf"<PHI>[a-zA-Z0-9]+{_PUNCT}?|[a-zA-Z0-9]+<PHI>{_PUNCT}?"),
]
# Entity label -> placeholder for detected spans (anything else -> "<PHI>").
ENTITY_PLACEHOLDER = {"PER": "<PERSON>", "ORG": "<ORGANIZATION>", "DATE": "<DATE_TIME>"}
SPAN_THRESHOLD = 0.45

# Pattern redaction (re-aim of the LLM redactor): type -> (pattern, placeholder), applied in order.
PHI_PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"),
    ("phone", r"(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}", "<PHONE>"),
    ("other_id", r"\b(?:\d{9,19}|\d{1,3}(?:\.\d{1,3}){3}|[0-9a-f]{32,64})\b", "<ID>"),
    ("date_time", r"\b\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\b", "<DATE_TIME>"),
    ("age", r"(?i)\b\d{1,3}[ -]?(?:years? old|yo|y/o)\b", "<AGE>"),
]

# Error categories of the redaction review.
ERROR_TYPES = ["date_time", "location", "age", "name", "phone", "email", "other_id"]


def redact_names(df: DataFrame, text_col: str, names: DataFrame, out_col: str) -> DataFrame:
    """Each whole word whose lower form is in ``names`` -> ``[NAME]``, for a list of any size.

    The distinct words of each text are looked up in the list (a join that Spark
    broadcasts by measured size, so that only hits are shuffled), and the hits
    come back to the texts, which are rewritten row by row. Rows are matched by a digest of their text, so no
    key is needed and equal texts are looked up once. A listed name that is not
    one word matches nothing.
    """
    listed = names.select(F.lower(F.trim(F.col(names.columns[0]))).alias("_name")).distinct()
    keyed = df.withColumn("_digest", F.sha2(F.col(text_col), 256))
    words = keyed.select("_digest", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?U)\w+"), F.lit(0)))).alias("_name"))
    hits = words.join(listed, "_name").groupBy("_digest").agg(F.collect_set("_name").alias("_hits"))
    pieces = F.split(F.col(text_col), r"(?U)(?<=\w)(?=\W)|(?<=\W)(?=\w)")
    redacted = F.array_join(F.transform(pieces, lambda w: F.when(F.array_contains("_hits", F.lower(w)), F.lit(NAME_TOKEN)).otherwise(w)), "")
    out = keyed.join(hits, "_digest", "left").withColumn(out_col, F.when(F.col("_hits").isNull(), F.col(text_col)).otherwise(redacted))
    return out.drop("_digest", "_hits")


def count_token(c, token: str) -> Column:
    return F.regexp_count(col_(c), F.lit(re.escape(token)))


def _linear(pattern: str) -> str:
    """Same matches, linear time: a run that must end in a placeholder can only start where the run starts
    (leftmost match), so interior starts are cut by a lookbehind and the run is matched possessively."""
    head, tail = pattern.split("|")
    m = re.match(r"^(\[[^\]]+\]|\\d)\+(.*)$", tail)
    if not m:
        return pattern
    cls = m.group(1)
    return f"{head}|(?<!{cls}){cls}++{m.group(2)}"


def redact_extend(c) -> Column:
    """Swallow letters/digits glued to a placeholder (four patterns in order) -> ``<PHI>``.

    Patterns run in their linear-time form (:func:`_linear`), and only on texts
    that contain a placeholder at all (four substring probes). Pass a column
    reference (see :func:`extend_column`): the input is referenced more than
    once."""
    c = col_(c)
    chain = c
    for _, pat in EXTEND_PATTERNS:
        chain = F.regexp_replace(chain, _linear(pat), "<PHI>")
    guard = None
    for label, _ in EXTEND_PATTERNS:
        g = c.contains(f"<{label}>")
        guard = g if guard is None else guard | g
    return F.when(guard, chain).otherwise(c)


def extend_column(df: DataFrame, col: str, typed: bool = False) -> DataFrame:
    """Apply the four extend patterns to a materialised column in place, each only on rows containing its own
    placeholder (staged: every step reads the previous step's column, so no regex is evaluated twice).

    Every hit becomes ``<PHI>`` (reference parity); ``typed`` keeps the entity's own placeholder instead."""
    for label, pat in EXTEND_PATTERNS:
        c = F.col(col)
        out = f"<{label}>" if typed else "<PHI>"
        df = df.withColumn(col, F.when(c.contains(f"<{label}>"), F.regexp_replace(c, _linear(pat), out)).otherwise(c))
    return df


# Linear-time forms of PHI_PATTERNS for the JVM engine (same matches: a local part can only start where its run
# starts, so interior starts are cut by a lookbehind and the run is matched possessively); None = as written.
_FAST_FORMS = {"email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}
# A literal every match must contain: texts without it skip the pattern.
_REQUIRED = {"email": "@"}


def _literal_count(c: Column, lit: str) -> Column:
    return F.size(F.split(c, re.escape(lit), -1)) - 1


def redact_patterns_df(df: DataFrame, text_col: str, out_col: str, count_prefix: str = "n_") -> DataFrame:
    """Ordered pattern redaction as staged columns (one regex pass per pattern and row).

    Step i reads step i-1's text; its hit count is the number of placeholders
    the step added (placeholders contain ``<``/``>``, which no pattern matches,
    so a replacement never creates or destroys another one)."""
    prev = text_col
    for i, (name, pat, placeholder) in enumerate(PHI_PATTERNS):
        nxt = f"_redact_step{i}"
        src = F.col(prev)
        rep = F.regexp_replace(src, _FAST_FORMS.get(name, pat), placeholder)
        if name in _REQUIRED:
            rep = F.when(src.contains(_REQUIRED[name]), rep).otherwise(src)
        df = df.select("*", rep.alias(nxt))
        df = df.select("*", (_literal_count(F.col(nxt), placeholder) - _literal_count(F.col(prev), placeholder))
                       .cast("int").alias(f"{count_prefix}{name}"))
        if prev != text_col:
            df = df.drop(prev)
        prev = nxt
    return df.withColumnRenamed(prev, out_col)


def resume(df: DataFrame, target: str, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Go on with an interrupted run: ``process`` gets the rows whose target is still NULL, the others stay as they are.

    ``resumed`` tells them apart; columns that only ``process`` adds are NULL for the others.
    """
    todo, done = df.filter(F.col(target).isNull()), df.filter(F.col(target).isNotNull())
    return process(todo).withColumn("resumed", F.lit(False)).unionByName(done.withColumn("resumed", F.lit(True)), allowMissingColumns=True)


def relabel_newlines(c) -> Column:
    """Trimmed text with a newline inserted before ``Client:``/``Counselor:`` unless at the start or after one."""
    return F.regexp_replace(F.trim(col_(c)), r"(?<!^)(?<!\n)(Client:|Counselor:)", "\n$1")


def crosswalk(df: DataFrame, uid_col: str, ai_convo: bool) -> DataFrame:
    """(uid, ai_convo) rows for a de-identified export."""
    return df.select(uid_col, F.lit(bool(ai_convo)).alias("ai_convo"))


SPAN_SCHEMA = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                        T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))


Detector = Callable[[str], list[tuple[int, int, str, float]]]


def detect_spans(df: DataFrame, text_col: str, detector: Detector, out_col: str = "spans") -> DataFrame:
    """Run an injected detector (text -> [(start, end, label, score)], 0-based, end exclusive) over Arrow batches of the text alone."""

    @F.pandas_udf(SPAN_SCHEMA)
    def _detect(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": int(s), "end": int(e), "label": lab, "score": float(sc)} for s, e, lab, sc in detector(t)]
                          if isinstance(t, str) else [] for t in texts])

    return df.withColumn(out_col, _detect(col_(text_col)))


#: Tokens a detector takes at once, those at either end of a window that are there for context, and what a token is
#: (a piece of a word, or one other character; the same for the JVM and for Python).
WINDOW_TOKENS, CONTEXT_TOKENS = 510, 32
_JVM_TOKEN, _PY_TOKEN = r"(?U)[\p{L}\p{N}_]{1,50}|[^\p{L}\p{N}_\s]", r"\w{1,50}|[^\w\s]"


def _left_to_right(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans in order of their start (the longer first), without those that start before an earlier one has ended."""
    kept, pos = [], 0
    for start, end, label in sorted(spans, key=lambda x: (x[0], -x[1])):
        if start >= pos:
            kept.append((start, end, label))
            pos = max(end, start)
    return kept


def _replaced(text: str, spans: list[tuple[int, int, str]], placeholders: dict[str, str]) -> str:
    parts, pos = [], 0
    for start, end, label in spans:
        parts += (text[pos:start], placeholders.get(label, "<PHI>"))
        pos = end
    return "".join([*parts, text[pos:]])


def text_windows(texts: DataFrame, max_tokens: int = WINDOW_TOKENS, context: int = CONTEXT_TOKENS) -> DataFrame:
    """(key, text) -> (key, no, at, own_lo, own_hi, text): windows of at most ``max_tokens`` tokens, as rows spread over tasks.

    A window owns the code points from ``own_lo`` to ``own_hi`` of its text, which starts at ``at`` in the whole text;
    every code point has one owner. Up to ``context`` tokens of the neighbours stand on either side.
    """
    stride = max_tokens - 2 * context
    if stride < 1:
        raise ValueError("a window has no room beside its context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, names = re.compile(_PY_TOKEN), ["key", "no", "at", "own_lo", "own_hi", "text"]
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = np.fromiter((m.start() for m in token.finditer(text)), dtype=np.int64)
                rows = []
                for no, k in enumerate(range(0, max(len(starts), 1), stride)):
                    def begin(i):  # of token i; the first and the last window reach to the ends of the text
                        return 0 if i <= 0 else int(starts[i]) if i < len(starts) else len(text)
                    at = begin(k - context)
                    rows.append((key, no, at, begin(k), begin(k + stride), text[at:begin(k + stride + context)]))
                    if len(rows) == 256 or k + stride >= len(starts):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                        rows = []

    windows = texts.mapInArrow(run, "key string, no bigint, at bigint, own_lo bigint, own_hi bigint, text string")
    # a number of partitions, as few bytes would else be few tasks, and a detector is slow
    return windows.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "no")


def redact_spans(df: DataFrame, text_col: str, detector: Detector, out_col: str, n_col: str = "n_spans", threshold: float = SPAN_THRESHOLD,
                 placeholders: dict[str, str] | None = None, max_tokens: int = WINDOW_TOKENS, context: int = CONTEXT_TOKENS) -> DataFrame:
    """Detected spans of at least ``threshold`` replaced by their label's placeholder (unknown label -> <PHI>), and their number.

    The detector never sees more than ``max_tokens`` tokens. Texts that fit are detected and rewritten in one Arrow pass
    over the text alone, where they are. Longer ones become windows, spread over all tasks, equal texts once; a span
    counts where the window owns its start, so it is found once, with context on both sides, also across window
    ends. Spans of a text then apply from left to right; what starts inside an earlier span is left out. The result is
    that of the whole text for spans that a detector can tell from ``context`` tokens around their start.
    NULL texts stay NULL with 0 spans.
    """
    labels = dict(placeholders or ENTITY_PLACEHOLDER)

    @F.pandas_udf("text string, n int")
    def whole(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            spans = _left_to_right([(s, e, lab) for s, e, lab, sc in detector(t) if sc is not None and sc >= threshold]) if isinstance(t, str) else []
            out.append((_replaced(t, spans, labels) if spans else t, len(spans)))
        return pd.DataFrame(out, columns=["text", "n"])

    def of_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            spans, own = [], []
            for r in batch.to_pylist():
                found = [(r["at"] + s, r["at"] + e, lab) for s, e, lab, sc in detector(r["text"]) if sc is not None and sc >= threshold]
                spans.append([{"start": s, "end": e, "label": lab} for s, e, lab in found if r["own_lo"] <= s < r["own_hi"]])
                own.append(r["text"][r["own_lo"] - r["at"]:r["own_hi"] - r["at"]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.string()), pa.array(spans, kind)], names=["key", "no", "own", "spans"])

    def together(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("no")
        spans = _left_to_right([(x["start"], x["end"], x["label"]) for some in pieces["spans"] for x in some])
        return pd.DataFrame([(pieces["key"].iloc[0], _replaced("".join(pieces["own"]), spans, labels), len(spans))], columns=["key", "text", "n"])

    text, row = F.col("row." + text_col), F.struct(*[F.col(c) for c in df.columns]).alias("row")
    tokens = F.when(F.length(text_col) > max_tokens, F.regexp_count(F.col(text_col), F.lit(_JVM_TOKEN)))  # shorter ones have no more
    rows = df.select(row, (F.coalesce(tokens, F.lit(0)) > max_tokens).alias("long"))
    short = rows.where("NOT long").select("row", whole(text).alias("out"))
    long = rows.where("long").select("row", F.sha2(text, 256).alias("key"))
    windows = text_windows(long.select("key", text.alias("text")).dropDuplicates(["key"]), max_tokens, context)
    found = windows.mapInArrow(of_windows, "key string, no bigint, own string, spans array<struct<start:bigint,end:bigint,label:string>>")
    done = found.groupBy("key").applyInPandas(together, "key string, text string, n int").select("key", F.struct("text", "n").alias("out"))
    both = short.unionByName(long.join(done, "key").select("row", "out"))
    return both.select(*[F.col(f"row.{c}").alias(c) for c in df.columns if c not in (out_col, n_col)], F.col("out.text").alias(out_col), F.col("out.n").alias(n_col))


def apply_spans(text, spans, threshold: float = SPAN_THRESHOLD,
                placeholders: dict[str, str] | None = None) -> Column:
    """Replace detected spans scoring >= threshold with their label's placeholder (unknown label -> <PHI>).

    One left-to-right pass per text in an Arrow-batched pandas UDF: string
    offsets are code points, so slicing stays linear (a JVM ``overlay`` per
    span would copy and re-scan the text once per span)."""
    ph = dict(placeholders or ENTITY_PLACEHOLDER)

    @F.pandas_udf(T.StringType())
    def _apply(texts: pd.Series, spans_s: pd.Series) -> pd.Series:
        out = []
        for t, sp in zip(texts, spans_s):
            if t is None or sp is None:
                out.append(t)
                continue
            kept = sorted((x for x in sp if x["score"] is not None and x["score"] >= threshold), key=lambda x: x["start"])
            parts, pos = [], 0
            for x in kept:
                if x["start"] < pos:  # overlapping span: already covered
                    continue
                parts.append(t[pos:x["start"]])
                parts.append(ph.get(x["label"], "<PHI>"))
                pos = x["end"]
            parts.append(t[pos:])
            out.append("".join(parts))
        return pd.Series(out)

    return _apply(col_(text), col_(spans))


def regex_detector(text: str) -> list[tuple[int, int, str, float]]:
    """Deterministic stand-in detector: capitalised words -> PER (score grows with length), 4+ digit runs ->
    DATE (0.9), ``Inc``/``Ltd`` names -> ORG (0.8). Non-overlapping, left to right."""
    spans = []
    for m in re.finditer(r"\b[A-Z][a-z]+(?: (?:Inc|Ltd))\b|\b[A-Z][a-z]{2,}\b|\b\d{4,}\b", text):
        s = m.group(0)
        if s.endswith(("Inc", "Ltd")):
            spans.append((m.start(), m.end(), "ORG", 0.8))
        elif s[0].isdigit():
            spans.append((m.start(), m.end(), "DATE", 0.9))
        else:
            spans.append((m.start(), m.end(), "PER", min(1.0, len(s) / 10.0)))
    return spans


def union_annotations(first: DataFrame, second: DataFrame, second_skip: int, pos_col: str = "row_pos") -> DataFrame:
    """Concat two annotators' sheets; the second counts only from its row ``second_skip`` on."""
    return first.unionByName(second.filter(F.col(pos_col) >= second_skip), allowMissingColumns=True)


def accuracy_report(df: DataFrame, methods: list[str], error_col_fmt: str = "errors_{m}",
                    strict: bool = False) -> DataFrame:
    """Per method: correct = sum(label), total = all rows (NULL label = wrong), accuracy, and error-type counts
    among label-0 rows (comma split, lower-case substring match - 'age' also hits 'message', as in the reference;
    ``strict`` counts only items that start with ``<type> (``)."""
    rows = F.array(*[F.struct(F.lit(m).alias("eval"),
                              F.col(f"label_{m}").cast("string").try_cast("double").alias("label"),
                              F.col(error_col_fmt.format(m=m)).alias("errors")) for m in methods])
    long = df.select(F.inline(rows))
    err = F.transform(F.split(F.coalesce(F.col("errors"), F.lit("")), ","), lambda e: F.lower(F.trim(e)))
    def matches(t):  # one-argument predicate (F.filter passes the index to two-argument lambdas)
        return (lambda e: e.startswith(t + " (")) if strict else (lambda e: e.contains(t))

    counts = [F.sum(F.when(F.col("label") == 0, F.size(F.filter(err, matches(t)))).otherwise(0))
              .cast("bigint").alias(t) for t in ERROR_TYPES]
    agg = long.groupBy("eval").agg(
        F.coalesce(F.sum("label"), F.lit(0.0)).alias("n_messages_correct"),
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("label").isNull()).alias("n_unlabelled"), *counts)
    return agg.select("eval", *ERROR_TYPES, "n_messages_correct",
                      (F.col("n_total") - F.col("n_messages_correct")).alias("n_messages_incorrect"),
                      F.when(F.col("n_total") > 0, F.col("n_messages_correct") / F.col("n_total"))
                      .otherwise(F.lit(0.0)).alias("overall_accuracy"), "n_unlabelled")


__all__ = ["redact_names", "redact_extend", "redact_patterns_df", "resume", "relabel_newlines",
           "crosswalk", "detect_spans", "apply_spans", "redact_spans", "text_windows", "regex_detector", "union_annotations", "accuracy_report",
           "collapse_ws"]
