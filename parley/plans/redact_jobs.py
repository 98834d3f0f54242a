"""Redaction jobs: names, patterns with resume, spans, newline relabel, accuracy report."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from parley.functions.text import stable_id
from parley.operators import redact as rd
from parley.operators.conversation import render_transcript
from parley.plans import inputs
from parley.plans.registry import job


def _sql_extend(x: str) -> str:
    for _, pat in rd.EXTEND_PATTERNS:
        x = f"regexp_replace({x}, '{pat}', '<PHI>', 'g')"
    return x


_WORD = r"\p{L}\p{M}\p{Nd}\p{Pc}"
_ALTS = "|".join(sorted({re.escape(n) for n in inputs.FIXTURE_NAMES}, key=len, reverse=True))
_NAME_RE = rf"(^|[^{_WORD}])(?i:{_ALTS})([^{_WORD}]|$)"


def _sql_names(x: str) -> str:
    once = f"regexp_replace({x}, '{_NAME_RE}', '\\1[NAME]\\2', 'g')"
    return f"regexp_replace({once}, '{_NAME_RE}', '\\1[NAME]\\2', 'g')"


@job("redact_names", f"""
WITH r AS (SELECT doc_id, text, {_sql_extend(_sql_names('text'))} AS names_de_id_message FROM documents)
SELECT doc_id, names_de_id_message,
       CAST(len(regexp_extract_all(names_de_id_message, '\\[NAME\\]')) - len(regexp_extract_all(text, '\\[NAME\\]')) AS INTEGER) AS n_names
FROM r""")
def redact_names(spark, d):
    """Documents -> words on the name list replaced by [NAME] -> glued placeholder fragments swallowed."""
    docs = inputs.table(spark, d, "documents").select("doc_id", "text")
    red = rd.redact_names(docs, "text", inputs.name_list(spark), "names_de_id_message")
    red = rd.extend_column(red, "names_de_id_message")
    n = rd.count_token(F.col("names_de_id_message"), rd.NAME_TOKEN) - rd.count_token(F.col("text"), rd.NAME_TOKEN)
    return red.select("doc_id", "names_de_id_message", n.alias("n_names"))


@job("redact_names_table", rf"""
WITH n AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[{_WORD}]+')) AS w FROM benchmark) WHERE length(w) >= 9),
p AS (SELECT doc_id, r.i, r.p FROM (SELECT doc_id, regexp_extract_all(text, '[{_WORD}]+|[^{_WORD}]+') AS ps FROM documents) x,
             unnest(ps) WITH ORDINALITY AS r(p, i))
SELECT doc_id, string_agg(CASE WHEN n.w IS NOT NULL THEN '[NAME]' ELSE p.p END, '' ORDER BY p.i) AS redacted
FROM p LEFT JOIN n ON n.w = lower(p.p) GROUP BY doc_id""")
def redact_names_table(spark, d):
    """Documents with a list of thousands of names from a table (the long words of the benchmark items)."""
    docs = inputs.table(spark, d, "documents").select("doc_id", "text")
    listed = inputs.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0))).alias("name"))
    red = rd.redact_names(docs, "text", listed.where(F.length("name") >= 9), "redacted")
    return red.select("doc_id", "redacted")


def _sql_patterns():
    x = "message"
    counts = []
    for name, pat, ph in rd.PHI_PATTERNS:
        counts.append(f"CASE WHEN prior IS NULL THEN CAST(len(regexp_extract_all({x}, '{pat}')) AS INTEGER) END AS n_{name}")
        x = f"regexp_replace({x}, '{pat}', '{ph}', 'g')"
    return x, counts


_PX, _PC = _sql_patterns()


@job("redact_patterns", f"""
WITH m AS (
  SELECT d.doc_id AS index, d.text AS message,
         CASE WHEN l.toxic = 1 THEN 'previously redacted ' || CAST(d.doc_id AS VARCHAR) END AS prior
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT index, CASE WHEN prior IS NULL THEN {_sql_extend(_PX)} ELSE prior END AS patterns_de_id_message,
       (prior IS NOT NULL) AS resumed, {', '.join(_PC)}
FROM m""")
def redact_patterns(spark, d):
    """Messages -> ordered email / phone / id / date / age redaction (+ extend) only where the target is still empty."""
    counts = [f"n_{k}" for k, _, _ in rd.PHI_PATTERNS]

    def fresh(todo):
        red = rd.extend_column(rd.redact_patterns_df(todo, "message", "_red"), "_red")
        return red.select("index", "message", F.col("_red").alias("patterns_de_id_message"), *counts)

    out = rd.resume(inputs.deid_messages(spark, d).select("index", "message", "patterns_de_id_message"), "patterns_de_id_message", fresh)
    return out.select("index", "patterns_de_id_message", "resumed", *counts)


@job("relabel_newlines", """
WITH t AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Client: ' || text WHEN 'assistant' THEN 'Counselor: ' || text
                                            ELSE text END, ' ' ORDER BY turn) AS conversation
           FROM conversations GROUP BY conv_id)
SELECT conv_id, regexp_replace(trim(conversation), '([^\\n])(Client:|Counselor:)', '\\1' || chr(10) || '\\2', 'g') AS conversation
FROM t""")
def relabel_newlines(spark, d):
    """Transcripts whose lines were run together -> newline restored before every speaker label."""
    flat = render_transcript(inputs.turns(spark, d)).select("conv_id", "conversation")
    # the stand-in transcript is re-rendered with blanks between turns (as a redactor may return it)
    flat = (inputs.turns(spark, d).groupBy("conv_id")
            .agg(F.expr("listagg(CASE role WHEN 'user' THEN concat('Client: ', text) WHEN 'assistant' "
                        "THEN concat('Counselor: ', text) ELSE text END, ' ') WITHIN GROUP (ORDER BY turn)")
                 .alias("conversation"))) if flat is not None else flat
    return flat.select("conv_id", rd.relabel_newlines(F.col("conversation")).alias("conversation"))


_PY_WORD = r"\p{L}\p{N}_"


@job("redact_spans", rf"""
WITH p AS (
  SELECT doc_id, r.i, r.p, lead(r.p, 1) OVER w AS p1, lead(r.p, 2) OVER w AS p2
  FROM (SELECT doc_id, regexp_extract_all(text, '[{_PY_WORD}]+|[^{_PY_WORD}]+') AS ps FROM documents) x, unnest(ps) WITH ORDINALITY AS r(p, i)
  WINDOW w AS (PARTITION BY doc_id ORDER BY r.i)),
s AS (
  SELECT *, CASE WHEN regexp_full_match(p, '[A-Z][a-z]+') AND p1 = ' ' AND p2 IN ('Inc', 'Ltd') THEN '<ORGANIZATION>'
                 WHEN regexp_full_match(p, '[A-Z][a-z]{{4,}}') THEN '<PERSON>'
                 WHEN regexp_full_match(p, '\p{{Nd}}{{4,}}') THEN '<DATE_TIME>' END AS label FROM p),
t AS (SELECT *, coalesce(lag(label, 1) OVER w = '<ORGANIZATION>', false) OR coalesce(lag(label, 2) OVER w = '<ORGANIZATION>', false) AS inside
      FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, string_agg(CASE WHEN inside THEN '' ELSE coalesce(label, p) END, '' ORDER BY i) AS text,
             CAST(count(label) FILTER (NOT inside) AS INTEGER) AS n FROM t GROUP BY doc_id)
SELECT d.doc_id, {_sql_extend("coalesce(r.text, d.text)")} AS spans_de_id_message, coalesce(r.n, 0) AS n_spans
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id""")
def redact_spans(spark, d):
    """Documents -> injected span detector, over windows of 510 tokens of long ones -> spans >= 0.45 replaced -> extend."""
    docs = inputs.table(spark, d, "documents").select("doc_id", "text")
    return rd.extend_column(rd.redact_spans(docs, "text", rd.regex_detector, "spans_de_id_message").drop("text"), "spans_de_id_message")


@job("crosswalk", """
SELECT DISTINCT sha256(CAST(conv_id AS VARCHAR)) AS uid, conv_id % 2 = 0 AS ai_convo FROM conversations""")
def crosswalk(spark, d):
    """De-identified exports of two kinds -> (uid, whether the counselor was a model), one row per conversation."""
    convs = inputs.table(spark, d, "conversations").select("conv_id").distinct().withColumn("uid", stable_id("conv_id"))
    return rd.crosswalk(convs.where("conv_id % 2 = 0"), "uid", True).unionByName(rd.crosswalk(convs.where("conv_id % 2 <> 0"), "uid", False))


def _sql_err(m):
    return (f"coalesce(sum(CASE WHEN label_{m} = 0 THEN len(list_filter(list_transform(string_split(coalesce(errors_{m}, ''), ','), "
            "lambda e: lower(trim(e))), lambda e: contains(e, '{t}'))) ELSE 0 END), 0)")


_ERRTEXT = ("CASE WHEN concat_ws(', ', CASE WHEN contains(text, '@') THEN 'email (address)' END, "
            "CASE WHEN regexp_matches(text, '\\d{9,}') THEN 'other_id (number)' END, "
            "CASE WHEN lang = 'de' THEN 'name (Hans)' END, CASE WHEN n_chars > 5000 THEN 'age (long message)' END) = '' "
            "THEN 'none' ELSE concat_ws(', ', CASE WHEN contains(text, '@') THEN 'email (address)' END, "
            "CASE WHEN regexp_matches(text, '\\d{9,}') THEN 'other_id (number)' END, "
            "CASE WHEN lang = 'de' THEN 'name (Hans)' END, CASE WHEN n_chars > 5000 THEN 'age (long message)' END) END")


def _sql_report():
    per = []
    for m in ("patterns", "names"):
        errs = ", ".join(f"CAST({_sql_err(m).format(t=t)} AS BIGINT) AS {t}" for t in rd.ERROR_TYPES)
        per.append(f"""SELECT '{m}' AS eval, {errs}, coalesce(sum(label_{m}), 0.0) AS n_messages_correct,
       count(*) - coalesce(sum(label_{m}), 0.0) AS n_messages_incorrect,
       CASE WHEN count(*) > 0 THEN coalesce(sum(label_{m}), 0.0) / count(*) ELSE 0.0 END AS overall_accuracy,
       CAST(count_if(label_{m} IS NULL) AS BIGINT) AS n_unlabelled FROM data""")
    return "\nUNION ALL\n".join(per)


@job("redaction_report", f"""
WITH j AS (
  SELECT l.doc_id, l.quality, l.toxic, l.rn - 1 AS row_pos, d.text, d.lang, d.n_chars
  FROM (SELECT *, row_number() OVER () AS rn FROM labels) l JOIN documents d USING (doc_id)),
first AS (SELECT doc_id AS index, row_pos, TRY_CAST(CAST(quality AS VARCHAR) AS DOUBLE) AS label_patterns,
                 {_ERRTEXT} AS errors_patterns FROM j),
fs AS (SELECT * FROM first WHERE row_pos < 200 UNION ALL SELECT * FROM first WHERE row_pos >= 200),
second AS (SELECT doc_id AS index, TRY_CAST(CAST(1 - toxic AS VARCHAR) AS DOUBLE) AS label_names, {_ERRTEXT} AS errors_names
           FROM j WHERE toxic IS NOT NULL),
data AS (SELECT fs.*, s.label_names, s.errors_names FROM fs LEFT JOIN second s USING (index)
         WHERE fs.label_patterns IS NOT NULL AND fs.index IN (SELECT doc_id FROM documents))
{_sql_report()}""")
def redaction_report(spark, d):
    """Two annotators' sheets (second from row 200 on) + a second method's sheet -> accuracy and error types
    per method, over annotated rows whose message exists."""
    a1, a2, second = inputs.annotation_sheets(spark, d)
    first = rd.union_annotations(a1, a2, 200).filter(F.col("label_patterns").isNotNull()).drop("Notes")
    second = second.filter(F.col("label_names").isNotNull())
    data = first.join(second.select("index", "label_names", "errors_names"), "index", "left")
    docs = inputs.table(spark, d, "documents").select(F.col("doc_id").alias("index"))
    data = data.join(docs, "index", "left_semi")
    return rd.accuracy_report(data, ["patterns", "names"])
