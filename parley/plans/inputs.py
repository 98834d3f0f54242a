"""Stand-in inputs: fixture tables reshaped into the record shapes the jobs read.

These functions only rename, retype and re-encode fixture columns into the
canonical schemas (transcripts, message logs, judge replies, traces, ...).
They do none of a job's work; every job runs its operators on whatever rows
of that schema it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators.conversation import render_transcript
from parley.sources.tables import table


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conversations(conv_id, turn, role, text): user = client/patient, assistant = counselor."""
    return table(spark, d, "conversations")


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, conversation): one newline transcript per conversation, ``Client:``/``Counselor:`` lines."""
    return render_transcript(turns(spark, d))


def message_log(spark: SparkSession, d: str) -> DataFrame:
    """Raw message-log shape (ID, Ticket_ID, Agent_ID, Sent_Date_And_Time, Thread_Content) from orders."""
    o = table(spark, d, "orders")
    agent = (F.when(F.col("o_orderstatus") == "F", F.lit(None).cast("string"))
             .when(F.col("o_orderstatus") == "O", F.lit("None"))
             .otherwise(F.col("o_orderpriority")))
    return o.select(
        F.col("o_orderkey").alias("ID"),
        F.col("o_custkey").alias("Ticket_ID"),
        agent.alias("Agent_ID"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Sent_Date_And_Time"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("Thread_Content"),
    )


# ---------------------------------------------------------------- judge replies
# Comparison-judge categories (same list as parley.operators.scores).
from parley.operators.scores import (EMOTIONAL_KEYS, LINGUISTIC_KEYS, RUBRIC_PREFIX,  # noqa: E402
                                     RUBRIC_WEIGHTS, SCORE_CATEGORIES, TRAIT_KEY)


def _doc_labels(spark, d, how="left"):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id", how)


def comparison_replies(spark: SparkSession, d: str) -> DataFrame:
    """Judge replies (uid, input_file_name, comparison_json) in the three shapes the reference meets:
    plain JSON, fenced JSON (toxic = 1), a chat-completion envelope (lang de) and broken text (es, quality 0)."""
    fields = []
    for i, cat in enumerate(SCORE_CATEGORIES):
        score = ((F.col("doc_id") * (i + 3) + F.col("n_chars")) % 5 + 1).cast("int")
        if i == len(SCORE_CATEGORIES) - 1:
            score = F.when(F.col("quality").isNotNull(), score)
        fields.append(F.struct(score.alias("score"), F.concat(F.lit(cat + " "), "lang").alias("justification")).alias(cat))
    js = F.to_json(F.struct(*fields))
    envelope = F.to_json(F.struct(F.array(F.struct(F.struct(js.alias("content")).alias("message"))).alias("choices")))
    reply = (F.when(F.col("toxic") == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
             .when(F.col("lang") == "de", envelope)
             .when((F.col("lang") == "es") & (F.col("quality") == 0), F.concat(F.lit("not json: "), js))
             .otherwise(js))
    return _doc_labels(spark, d).select(
        F.col("doc_id").cast("string").alias("uid"),
        F.concat_ws("|", F.lit("comparison"), "lang", "source").alias("input_file_name"),
        reply.alias("comparison_json"))


def _sql_json_scores():
    parts = []
    for i, cat in enumerate(SCORE_CATEGORIES):
        score = f"CAST(((doc_id * {i + 3} + n_chars) % 5 + 1) AS INTEGER)"
        if i == len(SCORE_CATEGORIES) - 1:
            score = f"CASE WHEN quality IS NOT NULL THEN {score} END"
        parts.append(f"'{cat}', json_object('score', {score}, 'justification', '{cat} ' || lang)")
    return "json_object(" + ", ".join(parts) + ")::VARCHAR"


COMPARISON_REPLIES_SQL = f"""
replies AS (
  SELECT CAST(doc_id AS VARCHAR) AS uid, concat_ws('|', 'comparison', lang, source) AS input_file_name,
         CASE WHEN toxic = 1 THEN '```json' || chr(10) || js || chr(10) || '```'
              WHEN lang = 'de' THEN json_object('choices', json_array(json_object('message', json_object('content', js))))::VARCHAR
              WHEN lang = 'es' AND quality = 0 THEN 'not json: ' || js
              ELSE js END AS comparison_json
  FROM (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, {_sql_json_scores()} AS js
        FROM documents d LEFT JOIN labels l USING (doc_id))
)"""

# Eval families and their sub-keys as the multi-turn judge returns them.
BIG_FIVE = ["openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism"]
LANG_SUBKEYS = [k.split(".", 1)[1] for k in LINGUISTIC_KEYS]
EMO_SUBKEYS = [k.split(".", 1)[1] for k in EMOTIONAL_KEYS]


def _family_struct(name, keys, offset):
    return F.struct(*[F.struct(((F.col("doc_id") + (offset + k) * 7 + F.col("n_chars")) % 5 + 1).cast("int").alias("score"),
                               F.lit(f"{key} rationale").alias("rationale")).alias(key)
                      for k, key in enumerate(keys)]).alias(name)


def eval_documents(spark: SparkSession, d: str) -> DataFrame:
    """(file_name, doc_json): one patient-eval document per labelled document."""
    pc = F.struct(((F.col("doc_id") + F.col("n_chars")) % 5 + 1).cast("int").alias("score"),
                  F.lit("concern rationale").alias("rationale")).alias("presenting_concern")
    simple = F.when(F.col("quality") == 1, F.struct(((F.col("doc_id") * 3) % 5 + 1).cast("int").alias("score"),
                                                    F.lit("simple").alias("rationale"))).alias("big_five_traits_simple")
    doc = F.to_json(F.struct(_family_struct("big_five_traits", BIG_FIVE, 0),
                             _family_struct("language_patterns", LANG_SUBKEYS, 5),
                             _family_struct("emotional_realism", EMO_SUBKEYS, 8), pc, simple))
    return _doc_labels(spark, d, "inner").select(
        F.concat(F.lit("dialogue_"), F.col("doc_id").cast("string"), F.lit(".jsonl")).alias("file_name"),
        doc.alias("doc_json"))


def _sql_family(name, keys, offset):
    inner = ", ".join(f"'{key}', json_object('score', CAST((doc_id + {(offset + k) * 7} + n_chars) % 5 + 1 AS INTEGER), "
                      f"'rationale', '{key} rationale')" for k, key in enumerate(keys))
    return f"'{name}', json_object({inner})"


EVAL_DOCUMENTS_SQL = f"""
evals AS (
  SELECT 'dialogue_' || CAST(doc_id AS VARCHAR) || '.jsonl' AS file_name,
         json_object({_sql_family('big_five_traits', BIG_FIVE, 0)}, {_sql_family('language_patterns', LANG_SUBKEYS, 5)},
                     {_sql_family('emotional_realism', EMO_SUBKEYS, 8)},
                     'presenting_concern', json_object('score', CAST((doc_id + n_chars) % 5 + 1 AS INTEGER), 'rationale', 'concern rationale'),
                     'big_five_traits_simple', CASE WHEN quality = 1 THEN json_object('score', CAST((doc_id * 3) % 5 + 1 AS INTEGER), 'rationale', 'simple') END
         ) AS doc_json
  FROM documents d JOIN labels l USING (doc_id)
)"""


# ---------------------------------------------------------------- traces and scores
def _category(lang, source):
    return (F.when(source.isin("src0", "src1"), F.lit("Relationship"))
            .when(lang == "en", F.lit("suicidality"))
            .when(lang == "fr", F.lit("Depression"))
            .when(lang == "de", F.lit("grief")))


def traces(spark: SparkSession, d: str) -> DataFrame:
    """Trace export (trace_id, name, tags, category, run_name, turn_count, latency), one per document."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.select(
        F.col("doc_id").alias("trace_id"), F.lit("generated-conversation").alias("name"),
        F.array(F.concat(F.lit("docs-"), "lang", F.lit("/eval-run")), F.concat(F.lit("src/"), "source")).alias("tags"),
        _category(F.col("lang"), F.col("source")).alias("category"),
        F.lit("eval-run").alias("run_name"),
        (F.col("n_chars") % 9).alias("turn_count"),
        (F.col("n_chars") / 100.0).alias("latency"))


TRACES_SQL = """
traces AS (
  SELECT doc_id AS trace_id, 'generated-conversation' AS name,
         ['docs-' || lang || '/eval-run', 'src/' || source] AS tags,
         CASE WHEN source IN ('src0', 'src1') THEN 'Relationship' WHEN lang = 'en' THEN 'suicidality'
              WHEN lang = 'fr' THEN 'Depression' WHEN lang = 'de' THEN 'grief' END AS category,
         'eval-run' AS run_name, n_chars % 9 AS turn_count, n_chars / 100.0 AS latency
  FROM documents
)"""

RUBRIC_ITEMS = [k for k in RUBRIC_WEIGHTS if k != "P7"]  # the judge never returns P7


def rubric_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score log (trace_id, name, value STRING, ts) of rubric items, with an overwritten X0."""
    rows = []
    for i, item in enumerate(RUBRIC_ITEMS):
        if item == "X0":
            v = F.when(F.col("quality") == 1, F.lit("yes")).otherwise(F.lit("0"))
        elif item == "P5":
            v = F.when(F.col("toxic") == 1, F.lit("NA")).otherwise(F.lit("true"))
        else:
            m = (F.col("doc_id") + i) % 4
            v = (F.when(m == 0, F.lit("false")).when(m == 1, F.lit("true")).when(m == 2, F.lit("1.0"))
                 .otherwise(F.lit("NA")))
        rows.append(F.struct(F.lit(RUBRIC_PREFIX + item).alias("name"), v.alias("value"), F.lit(100 + i).alias("ts")))
    stale = F.struct(F.lit(RUBRIC_PREFIX + "X0").alias("name"),
                     F.when(F.col("quality") == 1, F.lit("false")).otherwise(F.lit("true")).alias("value"),
                     F.lit(1).alias("ts"))
    return _doc_labels(spark, d, "inner").select(F.col("doc_id").alias("trace_id"), F.inline(F.array(stale, *rows)))


def _sql_rubric_rows():
    rows = [f"{{'name': '{RUBRIC_PREFIX}X0', 'value': CASE WHEN quality = 1 THEN 'false' ELSE 'true' END, 'ts': 1}}"]
    for i, item in enumerate(RUBRIC_ITEMS):
        if item == "X0":
            v = "CASE WHEN quality = 1 THEN 'yes' ELSE '0' END"
        elif item == "P5":
            v = "CASE WHEN toxic = 1 THEN 'NA' ELSE 'true' END"
        else:
            v = (f"CASE (doc_id + {i}) % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 2 THEN '1.0' ELSE 'NA' END")
        rows.append(f"{{'name': '{RUBRIC_PREFIX}{item}', 'value': {v}, 'ts': {100 + i}}}")
    return "[" + ", ".join(rows) + "]"


RUBRIC_SCORES_SQL = f"""
scores AS (
  SELECT trace_id, r.name AS name, r.value AS value, r.ts AS ts
  FROM (SELECT doc_id AS trace_id, unnest({_sql_rubric_rows()}) AS r FROM documents JOIN labels USING (doc_id))
)"""

REALISM_KEYS = LINGUISTIC_KEYS + EMOTIONAL_KEYS + [TRAIT_KEY]


def realism_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score log (trace_id, name, value, ts) of realism keys; toxic documents miss the emotional keys."""
    rows = []
    for k, key in enumerate(REALISM_KEYS):
        v = ((F.col("doc_id") + k + F.col("n_chars")) % 3 + 1).cast("string")
        if key in EMOTIONAL_KEYS:
            v = F.when(F.col("toxic") == 0, v)
        rows.append(F.struct(F.lit(key).alias("name"), v.alias("value"), F.lit(k).alias("ts")))
    return _doc_labels(spark, d, "inner").select(F.col("doc_id").alias("trace_id"), F.inline(F.array(*rows)))


def _sql_realism_rows():
    rows = []
    for k, key in enumerate(REALISM_KEYS):
        v = f"CAST((doc_id + {k} + n_chars) % 3 + 1 AS VARCHAR)"
        if key in EMOTIONAL_KEYS:
            v = f"CASE WHEN toxic = 0 THEN {v} END"
        rows.append(f"{{'name': '{key}', 'value': {v}, 'ts': {k}}}")
    return "[" + ", ".join(rows) + "]"


REALISM_SCORES_SQL = f"""
scores AS (
  SELECT trace_id, r.name AS name, r.value AS value, r.ts AS ts
  FROM (SELECT doc_id AS trace_id, unnest({_sql_realism_rows()}) AS r FROM documents JOIN labels USING (doc_id))
)"""


# ---------------------------------------------------------------- patient summaries
def patient_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Patient-summary JSON lines ``{name: {age, gender, presenting_concern}}`` from customers."""
    c = table(spark, d, "customer")
    age = F.when(F.col("c_acctbal") >= 0, 10 + F.col("c_custkey") % 95)
    g = F.col("c_nationkey") % 4
    gender = F.when(g == 0, F.lit("male")).when(g == 1, F.lit("Male")).when(g == 2, F.lit("female"))
    details = F.struct(age.alias("age"), gender.alias("gender"), F.col("c_mktsegment").alias("presenting_concern"))
    return c.select(F.to_json(F.create_map(F.col("c_name"), details)).alias("line"))


PATIENT_SUMMARIES_SQL = """
patients AS (
  SELECT json_object(c_name, json_object(
           'age', CASE WHEN c_acctbal >= 0 THEN 10 + c_custkey % 95 END,
           'gender', CASE c_nationkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'Male' WHEN 2 THEN 'female' END,
           'presenting_concern', c_mktsegment))::VARCHAR AS line
  FROM customer
)"""


# ---------------------------------------------------------------- free-text judge replies
# Fixed values for the fixture: which eval each language plays and the rubric items it returns.
JUDGE_EVALS = {"en": "counselor-eval-rubric", "fr": "realism", "de": "presenting_concern", "es": "unit-tests"}
RUBRIC_REPLY_ITEMS = ["P1", "P2", "P5", "M1", "S3", "X0", "X1", "X2"]


def _bit(k):
    return ((F.col("doc_id") + k) % 2) == 0


def judge_replies(spark: SparkSession, d: str) -> DataFrame:
    """(trace_id, source_trace_id, eval_name, model, raw): judge reply text per labelled document.

    Bodies: rubric booleans with an "NA" and group justifications (en), nested
    metric objects (fr), one top-level score (de), scalar strings/numbers (es).
    Wrappers: fenced (toxic), prose around the JSON (quality 0), cut-off JSON
    (n_chars divisible by 13), else bare.
    """
    dl = _doc_labels(spark, d, "inner")
    rubric = F.to_json(F.struct(*[
        (F.when(F.col("toxic") == 1, F.lit("NA")).otherwise(F.lit("true")) if it == "P5"
         else (F.col("quality") == 1) if it == "X0" else _bit(i)).alias(it)
        for i, it in enumerate(RUBRIC_REPLY_ITEMS)],
        F.concat(F.lit("P group "), F.col("source")).alias("P_justification"),
        F.array(F.lit("crisis")).alias("case_categorization")))
    realism = F.to_json(F.struct(
        F.struct((F.col("n_chars") % 5 + 1).alias("score"), F.lit("lp ok").alias("rationale")).alias("language_patterns"),
        F.struct((F.col("doc_id") % 5 + 1).alias("score"), F.lit("er ok").alias("justification")).alias("emotional_realism"),
        F.struct((F.col("doc_id") % 3 + 1).alias("score")).alias("realism.overall")))
    single = F.to_json(F.struct((F.col("doc_id") % 4 + 1).alias("score"), F.lit("fits").alias("rationale")))
    scalars = F.to_json(F.struct(F.concat(F.lit(""), (F.col("doc_id") % 5).cast("string")).alias("questions"),
                                 (F.col("n_chars") / 1000.0).alias("pacing"),
                                 F.lit("p text").alias("P_justification"), F.lit("n/a").alias("notes")))
    body = (F.when(F.col("lang") == "en", rubric).when(F.col("lang") == "fr", realism)
            .when(F.col("lang") == "de", single).otherwise(scalars))
    raw = (F.when(F.col("n_chars") % 13 == 0, F.expr("substring(_b, 1, length(_b) - 1)"))
           .when(F.col("toxic") == 1, F.concat(F.lit("```json\n"), F.col("_b"), F.lit("\n```")))
           .when(F.col("quality") == 0, F.concat(F.lit("Evaluation follows:\n"), F.col("_b"), F.lit("\nThanks")))
           .otherwise(F.col("_b")))
    ev = F.when(F.col("lang") == "en", F.lit(JUDGE_EVALS["en"])).when(F.col("lang") == "fr", F.lit(JUDGE_EVALS["fr"])) \
        .when(F.col("lang") == "de", F.lit(JUDGE_EVALS["de"])).otherwise(F.lit(JUDGE_EVALS["es"]))
    return (dl.withColumn("_b", body)
            .select((F.col("doc_id") + 1000000).alias("trace_id"),
                    F.when(F.col("toxic") == 0, F.col("doc_id")).alias("source_trace_id"),
                    ev.alias("eval_name"), F.col("source").alias("model"), raw.alias("raw")))


def _sql_judge_bodies():
    items = []
    for i, it in enumerate(RUBRIC_REPLY_ITEMS):
        if it == "P5":
            v = "CASE WHEN toxic = 1 THEN 'NA' ELSE 'true' END"
        elif it == "X0":
            v = "(quality = 1)"
        else:
            v = f"((doc_id + {i}) % 2 = 0)"
        items.append(f"'{it}', {v}")
    rubric = ("json_object(" + ", ".join(items) + ", 'P_justification', 'P group ' || source, "
              "'case_categorization', ['crisis'])::VARCHAR")
    realism = ("json_object('language_patterns', json_object('score', n_chars % 5 + 1, 'rationale', 'lp ok'), "
               "'emotional_realism', json_object('score', doc_id % 5 + 1, 'justification', 'er ok'), "
               "'realism.overall', json_object('score', doc_id % 3 + 1))::VARCHAR")
    single = "json_object('score', doc_id % 4 + 1, 'rationale', 'fits')::VARCHAR"
    scalars = ("json_object('questions', CAST(doc_id % 5 AS VARCHAR), 'pacing', n_chars / 1000.0, "
               "'P_justification', 'p text', 'notes', 'n/a')::VARCHAR")
    return (f"CASE lang WHEN 'en' THEN {rubric} WHEN 'fr' THEN {realism} WHEN 'de' THEN {single} "
            f"ELSE {scalars} END")


JUDGE_REPLIES_SQL = f"""
judge AS (
  SELECT doc_id + 1000000 AS trace_id, CASE WHEN toxic = 0 THEN doc_id END AS source_trace_id,
         CASE lang WHEN 'en' THEN '{JUDGE_EVALS['en']}' WHEN 'fr' THEN '{JUDGE_EVALS['fr']}'
                   WHEN 'de' THEN '{JUDGE_EVALS['de']}' ELSE '{JUDGE_EVALS['es']}' END AS eval_name,
         source AS model,
         CASE WHEN n_chars % 13 = 0 THEN substr(b, 1, length(b) - 1)
              WHEN toxic = 1 THEN '```json' || chr(10) || b || chr(10) || '```'
              WHEN quality = 0 THEN 'Evaluation follows:' || chr(10) || b || chr(10) || 'Thanks'
              ELSE b END AS raw
  FROM (SELECT *, {_sql_judge_bodies()} AS b FROM documents JOIN labels USING (doc_id))
)"""


# ---------------------------------------------------------------- completion JSONL lines
def completion_lines(spark: SparkSession, d: str) -> DataFrame:
    """(file_name, line_no, line) completion JSONL from conversation turns (see :func:`completion_lines_from`)."""
    return completion_lines_from(turns(spark, d))


def completion_lines_from(t: DataFrame) -> DataFrame:
    """(file_name, line_no, line) completion JSONL from conversation turns (row-local; works on streams).

    assistant turns: flat shape (odd turns; uid dropped when turn = 1) or the
    3-element array shape (chat choices; Gemini candidates when conv_id is a
    multiple of 5); user turns: failure shape when turn = 2, else a line that
    is not JSON; system turns: blank lines.
    """
    uid = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    meta = F.struct(uid.alias("uid"), F.lit("tmpl_a").alias("prompt_template_name"),
                    F.concat(F.lit("in|model-"), (F.col("conv_id") % 3).cast("string")).alias("input_file_name"))
    request = F.struct(F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))).alias("messages"))
    flat = F.to_json(F.struct(F.lit("p").alias("prompt"), F.col("text").alias("completion"),
                              F.when(F.col("turn") != 1, uid).alias("uid"),
                              F.lit("tmpl_b").alias("prompt_template_name"),
                              F.concat(F.lit("in|model-"), (F.col("conv_id") % 3).cast("string")).alias("input_file_name")))
    chat = F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))
    gem = F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("text").alias("text")),
                                                      F.struct(F.lit(" (end)").alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    arr = F.concat(F.lit("["), F.to_json(request), F.lit(","),
                   F.when(F.col("conv_id") % 5 == 0, F.to_json(gem)).otherwise(F.to_json(chat)), F.lit(","),
                   F.to_json(F.struct(meta.alias("metadata"))), F.lit("]"))
    failed = F.concat(F.lit("["), F.to_json(request), F.lit(",[\"rate limit\",\"timeout\"],"),
                      F.to_json(F.struct(meta.alias("metadata"))), F.lit("]"))
    line = (F.when(F.col("role") == "system", F.lit(""))
            .when((F.col("role") == "assistant") & (F.col("turn") % 2 == 1), flat)
            .when(F.col("role") == "assistant", arr)
            .when(F.col("turn") == 2, failed)
            .otherwise(F.concat(F.lit("not json: "), F.col("text"))))
    return t.select(F.concat(F.lit("completions_"), (F.col("conv_id") % 4).cast("string"), F.lit(".jsonl")).alias("file_name"),
                    (F.col("conv_id") * 100 + F.col("turn")).alias("line_no"), line.alias("line"))


COMPLETION_LINES_SQL = """
clines AS (
  SELECT 'completions_' || CAST(conv_id % 4 AS VARCHAR) || '.jsonl' AS file_name, conv_id * 100 + turn AS line_no,
    CASE WHEN role = 'system' THEN ''
         WHEN role = 'assistant' AND turn % 2 = 1 THEN
           json_object('prompt', 'p', 'completion', text, 'uid', CASE WHEN turn <> 1 THEN 'c' || conv_id || '-' || turn END,
                       'prompt_template_name', 'tmpl_b', 'input_file_name', 'in|model-' || CAST(conv_id % 3 AS VARCHAR))::VARCHAR
         WHEN role = 'assistant' THEN
           json_array(json_object('messages', [json_object('role', 'user', 'content', 'hi')]),
                      CASE WHEN conv_id % 5 = 0
                           THEN json_object('candidates', [json_object('content', json_object('parts', [json_object('text', text), json_object('text', ' (end)')]))])
                           ELSE json_object('choices', [json_object('message', json_object('content', text))]) END,
                      json_object('metadata', json_object('uid', 'c' || conv_id || '-' || turn, 'prompt_template_name', 'tmpl_a',
                                                          'input_file_name', 'in|model-' || CAST(conv_id % 3 AS VARCHAR))))::VARCHAR
         WHEN turn = 2 THEN
           json_array(json_object('messages', [json_object('role', 'user', 'content', 'hi')]), ['rate limit', 'timeout'],
                      json_object('metadata', json_object('uid', 'c' || conv_id || '-' || turn, 'prompt_template_name', 'tmpl_a',
                                                          'input_file_name', 'in|model-' || CAST(conv_id % 3 AS VARCHAR))))::VARCHAR
         ELSE 'not json: ' || text END AS line
  FROM conversations
)"""


# ---------------------------------------------------------------- dialogue eval files
def dialogue_eval_files(spark: SparkSession, d: str) -> DataFrame:
    """(file_name, line_no, text): 3-line dialogue eval files, one per labelled document.

    Name ``dialogue|<dlg>_x_<concern>_<n>|<counselor>|<editor>|<model>|<timestamp>.jsonl``;
    toxic documents get a name without the timestamp part (malformed) and
    non-toxic documents of quality 0 lose their third line.
    """
    dl = _doc_labels(spark, d, "inner")
    name = F.concat_ws("|", F.lit("dialogue"),
                       F.concat(F.lit("dlg"), F.col("doc_id").cast("string"), F.lit("_x_"), F.col("lang"), F.lit("_"),
                                (F.col("doc_id") % 7).cast("string")),
                       F.lit("cp1"), F.lit("ed0"), F.col("source"),
                       F.when(F.col("toxic") == 0, F.lit("20240101T0000.jsonl")))
    name = F.when(F.col("toxic") == 0, name).otherwise(F.concat(name, F.lit(".jsonl")))
    pe = F.to_json(F.struct(F.struct((F.col("doc_id") % 5 + 1).alias("score"), F.lit("ok").alias("rationale")).alias("big_five_traits_simple"),
                            F.struct((F.col("n_chars") % 5 + 1).alias("score"), F.lit("ok").alias("rationale")).alias("presenting_concern")))
    ut = F.to_json(F.struct(
        F.struct((F.col("doc_id") % 3).alias("n_question_messages"), F.lit("q").alias("rationale")).alias("questions"),
        F.struct((F.col("quality") == 1).alias("build_rapport"), F.lit("").alias("rationale"),
                 F.lit("rapport expl").alias("explanation")).alias("rapport"),
        F.struct(F.lit(1).alias("unsafe_behavior")).alias("unsafe"),
        F.lit("skip me").alias("note")))
    ce = F.to_json(F.struct(F.struct((F.col("doc_id") % 4 + 1).alias("score"), F.lit("emp").alias("rationale")).alias("empathy")))
    lines = F.array(F.struct(F.lit(0).alias("line_no"), pe.alias("text")),
                    F.struct(F.lit(1).alias("line_no"), ut.alias("text")),
                    F.struct(F.lit(2).alias("line_no"), ce.alias("text")))
    short = (F.col("quality") == 0) & (F.col("toxic") == 0) & (F.col("line_no") == 2)
    return (dl.select(name.alias("file_name"), "quality", "toxic", F.inline(lines))
            .filter(~short).drop("quality", "toxic"))


DIALOGUE_EVAL_FILES_SQL = """
efiles AS (
  SELECT file_name, r.line_no AS line_no, r.text AS text
  FROM (
    SELECT CASE WHEN toxic = 0
                THEN concat_ws('|', 'dialogue', 'dlg' || doc_id || '_x_' || lang || '_' || CAST(doc_id % 7 AS VARCHAR),
                               'cp1', 'ed0', source, '20240101T0000.jsonl')
                ELSE concat_ws('|', 'dialogue', 'dlg' || doc_id || '_x_' || lang || '_' || CAST(doc_id % 7 AS VARCHAR),
                               'cp1', 'ed0', source) || '.jsonl' END AS file_name,
           quality, toxic,
           unnest([
             {'line_no': 0, 'text': json_object('big_five_traits_simple', json_object('score', doc_id % 5 + 1, 'rationale', 'ok'),
                                                'presenting_concern', json_object('score', n_chars % 5 + 1, 'rationale', 'ok'))::VARCHAR},
             {'line_no': 1, 'text': json_object('questions', json_object('n_question_messages', doc_id % 3, 'rationale', 'q'),
                                                'rapport', json_object('build_rapport', quality = 1, 'rationale', '', 'explanation', 'rapport expl'),
                                                'unsafe', json_object('unsafe_behavior', 1),
                                                'note', 'skip me')::VARCHAR},
             {'line_no': 2, 'text': json_object('empathy', json_object('score', doc_id % 4 + 1, 'rationale', 'emp'))::VARCHAR}]) AS r
    FROM documents JOIN labels USING (doc_id))
  WHERE NOT (quality = 0 AND toxic = 0 AND r.line_no = 2)
)"""


# ---------------------------------------------------------------- prompt rows, items and completions
def benchmark_rows(spark: SparkSession, d: str) -> DataFrame:
    """Input rows for prompting: (item_id, text, file_name, row_index) - file name and position from the scan."""
    return table(spark, d, "benchmark").select("item_id", "text", F.col("_metadata.file_name").alias("file_name"),
                                               F.col("_metadata.row_index").alias("row_index"))


def _turn_uid():
    return F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256)


def with_history(t: DataFrame) -> DataFrame:
    """Turns with ``convo_history``: the texts of all turns before, one a line (NULL for the first)."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list("text").over(before)
    return t.withColumn("convo_history", F.when(F.size(earlier) > 0, F.array_join(earlier, "\n")))


HISTORY_SQL = """(SELECT *, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING
       AND 1 PRECEDING) AS history FROM conversations)"""


def static_items(spark: SparkSession, d: str) -> DataFrame:
    """Static eval items (uid, conversation_id, convo_history, counselor_message): each assistant turn with
    all turns before it as history."""
    t = with_history(turns(spark, d))
    a = t.filter(F.col("role") == "assistant")
    return a.select(_turn_uid().alias("uid"), F.col("conv_id").alias("conversation_id"),
                    F.coalesce("convo_history", F.lit("")).alias("convo_history"),
                    F.col("text").alias("counselor_message"))


STATIC_ITEMS_SQL = f"""
items AS (
  SELECT sha256(concat_ws(':', CAST(a.conv_id AS VARCHAR), CAST(a.turn AS VARCHAR))) AS uid, a.conv_id AS conversation_id,
         coalesce(a.history, '') AS convo_history, a.text AS counselor_message
  FROM {HISTORY_SQL} a
  WHERE a.role = 'assistant'
)"""


def completion_frames(spark: SparkSession, d: str) -> list[DataFrame]:
    """Two completion files: model-a (every counselor turn; chat JSON, some plain text) and model-b (every turn,
    user turns being completions without an item; carries an extra prompt_template_name column)."""
    t = turns(spark, d).filter(F.col("role").isin("user", "assistant"))
    chat = lambda content: F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message")))
                                              .alias("choices")))
    a = (t.filter(F.col("role") == "assistant")
         .select(_turn_uid().alias("uid"),
                 F.when(F.col("conv_id") % 4 == 0, F.col("text"))
                 .otherwise(chat(F.concat(F.lit("  "), F.col("text"), F.lit(" ")))).alias("llm_output_json_raw"),
                 F.lit("model-a").alias("file_name")))
    b = t.select(_turn_uid().alias("uid"), chat(F.concat(F.lit("B "), F.col("text"))).alias("llm_output_json_raw"),
                 F.lit("model-b").alias("file_name"), F.lit("tmpl").alias("prompt_template_name"))
    return [a, b]


COMPLETIONS_SQL = """
completions AS (
  SELECT sha256(concat_ws(':', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))) AS uid,
         CASE WHEN conv_id % 4 = 0 THEN text
              ELSE json_object('choices', [json_object('message', json_object('content', '  ' || text || ' '))])::VARCHAR END
           AS llm_output_json_raw,
         'model-a' AS file_name, NULL AS prompt_template_name
  FROM conversations WHERE role = 'assistant'
  UNION ALL
  SELECT sha256(concat_ws(':', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))),
         json_object('choices', [json_object('message', json_object('content', 'B ' || text))])::VARCHAR,
         'model-b', 'tmpl'
  FROM conversations WHERE role IN ('user', 'assistant')
)"""


# ---------------------------------------------------------------- batch manifest and results
def batch_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Manifest (custom_id, dataset_item_id, uid) - one request per order."""
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("gen-"), F.col("o_orderkey").cast("string")).alias("custom_id"),
                    F.col("o_custkey").cast("string").alias("dataset_item_id"),
                    F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("uid"))


def batch_results(spark: SparkSession, d: str) -> DataFrame:
    """Batch results (custom_id, content, error): first line item of an order answers its request (returned
    items fail); all later ones answer an id that is not in the manifest."""
    li = table(spark, d, "lineitem")
    known = (F.col("l_linenumber") == 1)
    cid = F.when(known, F.concat(F.lit("gen-"), F.col("l_orderkey").cast("string"))) \
        .otherwise(F.concat(F.lit("gen-x"), F.col("l_orderkey").cast("string")))
    return li.select(
        cid.alias("custom_id"),
        F.concat(F.lit("reply "), F.col("l_quantity").cast("string")).alias("content"),
        F.when(known & (F.col("l_returnflag") == "R"), F.lit("server_error")).alias("error"))


MANIFEST_SQL = """
manifest AS (SELECT 'gen-' || CAST(o_orderkey AS VARCHAR) AS custom_id, CAST(o_custkey AS VARCHAR) AS dataset_item_id,
                    'u' || CAST(o_orderkey AS VARCHAR) AS uid FROM orders),
results AS (
  SELECT CASE WHEN l_linenumber = 1 THEN 'gen-' ELSE 'gen-x' END || CAST(l_orderkey AS VARCHAR) AS custom_id,
         'reply ' || CAST(l_quantity AS VARCHAR) AS content,
         CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN 'server_error' END AS error
  FROM lineitem
)"""


# ---------------------------------------------------------------- dataset items, run items, traces (single-turn runs)
def st_dataset_items(spark: SparkSession, d: str) -> DataFrame:
    """Dataset items (dataset_item_id, convo_history, expected_output, profile_prompt, generation_run_name,
    source_trace_id) - one per assistant turn; some items lack a run name and rely on their source trace."""
    t = with_history(turns(spark, d))
    a = t.filter(F.col("role") == "assistant")
    profile = F.concat(F.lit("Presenting Concern: topic "), F.col("conv_id").cast("string"),
                       F.lit("\n*** Communication patterns ***\nshort\n*** Language examples ***\n"),
                       F.col("text"), F.lit("\nMUST FOLLOW THESE GUIDELINES: be brief"))
    return a.select(
        F.concat(F.lit("item-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("dataset_item_id"),
        F.coalesce("convo_history", F.lit("")).alias("convo_history"), F.col("text").alias("expected_output"),
        profile.alias("profile_prompt"),
        F.when(F.col("conv_id") % 3 == 0, F.lit(None).cast("string"))
        .when(F.col("conv_id") % 3 == 1, F.lit("run-a")).otherwise(F.lit("run-b")).alias("generation_run_name"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("source_trace_id"))


def st_traces(spark: SparkSession, d: str) -> DataFrame:
    """Generation traces (trace_id, run_name, output): one per assistant turn (source traces) and one per run item."""
    t = turns(spark, d).filter(F.col("role") == "assistant")
    src = t.select((F.col("conv_id") * 100 + F.col("turn")).alias("trace_id"),
                   F.when(F.col("turn") % 2 == 1, F.lit("run-a")).otherwise(F.lit("run-b")).alias("run_name"),
                   F.lit(None).cast("string").alias("output"))
    gen = t.select((F.col("conv_id") * 100 + F.col("turn") + 10_000_000).alias("trace_id"),
                   F.lit("run-a").alias("run_name"), F.concat(F.lit("copilot: "), F.col("text")).alias("output"))
    return src.unionByName(gen)


def st_run_items(spark: SparkSession, d: str) -> DataFrame:
    """Run items (run_name, dataset_item_id, trace_id); every fifth conversation points at a missing item."""
    t = turns(spark, d).filter(F.col("role") == "assistant")
    item = F.concat(F.lit("item-"), F.col("conv_id").cast("string"), F.lit("-"),
                    F.when(F.col("conv_id") % 5 == 0, F.lit("missing")).otherwise(F.col("turn").cast("string")))
    return t.select(F.lit("run-a").alias("run_name"), item.alias("dataset_item_id"),
                    (F.col("conv_id") * 100 + F.col("turn") + 10_000_000).alias("trace_id"))


ST_RUN_SQL = f"""
ditems AS (
  SELECT 'item-' || a.conv_id || '-' || a.turn AS dataset_item_id, coalesce(a.history, '') AS convo_history,
         a.text AS expected_output,
         'Presenting Concern: topic ' || a.conv_id || chr(10) || '*** Communication patterns ***' || chr(10) || 'short' || chr(10)
           || '*** Language examples ***' || chr(10) || a.text || chr(10) || 'MUST FOLLOW THESE GUIDELINES: be brief'
           AS profile_prompt,
         CASE a.conv_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'run-a' ELSE 'run-b' END AS generation_run_name,
         a.conv_id * 100 + a.turn AS source_trace_id
  FROM {HISTORY_SQL} a
  WHERE a.role = 'assistant'),
strace AS (
  SELECT conv_id * 100 + turn AS trace_id, CASE WHEN turn % 2 = 1 THEN 'run-a' ELSE 'run-b' END AS run_name,
         CAST(NULL AS VARCHAR) AS output FROM conversations WHERE role = 'assistant'
  UNION ALL
  SELECT conv_id * 100 + turn + 10000000, 'run-a', 'copilot: ' || text FROM conversations WHERE role = 'assistant'),
ritems AS (
  SELECT 'run-a' AS run_name,
         'item-' || conv_id || '-' || CASE WHEN conv_id % 5 = 0 THEN 'missing' ELSE CAST(turn AS VARCHAR) END AS dataset_item_id,
         conv_id * 100 + turn + 10000000 AS trace_id
  FROM conversations WHERE role = 'assistant')"""


# ---------------------------------------------------------------- profile keys, upserts, run tags
def profile_keys(spark: SparkSession, d: str) -> DataFrame:
    """Available profile keys (key, key_pos): ``<region>_<nation>`` from nation x region."""
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lower("r_name"), F.lit("_"), F.col("n_nationkey").cast("string")).alias("key"),
        F.col("n_nationkey").alias("key_pos"))


PROFILE_KEYS_SQL = """
pkeys AS (SELECT lower(r_name) || '_' || CAST(n_nationkey AS VARCHAR) AS key, n_nationkey AS key_pos
          FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def item_writes(spark: SparkSession, d: str) -> DataFrame:
    """Dataset-item writes (dataset, profile_key, payload, written_at, write_id): every event rewrites the
    item of its (event type, user)."""
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("ds-"), "event_type").alias("dataset"),
                    F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("profile_key"),
                    F.col("value").alias("payload"), F.col("ts").alias("written_at"), F.col("event_id").alias("write_id"))


def tagged_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces (trace_id, name, tags) with ``dataset-<type>/run-<n>`` tags from events."""
    e = table(spark, d, "events")
    tag = F.concat(F.lit("dataset-"), "event_type", F.lit("/run-"), (F.dayofmonth("ts") % 3).cast("string"))
    return e.select(F.col("event_id").alias("trace_id"),
                    F.when(F.col("value") > 1, F.lit("generated-conversation")).otherwise(F.lit("other")).alias("name"),
                    F.array(tag, F.lit("misc")).alias("tags"))


# ---------------------------------------------------------------- retrieval
def rag_cache(spark: SparkSession, d: str) -> DataFrame:
    """A previous run's embedding cache (hash, response, embedding, cached_at): the opening (client, counselor)
    exchange of conversations without a preamble, each cached twice (the later copy is current)."""
    t = turns(spark, d)
    u = t.filter((F.col("turn") == 0) & (F.col("role") == "user")).select("conv_id", F.col("text").alias("u"))
    a = t.filter((F.col("turn") == 1) & (F.col("role") == "assistant")).select("conv_id", F.col("text").alias("a"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    from parley.functions.text import py_strip
    resp = py_strip(F.concat(F.lit("Counselor: "), F.col("a")))
    base = u.join(a, "conv_id").join(e, "conv_id").select(
        F.sha2(F.concat(F.lit("Client: "), F.col("u"), F.lit("\u0000"), resp), 256).alias("hash"),
        resp.alias("response"), "conv_id", "embedding")
    new = base.select("hash", "response", "embedding", (F.col("conv_id") + 1000).alias("cached_at"))
    old = base.select("hash", "response", F.reverse("embedding").alias("embedding"), F.col("conv_id").alias("cached_at"))
    return new.unionByName(old)


def retrieval_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Index rows (doc_id, embedding, context, response): stored vectors joined to their documents."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return e.join(docs, "doc_id").select("doc_id", "embedding", F.col("text").alias("context"),
                                         F.concat(F.lit("["), F.col("lang"), F.lit("] "), F.col("source")).alias("response"))


def retrieval_queries(spark: SparkSession, d: str) -> DataFrame:
    """Query vectors (query_id, embedding): every stored vector."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


# ---------------------------------------------------------------- redaction
# Fixed values for the fixture run: the name list (words that occur in the invented prose).
FIXTURE_NAMES = ["orre", "eriner", "anon", "thon", "stteen", "hein", "erachtz"]


def name_list(spark: SparkSession) -> DataFrame:
    """One-column name table, as loaded from name files."""
    return spark.createDataFrame([(n,) for n in FIXTURE_NAMES], "name string")


def deid_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages to de-identify (index, message, lang, patterns_de_id_message) - a previous run already filled
    the target for toxic-labelled documents (resume keeps those)."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    lab = table(spark, d, "labels").select("doc_id", "toxic")
    return docs.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("index"), F.col("text").alias("message"), "lang",
        F.when(F.col("toxic") == 1, F.concat(F.lit("previously redacted "), F.col("doc_id").cast("string")))
        .alias("patterns_de_id_message"))


def _error_text():
    parts = F.concat_ws(", ",
                        F.when(F.col("text").contains("@"), F.lit("email (address)")),
                        F.when(F.col("text").rlike(r"\d{9,}"), F.lit("other_id (number)")),
                        F.when(F.col("lang") == "de", F.lit("name (Hans)")),
                        F.when(F.col("n_chars") > 5000, F.lit("age (long message)")))
    return F.when(parts == "", F.lit("none")).otherwise(parts)


def annotation_sheets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotator 1, annotator 2, second-method sheet): labelled documents with the method output, a 0/1 label
    and the reviewer's error text; sheets carry their row position (``row_pos``)."""
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic", F.col("_metadata.row_index").alias("row_pos"))
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    j = lab.join(docs, "doc_id")
    first = j.select(F.col("doc_id").alias("index"), "row_pos",
                     F.col("text").alias("patterns_de_id_message"),
                     F.col("quality").cast("string").alias("label_patterns"), _error_text().alias("errors_patterns"))
    a1 = first.filter(F.col("row_pos") < 200)
    a2 = first.withColumn("Notes", F.lit("checked"))
    second = j.select(F.col("doc_id").alias("index"),
                      F.col("text").alias("names_de_id_message"),
                      F.when(F.col("toxic").isNotNull(), (1 - F.col("toxic")).cast("string")).alias("label_names"),
                      _error_text().alias("errors_names"))
    return a1, a2, second


# ---------------------------------------------------------------- cost requests
# Fixed values for the fixture run: models assigned to sources, eval prompt per language, system prompt.
COST_MODELS = ["gpt-5-nano", "gpt-5-mini", "gpt-5.2", "gpt-4.1", "gpt-4.1-mini", "gpt-4.1-nano", "gpt-4o",
               "gpt-4o-mini", "custom-a", "custom-b"]
COST_EVALS = {"en": "rubric_eval", "fr": "questions", "de": "forbidden", "es": "unlisted_eval"}
SYSTEM_PROMPT = "You are a careful judge of counselling replies."


def cost_requests(spark: SparkSession, d: str) -> DataFrame:
    """Judge requests (doc_id, model, eval_name, messages): system prompt + the document as the user turn."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    n = F.substring("source", 4, 10).try_cast("int")
    model = F.element_at(F.array(*[F.lit(m) for m in COST_MODELS]), (n % len(COST_MODELS) + 1).cast("int"))
    ev = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in COST_EVALS.items() for x in (F.lit(k), F.lit(v))]),
                                     F.col("lang")), F.lit("unlisted_eval"))
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
                   F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return docs.select("doc_id", model.alias("model"), ev.alias("eval_name"), msgs.alias("messages"))


# ---------------------------------------------------------------- observation log
LATENCY_DATASET = "sim-ds"


def obs_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces (trace_id, name, tags, turn_count, latency) - one per customer, three runs by nation."""
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("trace_id"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit("other")).otherwise(F.lit("generated-conversation")).alias("name"),
        F.array(F.concat(F.lit(LATENCY_DATASET + "/run-"), (F.col("c_nationkey") % 3).cast("string")), F.lit("misc")).alias("tags"),
        F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") % 7).when(F.col("c_custkey") % 4 == 1, F.lit(-1))
        .alias("turn_count"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") / 100.0).alias("latency"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Observation log from events (see :func:`observations_from`)."""
    return observations_from(table(spark, d, "events"))


def observations_from(e: DataFrame) -> DataFrame:
    """Observation log (id, trace_id, type, name, latency, start_time) from events: the event type decides the
    call (patient / counselor / editor / embedding / ignored patient-editor); clicks are logged twice.
    Row-local, so it also runs on an event stream."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    turn = (k % 8 + 1).cast("string")
    name = (F.when(F.col("event_type") == "view", F.concat(F.lit("patient-turn-"), turn))
            .when(F.col("event_type") == "click", F.concat(F.lit("counselor-turn-"), turn))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("counselor-editor-turn-"), turn))
            .when(F.col("event_type") == "signup", F.concat(F.lit("rag-embedding-turn-"), turn))
            .otherwise(F.concat(F.lit("patient-editor-turn-"), turn)))
    typ = (F.when(F.col("value") > 40, F.lit("event")).when(F.col("event_type") == "signup", F.lit("span"))
           .otherwise(F.lit("generation")))
    oid = F.when((F.col("event_type") == "view") & (F.col("value") > 45), F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("obs-"), F.col("event_id").cast("string")))
    base = e.select(oid.alias("id"), F.col("user_id").alias("trace_id"), typ.alias("type"), name.alias("name"),
                    F.when(F.col("value") >= 1, F.col("value")).alias("latency"), F.col("ts").alias("start_time"),
                    "event_type")
    again = (base.filter(F.col("event_type") == "click")
             .withColumn("start_time", F.col("start_time") + F.expr("INTERVAL 1 SECOND"))
             .withColumn("latency", F.col("latency") * 2))
    return base.unionByName(again).drop("event_type")


# ---------------------------------------------------------------- profiles
# Fixed values for the fixture run: presenting concern per market segment (MACHINERY is non-standard).
SEGMENT_CONCERN = {"AUTOMOBILE": "Anxiety", "BUILDING": "Depression", "FURNITURE": "Loneliness",
                   "HOUSEHOLD": "Relationship", "MACHINERY": "Grief"}


STYLE_TRAITS = ["language_patterns", "emotional_expression_vulnerability", "depth_pacing_of_disclosure",
                "engagement_response_to_support", "focus_structure_of_discussion"]


def client_traits(spark: SparkSession, d: str) -> DataFrame:
    """(uid, client_traits_obscured_json_raw, presenting_concern): judge output with the traits JSON inside prose;
    some ages are missing or not numeric, some sexes unknown or missing."""
    c = table(spark, d, "customer")
    age = (F.when(F.col("c_custkey") % 11 == 0, F.lit(None).cast("string"))
           .when(F.col("c_custkey") % 13 == 0, F.lit("unknown"))
           .otherwise((18 + (F.col("c_custkey") * 7) % 60).cast("string")))
    g = F.col("c_nationkey") % 4
    sex = F.when(g == 0, F.lit("female")).when(g == 1, F.lit("male")).when(g == 2, F.lit("unknown"))
    traits = F.to_json(F.struct(F.col("c_name").alias("name"), age.alias("age"), sex.alias("sex_or_gender"),
                                F.col("c_mktsegment").alias("job"),
                                F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("residence"),
                                F.concat(F.lit("class "), (F.col("c_nationkey") % 3).cast("string")).alias("socioeconomic_status"),
                                F.concat(F.lit("wrote {job} to "), F.col("c_name")).alias("key_details"),
                                *[F.concat(F.lit(f"{f} "), (F.col("c_custkey") % 7).cast("string")).alias(f) for f in STYLE_TRAITS]))
    concern = F.try_element_at(F.create_map(*[x for k, v in SEGMENT_CONCERN.items() for x in (F.lit(k), F.lit(v))]),
                               F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").cast("string").alias("uid"),
                    F.concat(F.lit("Extracted traits:\n"), traits, F.lit("\nDone.")).alias("client_traits_obscured_json_raw"),
                    concern.alias("presenting_concern"))


def sampled_conversations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(sampled transcripts (uid, conversation), de-identified transcripts (uid, deid_conversation))."""
    t = transcripts(spark, d).select(F.col("conv_id").cast("string").alias("uid"), "conversation")
    return t, t.select("uid", F.col("conversation").alias("deid_conversation"))


# ---------------------------------------------------------------- deterministic stand-in models
def stub_complete(prompt: str) -> str:
    """Stand-in completion model: fails for prompts whose length is a multiple of 11, else echoes a summary."""
    if len(prompt) % 11 == 0:
        raise ValueError("stub overloaded")
    return f"reply {len(prompt) % 97} // {prompt[-12:]}"


def stub_judge(text: str) -> str:
    """Stand-in judge: a fenced JSON list of two scores derived from the text length (broken when it is a
    multiple of 13)."""
    if len(text) % 13 == 0:
        return "I cannot judge this."
    return ('```json\n[{"question": "consistency", "score": %d}, {"question": "tone", "score": %d}]\n```'
            % (len(text) % 5 + 1, len(text) % 3 + 1))


# Fixed values for the fixture run: the configurations whose stability is compared.
STABILITY_CONFIGS = ["cfg_a", "cfg_b"]


def stability_requests(spark: SparkSession, d: str) -> DataFrame:
    """(config, item_id, prompt): every benchmark prompt under each configuration."""
    b = table(spark, d, "benchmark")
    cfg = F.explode(F.array(*[F.lit(c) for c in STABILITY_CONFIGS]))
    return (b.select(cfg.alias("config"), "item_id", "text")
            .select("config", "item_id", F.concat(F.lit("["), F.col("config"), F.lit("] "), F.col("text")).alias("prompt")))


# ---------------------------------------------------------------- batch prediction table
def prediction_table(spark: SparkSession, d: str) -> DataFrame:
    """Prediction-table rows (status, request, response, metadata as JSON text): each user turn as the request,
    the following assistant turn as the candidate; the last user turn of a conversation gets no candidate."""
    t = turns(spark, d)
    u = t.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("u"))
    a = t.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    j = u.join(a, ["conv_id", "turn"], "left")
    request = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"),
                                                  F.array(F.struct(F.col("u").alias("text"))).alias("parts"))).alias("contents")))
    cand = F.struct(F.struct(F.array(F.struct(F.col("a").alias("text"))).alias("parts")).alias("content"),
                    F.array(F.struct(F.lit("HARM").alias("category"), F.lit("LOW").alias("probability")),
                            F.struct(F.lit("HATE").alias("category"), F.lit("NONE").alias("probability"))).alias("safetyRatings"))
    response = F.to_json(F.struct(F.when(F.col("a").isNotNull(), F.array(cand)).alias("candidates"),
                                  F.lit("gemini-test-001").alias("modelVersion"),
                                  F.struct(F.length("u").alias("totalTokenCount")).alias("usageMetadata")))
    meta = F.to_json(F.struct(F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("uid"),
                              F.lit("tmpl").alias("prompt_template_name")))
    return j.select(F.lit("JOB_STATE_SUCCEEDED").alias("status"), request.alias("request"), response.alias("response"),
                    meta.alias("metadata"))
