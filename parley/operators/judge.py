"""Judge-output and completion parsing.

Replies are free text holding JSON of several shapes, so everything goes
through VARIANT: ``strict_parse_json`` (Python ``json.loads`` semantics),
``try_variant_get`` and map-typed explosion of objects. All of it is
row-local: no shuffle until a later aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.jsonx import (brace_span, with_json_block, strict_parse_json, strip_fences,
                                    variant_entries, vget)
from parley.functions.text import stable_id


def _as_map(v):
    """Object -> map<string, variant>; NULL for anything that is not a JSON object."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is_object(v):
    return _as_map(v).isNotNull()


def flatten_scores(replies: DataFrame, text_col: str = "raw", eval_col: str = "eval_name",
                   static: bool = False, comment_limit: int = 1000) -> DataFrame:
    """Judge replies -> long score rows (…, score_name, value, comment).

    The reply is parsed with :func:`json_block`; an unparsable or non-object
    reply yields nothing. A top-level ``score`` that is not an object makes the
    whole document one metric named ``score``. Object metrics give ``score``
    and ``rationale`` (else ``justification``); scalar metrics must cast to a
    number and take their comment from ``<first letter>_justification``.
    Score name = ``eval.metric`` unless the metric already starts with the eval
    name (``static``: contains it). Comments are cut to ``comment_limit``.
    In ``static`` mode object metrics only read ``justification`` and scalar
    metrics carry no comment.
    """
    keep = [c for c in replies.columns if c != text_col]
    parsed = with_json_block(replies, text_col, "_doc")
    parsed = parsed.select(*keep, "_doc", _as_map(F.col("_doc")).alias("_m"))  # NULL maps explode to nothing
    score_field = F.try_element_at("_m", F.lit("score"))
    single = (~F.lit(static)) & score_field.isNotNull() & _as_map(score_field).isNull()
    entries = F.when(single, F.map_from_arrays(F.array(F.lit("score")), F.array(F.col("_doc")))).otherwise(F.col("_m"))
    rows = parsed.select(*keep, "_m", F.explode(entries).alias("metric", "val"))
    rows = rows.select(*keep, "_m", "metric", "val", _as_map(F.col("val")).alias("_vm"))
    is_obj = F.col("_vm").isNotNull()
    obj_field = lambda k: F.try_variant_get(F.try_element_at("_vm", F.lit(k)), "$", "string")
    if static:
        obj_comment = obj_field("justification")
        scalar_comment = F.lit(None).cast("string")
    else:
        obj_comment = F.coalesce(obj_field("rationale"), obj_field("justification"))
        just_key = F.concat(F.substring("metric", 1, 1), F.lit("_justification"))
        scalar_comment = F.try_variant_get(F.try_element_at("_m", just_key), "$", "string")
    value = F.when(is_obj, F.try_variant_get(F.try_element_at("_vm", F.lit("score")), "$", "double")) \
        .otherwise(vget("val", "$", "double"))
    comment = F.when(is_obj, obj_comment).otherwise(scalar_comment)
    ev = F.col(eval_col)
    named = F.col("metric").contains(ev) if static else F.col("metric").startswith(ev)
    name = F.when(named, F.col("metric")).otherwise(F.concat(ev, F.lit("."), F.col("metric")))
    return (rows.select(*keep, name.alias("score_name"), value.alias("value"),
                        F.nullif(F.substring(F.coalesce(comment, F.lit("")), 1, comment_limit), F.lit("")).alias("comment"))
            .filter(F.col("value").isNotNull()))


def scores_dual(scores: DataFrame, run_col: str = "trace_id", source_col: str = "source_trace_id") -> DataFrame:
    """Each score stored against the run trace and the source trace (NULL targets dropped)."""
    targets = F.array(F.struct(F.col(run_col).alias("target_trace_id"), F.lit("run").alias("target")),
                      F.struct(F.col(source_col).alias("target_trace_id"), F.lit("source").alias("target")))
    keep = [c for c in scores.columns if c not in (run_col, source_col)]
    return (scores.select(*keep, F.inline(targets)).filter(F.col("target_trace_id").isNotNull()))


def parse_report(replies: DataFrame, text_col: str = "raw", keys=("eval_name",)) -> DataFrame:
    """How each reply parsed (whole text / brace span / failed), counted per key."""
    return (with_json_block(replies, text_col, "_doc", "parse_path")
            .groupBy(*keys, "parse_path").agg(F.count(F.lit(1)).alias("n_replies")))


def response_normalize(resp) -> "F.Column":
    """One text from a provider reply VARIANT, first match wins: Gemini candidate parts (concatenated),
    content list of ``type = text`` parts, ``completion``, ``choices[0].message.content``,
    ``choices[0].text``; else ''."""
    gem = F.try_variant_get(resp, "$.candidates[0].content.parts", "array<struct<text:string>>")
    gem_text = F.when(F.size(gem) > 0, F.array_join(F.transform(gem, lambda p: F.coalesce(p.text, F.lit(""))), ""))
    parts = F.try_variant_get(resp, "$.content", "array<struct<type:string,text:string>>")
    parts_text = F.when(F.size(parts) > 0,
                        F.array_join(F.transform(F.filter(parts, lambda p: p.type == "text"), lambda p: p.text), ""))
    return F.coalesce(gem_text, parts_text,
                      vget(resp, "$.completion", "string"),
                      vget(resp, "$.choices[0].message.content", "string"),
                      vget(resp, "$.choices[0].text", "string"),
                      F.lit(""))


def completion_extract(lines: DataFrame, line_col: str = "line", file_col: str = "file_name",
                       pos_col: str = "line_no") -> DataFrame:
    """Completion JSONL lines -> (uid, prompt_template_name, content, file_name, input_file_name, status, error,
    normalized_text).

    Shapes: flat ``{completion, uid?, prompt_template_name?, input_file_name?}``
    and ``[request, {choices: [{message: {content}}]}, {metadata: {...}}]`` are
    extracted (status 'ok'); ``[request, [errors], {metadata}]`` is a failed
    request (status 'failed', errors joined); any other line is 'unparsed'
    (the reference drops these silently). Blank lines are skipped. A missing
    uid becomes a stable hash of (file, line). ``.jsonl`` is cut from the file
    name. ``normalized_text`` reads the response with :func:`response_normalize`.
    """
    v = strict_parse_json(line_col)
    df = (lines.filter(F.length(F.trim(F.col(line_col))) > 0)
          .select(F.regexp_replace(file_col, r"\.jsonl$", "").alias("file_name"), pos_col, v.alias("_v")))
    is_arr = F.schema_of_variant("_v").startswith("ARRAY")
    n = F.size(F.try_variant_get(F.col("_v"), "$", "array<variant>"))
    flat = _is_object(F.col("_v")) & vget("_v", "$.completion", "variant").isNotNull()
    three = is_arr & (n == 3)
    meta_path = "$[2].metadata"
    content_arr = vget("_v", "$[1].choices[0].message.content", "string")
    errors = F.try_variant_get(F.col("_v"), "$[1]", "array<string>")
    status = (F.when(flat, F.lit("ok"))
              .when(three & vget("_v", "$[1].choices[0].message", "variant").isNotNull(), F.lit("ok"))
              .when(three & errors.isNotNull(), F.lit("failed"))
              .otherwise(F.lit("unparsed")))
    pick = lambda flat_path, meta_key: F.when(flat, vget("_v", flat_path, "string")).when(
        three, vget("_v", f"{meta_path}.{meta_key}", "string"))
    uid = F.coalesce(pick("$.uid", "uid"), stable_id("file_name", pos_col))
    response = F.when(flat, F.col("_v")).otherwise(vget("_v", "$[1]", "variant"))
    return df.select(
        uid.alias("uid"),
        F.coalesce(pick("$.prompt_template_name", "prompt_template_name"), F.lit("")).alias("prompt_template_name"),
        F.when(status == "ok", F.when(flat, vget("_v", "$.completion", "string")).otherwise(content_arr)).alias("content"),
        "file_name",
        F.coalesce(pick("$.input_file_name", "input_file_name"), F.lit("")).alias("input_file_name"),
        status.alias("status"),
        F.when(status == "failed", F.array_join(errors, "; ")).alias("error"),
        response_normalize(response).alias("normalized_text"),
    )


def parse_file_name(c):
    """``dialogue|profile|counselor|editor|model|timestamp.ext`` -> struct of parts (NULL parts when malformed).

    ``profile`` splits on ``_``: dialogue name = part 0, patient type = parts 2 and 3.
    """
    parts = F.split(c, r"\|")
    prof = F.split(F.try_element_at(parts, F.lit(2)), "_")
    p = lambda a, i: F.try_element_at(a, F.lit(i))
    ok = (F.size(parts) >= 6) & (F.size(prof) >= 4)
    return F.when(ok, F.struct(
        p(prof, 1).alias("dialogue_name"),
        F.concat(p(prof, 3), F.lit("_"), p(prof, 4)).alias("patient_type"),
        p(parts, 3).alias("counselor_prompt"), p(parts, 4).alias("editor_prompt"), p(parts, 5).alias("model_name"),
        F.split(p(parts, 6), r"\.")[0].alias("timestamp")))


# Keys that may hold a counselor unit-test score, in priority order
# ("unsafe_behavior" appended: the reference's list misses it and scores it NULL).
UNIT_TEST_SCORE_KEYS = ["n_multi_task_messages", "n_instances_not_followed", "build_rapport", "n_skipped_stages",
                        "n_forbidden_statements", "n_question_messages", "n_empathy_chained_messages",
                        "explore_situation", "assess_risks", "explore_next_steps", "offer_resources",
                        "end_conversation", "n_emotional_language", "unsafe_behavior", "total_number_of_tasks"]


def _normalized_entries(v):
    """Object entries with keys lower-cased and blanks turned into '_' ('Total Number of Tasks' ->
    'total_number_of_tasks'), so unit-test keys match their score column names."""
    m = F.try_variant_get(v, "$", "map<string,variant>")
    return F.transform_keys(m, lambda k, _v: F.lower(F.regexp_replace(F.trim(k), r"\s+", "_")))
EVAL_TYPES = ["patient_eval", "counselor_unit_test", "counselor_eval"]


def eval_unpivot(lines: DataFrame, file_col: str = "file_name", pos_col: str = "line_no",
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Dialogue-eval files (3 JSON lines each) -> (long rows, errors).

    Long rows: file metadata x evaluation_type x category with score and
    rationale. Unit-test score = first present key of
    :data:`UNIT_TEST_SCORE_KEYS`; rationale else explanation; non-object
    entries are skipped. Files with a malformed name, not exactly 3 lines, or
    an unparsable line go to the error output.
    """
    per_file = (lines.groupBy(file_col)
                .agg(F.count(F.lit(1)).alias("_n"),
                     *[F.max(F.when(F.col(pos_col) == i, F.col(text_col))).alias(t) for i, t in enumerate(EVAL_TYPES)]))
    meta = parse_file_name(F.col(file_col))
    docs = per_file.select(file_col, "_n", meta.alias("_meta"),
                           *[strict_parse_json(t).alias(t) for t in EVAL_TYPES])
    good = (F.col("_n") == 3) & F.col("_meta").isNotNull()
    for t in EVAL_TYPES:
        good = good & _is_object(F.col(t))
    errors = docs.filter(~good).select(file_col, F.when(F.col("_meta").isNull(), F.lit("bad file name"))
                                       .when(F.col("_n") != 3, F.lit("not 3 lines"))
                                       .otherwise(F.lit("unparsable line")).alias("error"))
    ok = docs.filter(good)
    typed = ok.select(file_col, "_meta", F.inline(F.array(*[
        F.struct(F.lit(t).alias("evaluation_type"), F.col(t).alias("doc")) for t in EVAL_TYPES])))
    long = typed.select(file_col, "_meta", "evaluation_type", variant_entries("doc").alias("category", "val"))
    long = long.filter(_is_object(F.col("val")))
    norm = _normalized_entries(F.col("val"))
    unit_score = F.coalesce(*[F.try_variant_get(F.try_element_at(norm, F.lit(k)), "$", "double")
                              for k in UNIT_TEST_SCORE_KEYS])
    score = F.when(F.col("evaluation_type") == "counselor_unit_test", unit_score).otherwise(vget("val", "$.score", "double"))
    rationale = F.when(F.col("evaluation_type") == "counselor_unit_test",
                       F.coalesce(F.nullif(vget("val", "$.rationale", "string"), F.lit("")),
                                  vget("val", "$.explanation", "string"))).otherwise(vget("val", "$.rationale", "string"))
    out = long.select(file_col, "_meta.*", "evaluation_type", "category", score.alias("score"),
                      rationale.alias("rationale"))
    return out, errors


__all__ = ["flatten_scores", "scores_dual", "parse_report", "response_normalize", "completion_extract",
           "parse_file_name", "eval_unpivot", "brace_span", "strip_fences"]


def parse_prediction_rows(rows: DataFrame, request_col: str = "request", response_col: str = "response",
                          metadata_col: str = "metadata") -> DataFrame:
    """Batch-prediction table rows -> (uid, prompt_template_name, user_message, assistant_message, model_version,
    n_safety_ratings, total_tokens, status).

    The user text is the first part of the first request content, the reply the first part of the first
    candidate; the row's own metadata (a JSON string) is merged with the model metadata. Rows missing either
    text are kept with status 'error' (the reference prints and skips them).
    """
    req = F.try_parse_json(F.col(request_col).cast("string")) if dict(rows.dtypes)[request_col] == "string" \
        else F.col(request_col)
    resp = F.try_parse_json(F.col(response_col).cast("string")) if dict(rows.dtypes)[response_col] == "string" \
        else F.col(response_col)
    meta = F.try_parse_json(F.col(metadata_col))
    user = F.try_variant_get(req, "$.contents[0].parts[0].text", "string")
    reply = F.try_variant_get(resp, "$.candidates[0].content.parts[0].text", "string")
    ratings = F.try_variant_get(resp, "$.candidates[0].safetyRatings", "array<variant>")
    return rows.select(
        F.try_variant_get(meta, "$.uid", "string").alias("uid"),
        F.try_variant_get(meta, "$.prompt_template_name", "string").alias("prompt_template_name"),
        user.alias("user_message"), reply.alias("assistant_message"),
        F.coalesce(F.try_variant_get(resp, "$.modelVersion", "string"), F.lit("")).alias("model_version"),
        F.coalesce(F.size(ratings), F.lit(0)).alias("n_safety_ratings"),
        F.try_variant_get(resp, "$.usageMetadata.totalTokenCount", "bigint").alias("total_tokens"),
        F.when(user.isNotNull() & reply.isNotNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"))
