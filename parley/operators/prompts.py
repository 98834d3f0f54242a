"""Prompt building and joins around completions.

Templates, eval prompts and model settings are driver-side configuration (a
handful of entries). They are inlined as literal arrays and expanded with
``inline`` - a per-row fan-out, not a join - so no dimension table is ever
shuffled or broadcast. Data-to-data joins (items x completions, replies x
copilot rows, run items x dataset items x traces) are equi-joins on ids that
Spark plans as sort-merge (or broadcast under AQE when a side is small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.jsonx import strict_parse_json
from parley.functions.text import py_strip, template_fill


def _literal_rows(rows: list[dict]):
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])


def request_kind(model):
    """Provider family of a model name (decides the request body shape)."""
    m = F.lower(model)
    return (F.when(m.isin("o1", "o3") | m.startswith("o1-") | m.startswith("o3-"), F.lit("o-series"))
            .when(m.contains("claude"), F.lit("claude"))
            .when(m.contains("gemini"), F.lit("gemini"))
            .when(m.contains("phi"), F.lit("phi"))
            .when(m.contains("deepseek"), F.lit("deepseek"))
            .when(m.contains("llama"), F.lit("llama"))
            .otherwise(F.lit("default")))


def build_requests(rows: DataFrame, templates: list[dict], input_col: str, *, uid_col: str | None = None,
                   id_col: str | None = None, file_col: str | None = None, index_col: str | None = None,
                   completion_format: str = "messages", max_tokens: int = 512,
                   temperature: float = 0.0, top_p: float = 1.0) -> DataFrame:
    """Every template x every row with a non-null input -> one request row.

    ``templates``: dicts with ``name``, ``text`` (slots ``{note}``, ``{id}``,
    ``{uid}``; ``{{``/``}}`` literal braces) and ``model``. uid = the row's
    uid, else ``<file>_<index>``; id = the id column as text, else the uid.
    The body is shaped per provider: o-series requests carry
    ``max_completion_tokens`` with temperature/top_p forced to 1, Claude and
    Gemini requests carry only the prompt text, others carry ``max_tokens``.
    """
    if completion_format not in ("messages", "prompt"):
        raise ValueError(f"Invalid completion format: {completion_format}")
    df = rows.filter(F.col(input_col).isNotNull())
    uid = F.col(uid_col).cast("string") if uid_col else None
    if file_col and index_col:
        fallback = F.concat(F.element_at(F.split(F.col(file_col), "/"), -1), F.lit("_"), F.col(index_col).cast("string"))
        uid = F.coalesce(uid, fallback) if uid is not None else fallback
    if uid is None:
        raise ValueError("need uid_col or file_col + index_col")
    ident = F.col(id_col).cast("string") if id_col else F.col("uid")
    keep = [F.col(file_col).alias("input_file_name")] if file_col else [F.lit(None).cast("string").alias("input_file_name")]
    base = df.select(uid.alias("uid"), F.col(input_col).alias("_note"), *keep,
                     *([F.col(id_col)] if id_col else []))
    base = base.withColumn("id", ident)
    tmpl = base.select("*", F.inline(_literal_rows(templates)))
    prompt = template_fill(F.col("text"), {"note": F.col("_note"), "id": F.col("id"), "uid": F.col("uid")})
    kind = request_kind(F.col("model"))
    o_series = kind == "o-series"
    prompt_only = kind.isin("claude", "gemini")
    return tmpl.select(
        "uid", "id", F.col("name").alias("prompt_template_name"), "input_file_name",
        prompt.alias("prompt"),
        F.lit(completion_format).alias("completion_format"),
        "model", kind.alias("request_kind"),
        F.when(o_series, F.lit(1.0)).when(~prompt_only, F.lit(float(temperature))).alias("temperature"),
        F.when(o_series, F.lit(1.0)).when(~prompt_only, F.lit(float(top_p))).alias("top_p"),
        F.when(~o_series & ~prompt_only, F.lit(int(max_tokens))).alias("max_tokens"),
        F.when(o_series, F.lit(int(max_tokens))).alias("max_completion_tokens"),
    )


def request_messages(requests: DataFrame) -> DataFrame:
    """Add the chat body ``messages = [{role: user, content: prompt}]`` (messages format)."""
    return requests.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"),
                                                           F.col("prompt").alias("content"))))


def limit_samples(requests: DataFrame, max_samples: int | None, order_cols=("uid", "prompt_template_name")) -> DataFrame:
    """At most ``max_samples`` requests (the reference's smoke-test switch); deterministic order."""
    if not max_samples:
        return requests
    return requests.orderBy(*order_cols).limit(max_samples)


def completion_text(raw) -> "F.Column":
    """``choices[0].message.content`` trimmed when the text is such a JSON document, else the text unchanged."""
    content = F.try_variant_get(strict_parse_json(raw), "$.choices[0].message.content", "string")
    return F.coalesce(py_strip(content), raw)


def union_completions(frames: list[DataFrame]) -> DataFrame:
    """Concatenate completion frames by column name; columns missing in a frame become NULL."""
    if not frames:
        raise ValueError("No completion frames provided")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def orphan_check(items: DataFrame, completions: DataFrame, key: str = "uid") -> DataFrame:
    """One row: distinct keys on both sides, their difference, and keys present on one side only."""
    a = items.select(key).distinct().withColumn("_a", F.lit(1))
    b = completions.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count("_a").alias("n_input_uids"), F.count("_b").alias("n_completion_uids"),
                    (F.count("_a") - F.count("_b")).alias("missing_count"),
                    F.count_if(F.col("_b").isNull()).alias("n_items_without_completion"),
                    F.count_if(F.col("_a").isNull()).alias("n_completions_without_item"))


def comparison_text(history, response_a, response_b, labelled: bool = False):
    """Conversation history + Response A + Response B (NULL parts render as '')."""
    a_lab = "Response A (Human Counselor):" if labelled else "Response A:"
    b_lab = "Response B (AI Copilot):" if labelled else "Response B:"
    c = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return F.concat(F.lit("Conversation History:\n"), c(history), F.lit(f"\n\n{a_lab}\n"), c(response_a),
                    F.lit(f"\n\n{b_lab}\n"), c(response_b))


def join_comparison(items: DataFrame, completions: DataFrame, raw_col: str = "llm_output_json_raw") -> DataFrame:
    """items x completions on uid (one row per pair); right-side clashes get ``_completion``."""
    clash = [c for c in completions.columns if c in items.columns and c != "uid"]
    right = completions.select(*[F.col(c).alias(c + "_completion") if c in clash else F.col(c)
                                 for c in completions.columns])
    right = right.withColumn("extracted_completion", completion_text(F.col(raw_col)))
    joined = items.join(right, "uid", "inner")
    return joined.withColumn("comparison_input",
                             comparison_text(F.col("convo_history"), F.col("counselor_message"),
                                             F.col("extracted_completion")))


def second_call_inputs(base: DataFrame, copilot: DataFrame) -> DataFrame:
    """base replies x copilot rows on uid -> (uid, second_call_prompt_input)."""
    j = base.join(copilot, "uid", "inner")
    text = F.concat(F.lit("Conversation history:\n\n"), F.coalesce("conversation", F.lit("")),
                    F.lit("\n\nNew message from counselor:"), F.coalesce("base_prompt_response", F.lit("")))
    return j.select("uid", text.alias("second_call_prompt_input"))


def editor_text(editor_prompt, history, draft):
    """Editor prompt + history + draft + ``Output: ``."""
    return F.concat(py_strip(editor_prompt), F.lit("\n\nConversation history:\n"), F.coalesce(history, F.lit("")),
                    F.lit("\n\nNew message from counselor:\n"), F.coalesce(draft, F.lit("")), F.lit("\nOutput: "))


def profile_section(profile, eval_name):
    """Slice of a patient profile added to an eval prompt: the presenting-concern block for
    ``presenting_concern``, the language-examples block for ``language_patterns``, else ''."""
    concern = F.regexp_extract(profile, r"(?s)(Presenting Concern:.*?)\n\*\*\* Communication patterns \*\*\*", 1)
    language = F.regexp_extract(profile, r"(?s)(\*\*\* Language examples \*\*\*.*?)(?:MUST FOLLOW THESE GUIDELINES:|$)", 1)
    return (F.when((eval_name == "presenting_concern") & (concern != ""),
                   F.concat(F.lit("\n\nPatient Profile Details:\n"), py_strip(concern)))
            .when((eval_name == "language_patterns") & (language != ""), F.concat(F.lit("\n\n"), py_strip(language)))
            .otherwise(F.lit("")))


def filter_run_items(items: DataFrame, traces: DataFrame, run_name: str) -> DataFrame:
    """Items generated in ``run_name``: the item's own generation_run_name, else (when NULL)
    the run of its source trace."""
    t = traces.select(F.col("trace_id").alias("source_trace_id"), F.col("run_name").alias("_trace_run"))
    j = items.join(t, "source_trace_id", "left")
    return j.filter(F.coalesce(F.col("generation_run_name"), F.col("_trace_run")) == run_name).drop("_trace_run")


def join_payloads(run_items: DataFrame, dataset_items: DataFrame, traces: DataFrame,
                  eval_prompts: list[dict], selected: list[str] | None = None,
                  ablations: dict[str, str] | None = None) -> DataFrame:
    """Run items x dataset items (unmatched dropped) x traces x eval prompts -> one judge payload each.

    ``selected`` prunes the eval prompts (None = all). ``ablations`` maps an
    eval name to an addendum appended to its prompt. The comparison text is
    filled into ``{{note}}``; the profile section is appended per eval.
    """
    prompts = [p for p in eval_prompts if selected is None or p["name"] in selected]
    if ablations:
        prompts = [dict(p, text=p["text"] + ablations.get(p["name"], "")) for p in prompts]
    ri = run_items.join(dataset_items, "dataset_item_id", "inner")
    ri = ri.join(traces.select("trace_id", F.col("output").alias("copilot_output")), "trace_id", "inner")
    fan = ri.select("*", F.inline(_literal_rows([{"eval_name": p["name"], "template": p["text"]} for p in prompts])))
    comparison = comparison_text(F.col("convo_history"), F.col("expected_output"), F.col("copilot_output"),
                                 labelled=True)
    compiled = F.replace(F.col("template"), F.lit("{{note}}"), comparison)
    compiled = F.concat(compiled, profile_section(F.col("profile_prompt"), F.col("eval_name")))
    return fan.select("trace_id", "dataset_item_id", "eval_name", compiled.alias("prompt"))
