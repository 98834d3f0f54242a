"""Join jobs: requests, comparisons, manifests, payloads, grids, selections, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import prompts as pr
from parley.operators import runs as rn
from parley.plans import inputs
from parley.plans.registry import job
from parley.plans.sqlparts import strict_json, strip, with_


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# Fixed values for the fixture run: prompt templates (name, text, model) as a prompt directory would hold them.
FIXTURE_TEMPLATES = [
    {"name": "summary", "text": "Summarize item {id}:\n{note}\nReply as {{\"uid\": \"{uid}\"}}", "model": "gpt-4.1"},
    {"name": "critique", "text": "Critique this note:\n{note}", "model": "o3-mini"},
    {"name": "gemini_probe", "text": "{note}", "model": "gemini-2.0-flash"},
    {"name": "claude_probe", "text": "Note {uid}: {note}", "model": "claude-sonnet"},
    {"name": "llama_probe", "text": "[{id}] {note}", "model": "Llama-3.3-70B"},
]
MAX_TOKENS = 512

_T_VALUES = ", ".join(f"({q(t['name'])}, {q(t['text'])}, {q(t['model'])})" for t in FIXTURE_TEMPLATES)
_KIND = ("CASE WHEN lower(model) IN ('o1', 'o3') OR starts_with(lower(model), 'o1-') OR starts_with(lower(model), 'o3-') "
         "THEN 'o-series' WHEN contains(lower(model), 'claude') THEN 'claude' WHEN contains(lower(model), 'gemini') "
         "THEN 'gemini' WHEN contains(lower(model), 'phi') THEN 'phi' WHEN contains(lower(model), 'deepseek') "
         "THEN 'deepseek' WHEN contains(lower(model), 'llama') THEN 'llama' ELSE 'default' END")
_FILL = ("replace(replace(replace(replace(replace(replace(replace(text, '{{', chr(1)), '}}', chr(2)), '{note}', note), "
         "'{id}', uid), '{uid}', uid), chr(1), '{'), chr(2), '}')")


SQL_BUILD_REQUESTS = f"""
WITH rws AS (SELECT item_id, text, 'benchmark.parquet' AS file_name, row_number() OVER (ORDER BY item_id) - 1 AS row_index
             FROM benchmark),
b AS (SELECT file_name || '_' || CAST(row_index AS VARCHAR) AS uid, text AS note, file_name AS input_file_name
      FROM rws WHERE text IS NOT NULL),
t AS (SELECT * FROM (VALUES {_T_VALUES}) t(name, text, model)),
x AS (SELECT b.*, t.name, t.text, t.model, {_KIND} AS kind FROM b, t)
SELECT uid, uid AS id, name AS prompt_template_name, input_file_name, {_FILL} AS prompt,
       'messages' AS completion_format, model, kind AS request_kind,
       CAST(CASE WHEN kind = 'o-series' THEN 1.0 WHEN kind NOT IN ('claude', 'gemini') THEN 0.0 END AS DOUBLE) AS temperature,
       CAST(CASE WHEN kind = 'o-series' THEN 1.0 WHEN kind NOT IN ('claude', 'gemini') THEN 1.0 END AS DOUBLE) AS top_p,
       CASE WHEN kind NOT IN ('o-series', 'claude', 'gemini') THEN {MAX_TOKENS} END AS max_tokens,
       CASE WHEN kind = 'o-series' THEN {MAX_TOKENS} END AS max_completion_tokens
FROM x"""


@job("build_requests", SQL_BUILD_REQUESTS)
def build_requests(spark, d):
    """Input rows x prompt templates -> filled prompts with default uids and provider-shaped request settings."""
    return pr.build_requests(inputs.benchmark_rows(spark, d), FIXTURE_TEMPLATES, "text", file_col="file_name",
                             index_col="row_index", max_tokens=MAX_TOKENS, temperature=0.0, top_p=1.0)


_EXTRACT = ("coalesce(" + strip(f"json_extract_string({strict_json('llm_output_json_raw')}, '$.choices[0].message.content')")
            + ", llm_output_json_raw)")
_CMP = ("'Conversation History:' || chr(10) || coalesce(i.convo_history, '') || chr(10) || chr(10) || 'Response A:' || chr(10) "
        "|| coalesce(i.counselor_message, '') || chr(10) || chr(10) || 'Response B:' || chr(10) || coalesce(c.extracted_completion, '')")


@job("comparison_items", with_(inputs.STATIC_ITEMS_SQL, inputs.COMPLETIONS_SQL, f"""
c AS (SELECT *, {_EXTRACT} AS extracted_completion FROM completions)""") + f"""
SELECT i.uid, i.conversation_id, i.convo_history, i.counselor_message, c.llm_output_json_raw, c.file_name,
       c.prompt_template_name, c.extracted_completion, {_CMP} AS comparison_input
FROM items i JOIN c ON c.uid = i.uid""")
def comparison_items(spark, d):
    """Static items x union of completion files -> extracted completion text -> Response A/B comparison input."""
    completions = pr.union_completions(inputs.completion_frames(spark, d))
    return pr.join_comparison(inputs.static_items(spark, d), completions)


@job("comparison_orphans", with_(inputs.STATIC_ITEMS_SQL, inputs.COMPLETIONS_SQL, """
a AS (SELECT DISTINCT uid FROM items), b AS (SELECT DISTINCT uid FROM completions)""") + """
SELECT count(a.uid) AS n_input_uids, count(b.uid) AS n_completion_uids, count(a.uid) - count(b.uid) AS missing_count,
       CAST(count_if(b.uid IS NULL) AS BIGINT) AS n_items_without_completion, CAST(count_if(a.uid IS NULL) AS BIGINT) AS n_completions_without_item
FROM a FULL JOIN b ON a.uid = b.uid""")
def comparison_orphans(spark, d):
    """Distinct-uid counts on both sides of the comparison join and the keys on one side only."""
    completions = pr.union_completions(inputs.completion_frames(spark, d))
    return pr.orphan_check(inputs.static_items(spark, d), completions)


# Fixed value for the fixture run: editor prompt text.
EDITOR_PROMPT = "  Edit the draft so it sounds warm and brief.  "


@job("two_call_inputs", with_(inputs.STATIC_ITEMS_SQL, inputs.COMPLETIONS_SQL, f"""
base AS (SELECT uid, {_EXTRACT} AS base_prompt_response FROM completions WHERE file_name = 'model-a'),
cop AS (SELECT uid, convo_history AS conversation FROM items)""") + f"""
SELECT uid,
       'Conversation history:' || chr(10) || chr(10) || coalesce(conversation, '') || chr(10) || chr(10)
         || 'New message from counselor:' || coalesce(base_prompt_response, '') AS second_call_prompt_input,
       {q(EDITOR_PROMPT.strip())} || chr(10) || chr(10) || 'Conversation history:' || chr(10) || coalesce(conversation, '')
         || chr(10) || chr(10) || 'New message from counselor:' || chr(10) || coalesce(base_prompt_response, '')
         || chr(10) || 'Output: ' AS editor_input
FROM base JOIN cop USING (uid)""")
def two_call_inputs(spark, d):
    """Base replies x copilot rows on uid -> second-call prompt input (two columns kept) and editor input."""
    a = inputs.completion_frames(spark, d)[0]
    base = a.select("uid", pr.completion_text(F.col("llm_output_json_raw")).alias("base_prompt_response"))
    copilot = inputs.static_items(spark, d).select("uid", F.col("convo_history").alias("conversation"))
    j = base.join(copilot, "uid", "inner")
    second = pr.second_call_inputs(base, copilot)
    editor = j.select("uid", pr.editor_text(F.lit(EDITOR_PROMPT), F.col("conversation"),
                                            F.col("base_prompt_response")).alias("editor_input"))
    return second.join(editor, "uid")


MANIFEST_JOIN_SQL = with_(inputs.MANIFEST_SQL, """
j AS (SELECT coalesce(r.custom_id, m.custom_id) AS custom_id, r.content, r.error, m.dataset_item_id, m.uid,
             CASE WHEN r.custom_id IS NULL THEN 'pending' WHEN m.custom_id IS NULL THEN 'unknown_id'
                  WHEN r.error IS NOT NULL THEN 'error' ELSE 'ok' END AS status
      FROM results r FULL JOIN manifest m ON r.custom_id = m.custom_id)""")


@job("manifest_join", MANIFEST_JOIN_SQL + "SELECT * FROM j")
def manifest_join(spark, d):
    """Batch results x manifest on custom_id with ok / error / unknown_id / pending status."""
    return rn.join_manifest(inputs.batch_results(spark, d), inputs.batch_manifest(spark, d))


@job("manifest_status", MANIFEST_JOIN_SQL + "SELECT status, count(*) AS n FROM j GROUP BY status")
def manifest_status(spark, d):
    """Run counters: requests per status."""
    return rn.run_counts(rn.join_manifest(inputs.batch_results(spark, d), inputs.batch_manifest(spark, d)))


# Fixed values for the fixture run: eval prompts, the requested subset and one ablation addendum.
FIXTURE_EVAL_PROMPTS = [
    {"name": "presenting_concern", "text": "Rate the concern.\n{{note}}"},
    {"name": "language_patterns", "text": "Rate the language.\n{{note}}"},
    {"name": "empathy", "text": "Rate empathy.\n{{note}}"},
    {"name": "unused", "text": "Never selected.\n{{note}}"},
]
SELECTED_EVALS = ["presenting_concern", "language_patterns", "empathy"]
ABLATIONS = {"empathy": "\nAblation: ignore tone."}
RUN = "run-a"

_EP_VALUES = ", ".join(f"({q(p['name'])}, {q(p['text'] + ABLATIONS.get(p['name'], ''))})"
                       for p in FIXTURE_EVAL_PROMPTS if p["name"] in SELECTED_EVALS)
_PCMP = ("'Conversation History:' || chr(10) || coalesce(convo_history, '') || chr(10) || chr(10) "
         "|| 'Response A (Human Counselor):' || chr(10) || coalesce(expected_output, '') || chr(10) || chr(10) "
         "|| 'Response B (AI Copilot):' || chr(10) || coalesce(copilot_output, '')")
_CONCERN = r"regexp_extract(profile_prompt, '(?s)(Presenting Concern:.*?)\n\*\*\* Communication patterns \*\*\*', 1)"
_LANGEX = r"regexp_extract(profile_prompt, '(?s)(\*\*\* Language examples \*\*\*.*?)(?:MUST FOLLOW THESE GUIDELINES:|\z)', 1)"
_SECTION = (f"CASE WHEN eval_name = 'presenting_concern' AND {_CONCERN} <> '' THEN chr(10) || chr(10) || "
            f"'Patient Profile Details:' || chr(10) || {strip(_CONCERN)} "
            f"WHEN eval_name = 'language_patterns' AND {_LANGEX} <> '' THEN chr(10) || chr(10) || {strip(_LANGEX)} ELSE '' END")


@job("eval_payloads", with_(inputs.ST_RUN_SQL, f"""
fi AS (SELECT d.* FROM ditems d LEFT JOIN strace t ON t.trace_id = d.source_trace_id
       WHERE coalesce(d.generation_run_name, t.run_name) = '{RUN}'),
ri AS (SELECT r.trace_id, r.dataset_item_id, fi.convo_history, fi.expected_output, fi.profile_prompt, tr.output AS copilot_output
       FROM ritems r JOIN fi ON fi.dataset_item_id = r.dataset_item_id JOIN strace tr ON tr.trace_id = r.trace_id
       WHERE r.run_name = '{RUN}'),
ep AS (SELECT * FROM (VALUES {_EP_VALUES}) e(eval_name, template))""") + f"""
SELECT trace_id, dataset_item_id, eval_name, replace(template, '{{{{note}}}}', {_PCMP}) || {_SECTION} AS prompt
FROM ri, ep""")
def eval_payloads(spark, d):
    """Items of the run (own run name, else the source trace's) x run items x traces x selected eval prompts."""
    items = pr.filter_run_items(inputs.st_dataset_items(spark, d), inputs.st_traces(spark, d), RUN)
    run_items = inputs.st_run_items(spark, d).filter(F.col("run_name") == RUN)
    return pr.join_payloads(run_items, items, inputs.st_traces(spark, d), FIXTURE_EVAL_PROMPTS,
                            selected=SELECTED_EVALS, ablations=ABLATIONS)


# Fixed values for the fixture run: experiment dimensions ('' = none) and the profile sample.
GRID_DIMS = {"counselor_prompt": ["cp_basic", "cp_rag"], "editor_prompt": ["", "ed_v1"],
             "phase": ["", "phased"], "model": ["gpt-4.1", "gpt-5-mini", "gpt-5.2"]}
GRID_SAMPLE, GRID_SEED = 6, 16


def _values(name, vals):
    return f"(VALUES {', '.join('(' + q(v) + ')' for v in vals)}) {name}_t({name})"


@job("experiment_grid", f"""
WITH s AS (SELECT * FROM part ORDER BY md5(concat_ws(':', CAST(p_partkey AS VARCHAR), '{GRID_SEED}')), p_partkey
           LIMIT {GRID_SAMPLE})
SELECT lower(p_type) || '_' || CAST(p_partkey AS VARCHAR) AS profile_key, {', '.join(GRID_DIMS)}
FROM s, {', '.join(_values(k, v) for k, v in GRID_DIMS.items())}""")
def experiment_grid(spark, d):
    """k seeded profiles x counselor prompt x editor prompt x phase x model."""
    part = inputs.table(spark, d, "part")
    sampled = rn.sample_profiles(part, GRID_SAMPLE, GRID_SEED, "p_partkey")
    profiles = sampled.select(F.concat(F.lower("p_type"), F.lit("_"), F.col("p_partkey").cast("string")).alias("profile_key"))
    return rn.experiment_grid(profiles, GRID_DIMS)


# Fixed values for the fixture run: requested profile names (prefixes, exact keys, misses, 'all').
REQUESTED = ["asia", "africa_0", "nosuch", "asia", "europe_x", "america", "all"]


def _first_positions():
    out = {}
    for i, r in enumerate(REQUESTED):
        out.setdefault(r, i)
    return out


_REQ_VALUES = ", ".join(f"({q(r)}, {i})" for r, i in _first_positions().items() if r != "all")
_ALL_POS = _first_positions().get("all")
SELECTION_SQL = with_(inputs.PROFILE_KEYS_SQL, f"""
req AS (SELECT * FROM (VALUES {_REQ_VALUES}) r(request, req_pos)),
isk AS (SELECT request FROM req WHERE request IN (SELECT key FROM pkeys)),
hits AS (
  SELECT k.key, r.req_pos, '' AS sub FROM pkeys k JOIN req r ON r.request = k.key
  UNION ALL
  SELECT k.key, r.req_pos, k.key FROM pkeys k JOIN req r ON starts_with(k.key, r.request || '_')
  WHERE r.request NOT IN (SELECT request FROM isk)
  {"UNION ALL SELECT key, " + str(_ALL_POS) + ", lpad(CAST(key_pos AS VARCHAR), 20, '0') FROM pkeys" if _ALL_POS is not None else ""})""")


@job("expand_selection", SELECTION_SQL + """
SELECT key, req_pos, sub AS sub_order,
       CASE WHEN regexp_replace(key, '_[^_]*$', '') = '' THEN key ELSE regexp_replace(key, '_[^_]*$', '') END AS category
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY req_pos, sub) AS rn FROM hits) WHERE rn = 1""")
def expand_selection(spark, d):
    """Requested names (all / exact / prefix) -> ordered, de-duplicated profile keys with their category."""
    selected, _ = rn.expand_selection(REQUESTED, inputs.profile_keys(spark, d))
    return selected.withColumn("category", rn.derive_category(F.col("key")))


@job("expand_selection_misses", SELECTION_SQL + """
SELECT req_pos, request FROM req WHERE req_pos NOT IN (SELECT req_pos FROM hits)""")
def expand_selection_misses(spark, d):
    """Requested names that matched no profile key."""
    _, misses = rn.expand_selection(REQUESTED, inputs.profile_keys(spark, d))
    return misses


@job("upsert_latest", """
WITH w AS (SELECT 'ds-' || event_type AS dataset, 'user_' || CAST(user_id AS VARCHAR) AS profile_key, value AS payload,
                  ts AS written_at, event_id AS write_id FROM events)
SELECT sha256('dynamic-evals::' || dataset || '::' || profile_key) AS item_id, dataset, profile_key, payload, written_at, write_id
FROM (SELECT *, row_number() OVER (PARTITION BY dataset, profile_key ORDER BY written_at DESC, write_id DESC) AS rn FROM w)
WHERE rn = 1""")
def upsert_latest(spark, d):
    """Item writes -> deterministic item id sha256('dynamic-evals::<dataset>::<profile>') -> latest write wins."""
    latest = rn.upsert_latest(inputs.item_writes(spark, d), ["dataset", "profile_key"], ["written_at", "write_id"])
    return latest.select(rn.stable_item_id(F.col("dataset"), F.col("profile_key")).alias("item_id"), "dataset",
                         "profile_key", "payload", "written_at", "write_id")


RUN_DATASET = "dataset-click"


@job("run_discovery", f"""
WITH t AS (SELECT event_id AS trace_id, CASE WHEN value > 1 THEN 'generated-conversation' ELSE 'other' END AS name,
                  ['dataset-' || event_type || '/run-' || CAST(dayofmonth(ts) % 3 AS VARCHAR), 'misc'] AS tags FROM events),
tg AS (SELECT trace_id, name, unnest(tags) AS tag FROM t),
runs AS (SELECT DISTINCT substr(tag, {len(RUN_DATASET) + 2}) AS run_name FROM tg WHERE starts_with(tag, '{RUN_DATASET}/'))
SELECT r.run_name, count(tg.trace_id) AS n_traces
FROM runs r LEFT JOIN tg ON tg.tag = '{RUN_DATASET}/' || r.run_name AND tg.name = 'generated-conversation'
GROUP BY r.run_name""")
def run_discovery(spark, d):
    """Run names from ``dataset/run`` tags, then the generated-conversation traces of each run."""
    return rn.traces_per_run(inputs.tagged_traces(spark, d), RUN_DATASET)
