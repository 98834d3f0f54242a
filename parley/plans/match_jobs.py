"""Profile jobs: tiered matching with sampled matches, example messages and profile text."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from parley.functions.jsonx import json_from_text
from parley.functions.ranking import group_index
from parley.operators import conversation as conv
from parley.operators import match as mt
from parley.plans import inputs
from parley.plans.registry import job
from parley.plans.sqlparts import TRANSCRIPTS, with_

SEED = 16
_STD = ", ".join(f"'{c}'" for c in mt.STANDARD_CONCERNS)
_UNK = "(sex IS NULL OR sex IN ('unspecified', 'unknown'))"
_NSTD = f"NOT coalesce(concern IN ({_STD}), false)"
_SEG = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in inputs.SEGMENT_CONCERN.items()) + " END"


def _h(*parts):
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15) AS BIGINT)"


def _floyd_steps():
    ctes, prev = [], "f0"
    for i in range(mt.SAMPLE_K):
        j = f"(n - k + {i})"
        t = f"({_h('uid', f'CAST({j} AS VARCHAR)', repr(str(SEED)))} % ({j} + 1))"
        ctes.append(f"f{i + 1} AS (SELECT * EXCLUDE (s), CASE WHEN {i} < k THEN list_append(s, CASE WHEN list_contains(s, {t}) "
                    f"THEN {j} ELSE {t} END) ELSE s END AS s FROM {prev})")
        prev = f"f{i + 1}"
    return ",\n".join(ctes)


_STYLE = ", ".join(f"'{f}', '{f} ' || CAST(c_custkey % 7 AS VARCHAR)" for f in inputs.STYLE_TRAITS)
MATCH_SQL = with_(TRANSCRIPTS, f"""
traits AS (
  SELECT CAST(c_custkey AS VARCHAR) AS uid,
         'Extracted traits:' || chr(10) || json_object(
            'name', c_name,
            'age', CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'unknown'
                        ELSE CAST(18 + (c_custkey * 7) % 60 AS VARCHAR) END,
            'sex_or_gender', CASE c_nationkey % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'unknown' END,
            'job', c_mktsegment, 'residence', 'nation ' || CAST(c_nationkey AS VARCHAR),
            'socioeconomic_status', 'class ' || CAST(c_nationkey % 3 AS VARCHAR), 'key_details', 'wrote {{job}} to ' || c_name,
            {_STYLE})::VARCHAR || chr(10) || 'Done.' AS raw,
         {_SEG} AS presenting_concern
  FROM customer),
merged AS (SELECT t.* FROM traits t JOIN tr s ON CAST(s.conv_id AS VARCHAR) = t.uid JOIN tr d ON CAST(d.conv_id AS VARCHAR) = t.uid),
pj AS (SELECT uid, presenting_concern, CASE WHEN json_valid(b) THEN b::JSON END AS j
       FROM (SELECT *, regexp_extract(raw, '(?s)(\\{{.*\\}})', 1) AS b FROM merged)),
p AS (SELECT uid, TRY_CAST(json_extract_string(j, '$.age') AS DOUBLE) AS age, json_extract_string(j, '$.sex_or_gender') AS sex,
             presenting_concern AS concern, j FROM pj),
mem0 AS (
  SELECT 'C' AS tier, concern AS gkey, 0.0 AS slot_age, uid FROM p WHERE concern IS NOT NULL
  UNION ALL SELECT 'CA', concern, age, uid FROM p WHERE concern IS NOT NULL AND age IS NOT NULL
  UNION ALL SELECT 'CS', concern || chr(1) || sex, 0.0, uid FROM p WHERE concern IS NOT NULL AND sex IS NOT NULL
  UNION ALL SELECT 'ASC', concern || chr(1) || sex, age, uid FROM p WHERE concern IS NOT NULL AND sex IS NOT NULL AND age IS NOT NULL
  UNION ALL SELECT 'S', sex, 0.0, uid FROM p WHERE sex IS NOT NULL
  UNION ALL SELECT 'A', '', age, uid FROM p WHERE age IS NOT NULL
  UNION ALL SELECT 'AS', sex, age, uid FROM p WHERE sex IS NOT NULL AND age IS NOT NULL),
mem AS (SELECT tier, gkey, slot_age, uid,
               row_number() OVER (PARTITION BY tier, gkey ORDER BY slot_age, h, uid) - 1 AS rank
        FROM (SELECT *, {_h('uid', repr(str(SEED)))} AS h FROM mem0)),
t AS (SELECT *, CASE WHEN {_NSTD} AND age IS NULL THEN 'S' WHEN {_NSTD} AND {_UNK} THEN 'A' WHEN {_NSTD} THEN 'AS'
                     WHEN age IS NULL AND {_UNK} THEN 'C' WHEN {_UNK} THEN 'CA' WHEN age IS NULL THEN 'CS' ELSE 'ASC' END AS tier0
      FROM p),
tk AS (SELECT *, CASE tier0 WHEN 'C' THEN concern WHEN 'CA' THEN concern WHEN 'CS' THEN concern || chr(1) || sex
                            WHEN 'ASC' THEN concern || chr(1) || sex WHEN 'S' THEN sex WHEN 'A' THEN '' ELSE sex END AS gk0,
              tier0 IN ('CA', 'ASC', 'A', 'AS') AS band0 FROM t),
ia AS (SELECT tk.uid, count(m.uid) AS cnt, min(m.rank) AS lo FROM tk JOIN mem m ON m.tier = tk.tier0 AND m.gkey = tk.gk0
         AND (NOT tk.band0 OR (m.slot_age >= tk.age - 3 AND m.slot_age <= tk.age + 3)) GROUP BY tk.uid),
sa AS (SELECT tk.uid, m.rank AS self_rank FROM tk JOIN mem m ON m.tier = tk.tier0 AND m.uid = tk.uid),
ic AS (SELECT tk.uid, count(m.uid) AS cnt, min(m.rank) AS lo FROM tk JOIN mem m ON m.tier = 'C' AND m.gkey = tk.concern GROUP BY tk.uid),
sc AS (SELECT tk.uid, m.rank AS self_rank FROM tk JOIN mem m ON m.tier = 'C' AND m.uid = tk.uid),
x AS (SELECT tk.uid, tk.tier0, tk.gk0, tk.concern,
             coalesce(ia.cnt - CASE WHEN sa.self_rank IS NOT NULL THEN 1 ELSE 0 END, 0) AS n1, ia.lo AS lo1, sa.self_rank AS s1,
             coalesce(ic.cnt - CASE WHEN sc.self_rank IS NOT NULL THEN 1 ELSE 0 END, 0) AS n2, ic.lo AS lo2, sc.self_rank AS s2
      FROM tk LEFT JOIN ia ON ia.uid = tk.uid LEFT JOIN sa ON sa.uid = tk.uid
              LEFT JOIN ic ON ic.uid = tk.uid LEFT JOIN sc ON sc.uid = tk.uid),
y AS (SELECT uid, CASE WHEN n1 >= {mt.MIN_MATCHES} THEN tier0 ELSE 'C' END AS tier,
             CAST(CASE WHEN n1 >= {mt.MIN_MATCHES} THEN n1 ELSE n2 END AS BIGINT) AS n,
             CASE WHEN n1 >= {mt.MIN_MATCHES} THEN lo1 ELSE lo2 END AS lo,
             CASE WHEN n1 >= {mt.MIN_MATCHES} THEN s1 ELSE s2 END AS sr,
             CASE WHEN n1 >= {mt.MIN_MATCHES} THEN gk0 ELSE concern END AS gkey FROM x),
f0 AS (SELECT *, least({mt.SAMPLE_K}, n) AS k, CAST([] AS BIGINT[]) AS s FROM y),
{_floyd_steps()},
picks AS (SELECT uid, tier, n, lo, sr, gkey, s, unnest(range(len(s))) AS match_idx FROM f{mt.SAMPLE_K}),
pr AS (SELECT *, lo + s[match_idx + 1] AS r0 FROM picks),
pr2 AS (SELECT *, CASE WHEN sr IS NOT NULL AND r0 >= sr THEN r0 + 1 ELSE r0 END AS rnk FROM pr),
matches AS (
  SELECT pr2.uid, pr2.tier, pr2.n AS n_matches, CAST(pr2.match_idx AS BIGINT) AS match_idx, m.uid AS match_uid
  FROM pr2 LEFT JOIN mem m ON m.tier = pr2.tier AND m.gkey = pr2.gkey AND m.rank = pr2.rnk
  UNION ALL
  SELECT uid, tier, n, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM f{mt.SAMPLE_K} WHERE len(s) = 0)""")


def _profiles(spark, d):
    """traits x sampled x de-identified on uid -> (uid, age, sex, concern, trait fields)."""
    traits = inputs.client_traits(spark, d)
    sampled, deid = inputs.sampled_conversations(spark, d)
    merged = traits.join(sampled.select("uid"), "uid").join(deid.select("uid"), "uid")
    v = json_from_text(F.col("client_traits_obscured_json_raw"))
    return merged.select("uid", F.try_variant_get(v, "$.age", "string").try_cast("double").alias("age"),
                         F.try_variant_get(v, "$.sex_or_gender", "string").alias("sex"),
                         F.col("presenting_concern").alias("concern"),
                         *mt.traits_expand(F.col("client_traits_obscured_json_raw")))


@job("match_profiles", MATCH_SQL + "SELECT * FROM matches")
def match_profiles(spark, d):
    """Traits JSON -> tiered demographic matches (count + seeded sample of 5), never listing all pairs."""
    return mt.match_profiles(_profiles(spark, d), seed=SEED)


# Fixed value for the fixture run: profile prompt template (the reference's prose is not reproduced).
PROFILE_TEMPLATE = ("*** Personal details ***\nName: {name}\nAge: {age}\nSex: {sex_or_gender}\nJob: {job}\n"
                    "Residence: {residence}\nStatus: {socioeconomic_status}\nPresenting Concern: {presenting_concern}\n"
                    "Details: {key_details}\n\n\n\n*** Style ***\n{language_patterns}\n{emotional_expression_vulnerability}\n"
                    "{depth_pacing_of_disclosure}\n{engagement_response_to_support}\n{focus_structure_of_discussion}\n\n"
                    "*** Language examples ***\n{examples}\n")

def _fill_sql():
    parts = []
    for piece in re.split(r"(\{\w+\})", PROFILE_TEMPLATE):
        if not piece.startswith("{"):
            parts.append("'" + piece.replace("\n", "' || chr(10) || '") + "'")
        elif piece in ("{presenting_concern}", "{examples}"):
            parts.append(f"coalesce({ {'{presenting_concern}': 'concern', '{examples}': 'examples'}[piece]}, '')")
        else:
            parts.append(f"coalesce(json_extract_string(j, '$.{piece[1:-1]}'), '')")
    filled = " || ".join(parts)
    return f"regexp_replace(regexp_replace({filled}, '^\\s+|\\s+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


@job("sample_examples", MATCH_SQL.replace("WITH ", "WITH ", 1) + """,
cl AS (
  SELECT conv_id, pos - 1 AS line_no, """ + "regexp_replace(parts[pos], '^\\s+|\\s+$', '', 'g')" + """ AS line
  FROM (SELECT conv_id, parts, unnest(generate_series(1, len(parts))) AS pos
        FROM (SELECT conv_id, string_split(regexp_replace(conversation, '^\\s+|\\s+$', '', 'g'), chr(10)) AS parts FROM tr))),
cf AS (SELECT *, starts_with(lower(line), 'client:') AS is_client FROM cl),
cr AS (SELECT *, sum(CASE WHEN is_client THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY line_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM cf),
cg AS (SELECT conv_id, run, min(line_no) AS first_line,
              string_agg(regexp_replace(line, '(?i)^client:\\s*', ''), ' // ' ORDER BY line_no) AS message
       FROM cr WHERE is_client GROUP BY conv_id, run),
cms AS (SELECT CAST(conv_id AS VARCHAR) AS uid, row_number() OVER (PARTITION BY conv_id ORDER BY first_line) - 1 AS msg_idx, message FROM cg),
cnt AS (SELECT uid AS match_uid, count(*) AS tt FROM cms GROUP BY uid),
j1 AS (SELECT m.uid, m.match_idx, m.match_uid, c.msg_idx, c.message, t.tt FROM matches m
       JOIN cnt t ON t.match_uid = m.match_uid JOIN cms c ON c.uid = m.match_uid WHERE m.match_uid IS NOT NULL),
j2 AS (SELECT * FROM j1 WHERE CASE WHEN floor((match_idx + 1) * tt / 5.0) > floor(match_idx * tt / 5.0)
                                   THEN msg_idx >= floor(match_idx * tt / 5.0) AND msg_idx < floor((match_idx + 1) * tt / 5.0)
                                   ELSE true END),
j3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid, match_idx ORDER BY """
    + _h("uid", "match_uid", "CAST(msg_idx AS VARCHAR)", repr(str(SEED))) + """) AS r1 FROM j2) WHERE r1 <= 9),
j4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY """
    + _h("uid", "'all'", "match_uid", "CAST(msg_idx AS VARCHAR)", repr(str(SEED))) + """) AS r2 FROM j3) WHERE r2 <= 45),
ex AS (SELECT uid, count(*) AS n_examples, string_agg(message, ' // ' ORDER BY match_idx, msg_idx) AS examples FROM j4 GROUP BY uid),
prof AS (SELECT p.uid, p.j, p.concern, coalesce(ex.n_examples, 0) AS n_examples, ex.examples,
                lower(replace(p.concern, ' ', '_')) AS ck, """ + _h("p.uid", repr(str(SEED))) + """ AS h
         FROM p LEFT JOIN ex ON ex.uid = p.uid)
SELECT uid, ck || '_' || CAST(row_number() OVER (PARTITION BY ck ORDER BY h, uid) - 1 AS VARCHAR) AS profile_key,
       n_examples, """ + _fill_sql() + """ AS prompt
FROM prof""")
def sample_examples(spark, d):
    """Matches -> slice i/5 of each match's client messages (<= 9 each, <= 45 total) -> profile text and concern_i key."""
    from parley.session import cut_lineage
    profiles = cut_lineage(_profiles(spark, d))  # read by the matcher and by the profile text below
    matches = mt.match_profiles(profiles, seed=SEED, input_materialized=True)
    sampled, _ = inputs.sampled_conversations(spark, d)
    cms = conv.client_messages(sampled, id_col="uid")
    ex = mt.sample_examples(matches, cms, seed=SEED)
    agg = ex.groupBy("uid").agg(F.count(F.lit(1)).alias("n_examples"),
                                F.expr("listagg(message, ' // ') WITHIN GROUP (ORDER BY match_idx, msg_idx)").alias("examples"))
    prof = profiles.join(agg, "uid", "left").withColumn("n_examples", F.coalesce("n_examples", F.lit(0)))
    prof = prof.withColumn("ck", mt.concern_key(F.lit(None).cast("string"), F.col("concern"))) \
        .withColumn("h", mt.hash64(F.col("uid"), F.lit(SEED)))
    prof = group_index(prof, ["ck"], "h", "uid", out="ci")
    slots = {f: F.col(f"trait_{f}") for f in mt.TRAIT_FIELDS}
    slots.update({"presenting_concern": F.col("concern"), "examples": F.col("examples")})
    return prof.select("uid", F.concat(F.col("ck"), F.lit("_"), F.col("ci").cast("string")).alias("profile_key"),
                       "n_examples", mt.profile_prompt(PROFILE_TEMPLATE, slots).alias("prompt"))
