"""Shared DuckDB SQL fragments for the oracle statements (RE2 regexes, 1-based lists)."""

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


TRANSCRIPTS = """
tr AS (
  SELECT conv_id,
         string_agg(CASE role WHEN 'user' THEN 'Client: ' || text
                              WHEN 'assistant' THEN 'Counselor: ' || text
                              ELSE text END, chr(10) ORDER BY turn) AS conversation
  FROM conversations GROUP BY conv_id
)"""

LINES = """
ln AS (
  SELECT conv_id, pos - 1 AS line_no, parts[pos] AS line,
         nullif(regexp_extract(parts[pos], '^(Counselor|Patient|Therapist|Client):', 1), '') AS speaker
  FROM (SELECT conv_id, parts, unnest(generate_series(1, len(parts))) AS pos
        FROM (SELECT conv_id, string_split(conversation, chr(10)) AS parts FROM tr))
)"""

BLOCKS = """
fl AS (
  SELECT *, CASE WHEN speaker IS NOT NULL AND (prev IS NULL OR speaker <> prev) THEN 1 ELSE 0 END AS st
  FROM (SELECT *, last_value(speaker IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ln)
),
bl AS (
  SELECT *, CAST(sum(st) OVER (PARTITION BY conv_id ORDER BY line_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS block_idx FROM fl
),
blocks AS (
  SELECT conv_id, block_idx, max(speaker) AS speaker, string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM bl GROUP BY conv_id, block_idx
)"""

_MSG = strip("text")
COUNSELOR_MSG = (
    "regexp_replace(array_to_string(list_transform(string_split(" + _MSG + ", chr(10)), "
    "lambda l: CASE WHEN starts_with(l, 'Counselor:') THEN " + strip("l[11:]") + " ELSE l END), chr(10)), "
    r"'^\s+|\s+$', '', 'g')"
)

PAIRS = """
hp AS (
  SELECT *, list(text) OVER (PARTITION BY conv_id ORDER BY block_idx
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM blocks
),
pairs AS (
  SELECT conv_id AS conversation_id,
         row_number() OVER (PARTITION BY conv_id ORDER BY block_idx) - 1 AS pair_idx,
         block_idx,
         coalesce(array_to_string(prior, chr(10)), '') AS convo_history,
         """ + COUNSELOR_MSG + """ AS counselor_message
  FROM hp WHERE speaker = 'Counselor'
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def num(v: str, path: str = "$") -> str:
    """Python ``float(x)`` of a JSON value in DuckDB: booleans -> 1/0, numeric strings cast, else NULL."""
    return (f"(CASE json_type({v}, '{path}') WHEN 'BOOLEAN' THEN CASE WHEN json_extract_string({v}, '{path}') = 'true' "
            f"THEN 1.0 ELSE 0.0 END WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN NULL WHEN 'ARRAY' THEN NULL "
            f"ELSE TRY_CAST(json_extract_string({v}, '{path}') AS DOUBLE) END)")


def strict_json(s: str) -> str:
    """DuckDB twin of ``strict_parse_json``: JSON when the whole text is one valid value, else NULL."""
    return f"(CASE WHEN json_valid({s}) THEN ({s})::JSON END)"


BRACE = r"regexp_extract({s}, '(?s)(\{{.*\}})', 1)"


def json_block(s: str) -> str:
    """DuckDB twin of ``json_block`` over already fence-stripped text ``s``."""
    b = BRACE.format(s=s)
    return f"coalesce({strict_json(s)}, {strict_json(b)})"


def fence_strip(x: str) -> str:
    return strip(r"regexp_replace(" + x + r", '```(?:json)?\s*', '', 'g')")
