"""Jobs that read files: fixture rows are written as CSV or JSON lines to the shared folder and read back by the scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.functions.text import collapse_ws
from parley.operators import judge as jg
from parley.operators import prompts as pr
from parley.operators import runs as rn
from parley.operators.conversation import render_transcript
from parley.operators.retrieval import record_to_query
from parley.plans import inputs
from parley.plans import join_jobs, judge_jobs  # noqa: F401 - their oracle SQL is reused below
from parley.plans.registry import ORACLE, job
from parley.plans.sqlparts import TRANSCRIPTS, with_
from parley.session import ensure_checkpoint_dir
from parley.sources import files, upsert


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/parley-files/{name}-{uuid.uuid4().hex}"


@job("csv_rows", "SELECT doc_id, text, lang, n_chars FROM documents")
def csv_rows(spark, d):
    """Documents written as CSV files (quoted text with line ends) and read back from their directory."""
    path = _folder(spark, "csv")
    files.sink_csv(inputs.table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars"), path)
    rows = files.scan_csv_dir(spark, path, "doc_id bigint, text string, lang string, n_chars bigint", multiline=True)
    return rows.select("doc_id", "text", "lang", "n_chars")


_EXTRACT = ORACLE["extract_completions"]
assert "FROM clines WHERE " in _EXTRACT
_ESCAPED = "replace(replace(line, chr(13), '\\r'), chr(10), '\\n')"  # as the writer below


@job("jsonl_completions", f"""
SELECT prompt_template_name, content, input_file_name, status, error, normalized_text
FROM ({_EXTRACT.replace("FROM clines WHERE ", f"FROM (SELECT * REPLACE ({_ESCAPED} AS line) FROM clines) clines WHERE ")})""")
def jsonl_completions(spark, d):
    """Completion lines written as JSONL files, scanned from their directory (blank lines skipped) and extracted."""
    path = _folder(spark, "jsonl")
    lines = inputs.completion_lines(spark, d)
    escaped = F.replace(F.replace("line", F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))  # a line of a file has no line end inside
    lines.select(escaped.alias("line")).write.text(path)
    out = jg.completion_extract(files.scan_jsonl(spark, path), pos_col="line_hash")
    return out.select("prompt_template_name", "content", "input_file_name", "status", "error", "normalized_text")


N_FILES = 3
_ROWS = "SELECT item_id, text, 'benchmark.parquet' AS file_name, row_number() OVER (ORDER BY item_id) - 1 AS row_index\n             FROM benchmark"
assert _ROWS in join_jobs.SQL_BUILD_REQUESTS


@job("build_requests_csv", join_jobs.SQL_BUILD_REQUESTS.replace(_ROWS, f"""
             SELECT item_id, text, 'rows=' || item_id % {N_FILES} AS file_name, row_number() OVER (PARTITION BY item_id % {N_FILES} ORDER BY item_id) - 1 AS row_index
             FROM benchmark"""))
def build_requests_csv(spark, d):
    """Prompt rows in several CSV files -> uids from file and position, found from the splits -> requests.

    The names of the files that Spark writes are random, so each file goes by the name of its folder.
    """
    path = _folder(spark, "prompt-rows")
    rows = inputs.table(spark, d, "benchmark").select("item_id", "text", F.concat(F.lit("rows="), F.col("item_id") % N_FILES).alias("file"))
    for name in [f"rows={i}" for i in range(N_FILES)]:
        files.sink_csv(rows.where(F.col("file") == name).select("item_id", "text").coalesce(1).sortWithinPartitions("item_id"), f"{path}/{name}")
    scan = spark.read.schema("item_id bigint, text string").option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/*/*.csv")
    placed = files.row_positions(scan).withColumn("file_name", F.element_at(F.split("file_path", "/"), -2))
    return pr.build_requests(placed, join_jobs.FIXTURE_TEMPLATES, "text", file_col="file_name", index_col="row_index", max_tokens=join_jobs.MAX_TOKENS,
                             temperature=0.0, top_p=1.0)


N_SPLITS = 25


@job("split_merge", f"""
WITH p AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id, text) - 1 AS position, count(*) OVER () AS total FROM documents)
SELECT doc_id, position, CAST(position * {N_SPLITS} // total AS INTEGER) AS piece, sha256(text) AS text_sha256 FROM p""")
def split_merge(spark, d):
    """Documents -> 25 contiguous pieces of JSON lines -> merged in order, every row accounted for."""
    path = _folder(spark, "split")
    files.sink_split(inputs.table(spark, d, "documents").select("doc_id", "text"), path, N_SPLITS, ["doc_id", "text"])
    merged = files.merge_split(spark, path, "doc_id bigint, text string")
    return merged.select("doc_id", "position", "piece", F.sha2("text", 256).alias("text_sha256"))


@job("upsert_sink", ORACLE["upsert_latest"])
def upsert_sink(spark, d):
    """Item writes of the second half of a month, of the first, and of the second again, upserted into one table, which is read back."""
    path, writes = _folder(spark, "items"), inputs.item_writes(spark, d)
    writes = writes.select(rn.stable_item_id(F.col("dataset"), F.col("profile_key")).alias("item_id"), "dataset", "profile_key", "payload", "written_at", "write_id")
    upsert.create_table(spark, path, writes.schema, ["dataset", "profile_key"], ["written_at", "write_id"], n_buckets=8)
    late = F.dayofmonth("written_at") > 15
    for batch in (writes.where(late), writes.where(F.coalesce(~late, F.lit(True))), writes.where(late)):
        upsert.upsert(batch, path)
    return upsert.read_table(spark, path)


FILTERS = {"lang": ["de", "fr"], "source": ["src1"]}


@job("jsonl_filter", """
SELECT doc_id, lang, source, sha256(CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN text || chr(10) || 'Reply.' ELSE text END) AS query_sha256
FROM documents WHERE (lang IN ('de', 'fr') OR source IN ('src1')) AND text <> ''""")
def jsonl_filter(spark, d):
    """Prompt records (a prompt, or messages) written as JSONL -> any of two metadata filters -> the record's query text."""
    path = _folder(spark, "records")
    docs = inputs.table(spark, d, "documents").where("text <> ''")
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")), F.struct(F.lit("user").alias("role"), F.lit("Reply.").alias("content")))
    records = docs.select(F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("body"), F.when(F.col("doc_id") % 3 == 2, F.col("text")).alias("prompt"),
                          F.when(F.col("doc_id") % 3 == 1, said).alias("messages"), F.struct("doc_id", "lang", "source").alias("metadata"))
    files.sink_jsonl(records, path)
    kept = files.scan_jsonl_filter(files.scan_jsonl(spark, path), FILTERS)

    def field(name, kind):
        return F.try_variant_get("doc", f"$.{name}", kind)

    query = record_to_query(field("body", "string"), field("prompt", "string"), field("messages", "array<struct<role:string,content:string>>"),
                            field("metadata", "struct<doc_id:bigint>"))
    return kept.select(field("metadata.doc_id", "bigint").alias("doc_id"), field("metadata.lang", "string").alias("lang"),
                       field("metadata.source", "string").alias("source"), F.sha2(query, 256).alias("query_sha256"))


N_TEXTS = 16


@job("wholetext_files", with_(TRANSCRIPTS) + f"""
SELECT conv_id % {N_TEXTS} AS file_no, length(t) AS n_chars, sha256(t) AS text_sha256
FROM (SELECT conv_id % {N_TEXTS} AS conv_id, trim(regexp_replace(string_agg(conversation, chr(10) ORDER BY conv_id), '\\s+', ' ', 'g')) AS t FROM tr GROUP BY ALL)""")
def wholetext_files(spark, d):
    """Transcripts in text files -> one row per whole file -> white space collapsed."""
    path = _folder(spark, "texts")
    rows = render_transcript(inputs.turns(spark, d)).withColumn("file_no", F.col("conv_id") % N_TEXTS)
    rows.repartition("file_no").sortWithinPartitions("file_no", "conv_id").select("file_no", "conversation").write.partitionBy("file_no").text(path)
    scan = files.scan_wholetext(spark, f"{path}/*/*.txt")
    named = scan.select(F.regexp_extract("file_path", "file_no=([0-9]+)", 1).cast("bigint").alias("file_no"), collapse_ws("text").alias("t"))
    return named.select("file_no", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


MAX_SAMPLES = 10


@job("request_samples", join_jobs.SQL_BUILD_REQUESTS + f" ORDER BY uid, prompt_template_name LIMIT {MAX_SAMPLES}")
def request_samples(spark, d):
    """The first requests by uid and template, as for a smoke test."""
    return pr.limit_samples(join_jobs.build_requests(spark, d), MAX_SAMPLES)
