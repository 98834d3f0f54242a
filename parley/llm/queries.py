"""Queries of this package, with their DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.tables import table

from . import (alignment, chat_format, decontaminate, line_dedup, ngram_join, packing, quality_rules, secret_scan, spelling,
               suffix_dedup, token_store, toxicity, url_filter)
from .common import shared_dir, written

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def job(name: str, sql: str | None = None):
    def add(fn):
        JOBS[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@job("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line dedup: its lines with a word, how many went, and the digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select(
        "doc_id", F.col("__n_lines").cast("bigint").alias("n_lines"), F.col("__n_removed").cast("bigint").alias("n_removed"),
        F.length("text").cast("bigint").alias("kept_chars"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[g.i:g.i + 4], ' ')) AS s FROM words, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS g(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM words UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT words.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, min(reach.r) AS component_id
FROM words LEFT JOIN sizes ON sizes.doc_id = words.doc_id JOIN reach ON reach.d = words.doc_id GROUP BY ALL
"""


@job("op2_ngram_join", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by shingle similarity."""
    return ngram_join.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@job("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the base kinds, their digest, and all spans."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


@job("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, g.i, substring(h, 2 * g.i + 1, 200) AS w FROM d, unnest(generate_series(0, length(h) // 2 - 100)) AS g(i)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY hash(w), md5(w) ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
runs AS (
  SELECT doc_id, i, sum(CASE WHEN i > p + 100 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM repeated)),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY ALL),
pieces AS (
  SELECT spans.doc_id, a, b, substring(h, 2 * coalesce(lag(b) OVER (PARTITION BY spans.doc_id ORDER BY a), 0) + 1,
         2 * (a - coalesce(lag(b) OVER (PARTITION BY spans.doc_id ORDER BY a), 0))) AS before
  FROM spans JOIN d ON d.doc_id = spans.doc_id),
per AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed, string_agg(before, '' ORDER BY a) AS kept, max(b) AS last FROM pieces GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN per ON per.doc_id = d.doc_id
"""


@job("op5_suffix_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 100-byte strings."""
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@job("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT doc_id, g.i, array_to_string(ws[g.i:g.i + 7], ' ') AS w
  FROM d, unnest(generate_series(1, len(ws) - 7)) AS g(i)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT doc_id, sum(s)::BIGINT AS n FROM (
    SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS s FROM repeated)
  GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id),
bits AS (
  SELECT *, ((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 3 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words) THEN 16 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > word_chars AND n_words > 0 THEN 32 ELSE 0 END))::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
       failed_bits = 0 AS kept, failed_bits
FROM bits
"""


@job("op7_quality_rules", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ledger of every document under policy v1."""
    led = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return quality_rules.apply_policy(led, quality_rules.POLICIES["v1"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(regexp_replace(role, '([\\#<:])', '_\1', 'g')) + 2 + length(regexp_replace(text, '([\\#<])', '_\1', 'g')) + 8)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@job("op8_chat_format", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings: formatted, written, and parsed back from the output."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(written(chat_format.segments(turns), "chat")).drop("valid")


@job("op9_token_store")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as blocks of bit planes and read back."""
    path = shared_dir(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.read_documents(spark, path)


OP10_SQL = r"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents
  UNION ALL SELECT 'b', item_id, list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) FROM benchmark),
shingles AS (SELECT DISTINCT kind, id, array_to_string(ws[g.i:g.i + 4], ' ') AS s FROM words, unnest(generate_series(1, len(ws) - 4)) AS g(i)),
sizes AS (SELECT id, count(*) AS q FROM shingles WHERE kind = 'b' GROUP BY id),
hits AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS common FROM shingles d JOIN shingles b ON d.kind = 'd' AND b.kind = 'b' AND d.s = b.s GROUP BY ALL),
found AS (SELECT doc_id, item_id FROM hits JOIN sizes ON sizes.id = hits.item_id WHERE 100 * common >= 75 * q)
SELECT documents.doc_id, count(found.item_id) > 0 AS contaminated, count(found.item_id)::BIGINT AS n_items,
       coalesce(string_agg(found.item_id::VARCHAR, ',' ORDER BY found.item_id), '') AS item_ids
FROM documents LEFT JOIN found ON found.doc_id = documents.doc_id GROUP BY documents.doc_id
"""


@job("op10_decontamination", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.transform("__items", lambda m: m["item_id"].cast("string")), ",")
    return found.select("doc_id", (F.size("__items") > 0).alias("contaminated"), F.size("__items").cast("bigint").alias("n_items"),
                        ids.alias("item_ids"))


OP11_SQL = r"""
WITH p AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)\A(.*?)://([^/?#]*)([^?#]*)\??([^#]*)', 2), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)\A(.*?)://([^/?#]*)([^?#]*)\??([^#]*)', 3), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '(?s)\A(.*?)://([^/?#]*)([^?#]*)\??([^#]*)', 4), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS params
  FROM pages),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '\Awww\.', ''), ':(80|443)\z', '') || rtrim(path, '/')
           || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical
  FROM p),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (
  SELECT host, path, arg_max(h || rules.p, length(h || rules.p)) AS rule, arg_max(verdict, length(h || rules.p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM c) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p)
  GROUP BY host, path),
listed AS (SELECT DISTINCT canonical FROM c WHERE page_id % 20 = 0 AND canonical IS NOT NULL)
SELECT c.page_id, c.host, c.path, best.rule, coalesce(best.verdict, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best ON best.host = c.host AND best.path = c.path LEFT JOIN listed ON listed.canonical = c.canonical
"""


@job("op11_url_filter", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL: rules, then the listed URLs (those of the pages whose id is divisible by 20)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, pages.where(F.col("page_id") % 20 == 0))
    return judged.select("page.page_id", "host", "path", "rule", "verdict")


OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS c
  FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+'), lambda r: translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY ALL),
bytes AS (SELECT *, hex(encode(doc_id || ':' || w)) AS x FROM runs),
steps AS (
  SELECT *, flatten(list_transform(generate_series(1, length(x), 2), lambda i: [256 + 16 * (strpos('0123456789ABCDEF', x[i]) - 1) + strpos('0123456789ABCDEF', x[i + 1]) - 1, 0, 0, 0, 0, 0, 0, 0, 0])) AS s
  FROM bytes),
crc AS (
  SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, s::BIGINT[]),
         lambda h, v: CASE WHEN v >= 256 THEN xor(h, v - 256) WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384::BIGINT) ELSE h >> 1 END), 4294967295::BIGINT) AS h
  FROM steps),
changed AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM crc),
words AS (SELECT word, sum(c)::BIGINT AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
less AS (SELECT word, g.i, substr(word, 1, g.i - 1) || substr(word, g.i + 1) AS d FROM words, unnest(generate_series(1, length(word)::INT)) AS g(i)),
near AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT less.word, words.word FROM less JOIN words ON words.word = less.d
  UNION SELECT words.word, less.word FROM less JOIN words ON words.word = less.d),
best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY words.n DESC, b) AS b, max(words.n) AS m FROM near JOIN words ON words.word = b GROUP BY a),
forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * words.n THEN b END AS form, CASE WHEN m >= 5 * words.n THEN m END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word),
chain AS (SELECT word, word AS r, 0 AS k FROM forms UNION ALL SELECT chain.word, forms.form, k + 1 FROM chain JOIN forms ON forms.word = chain.r WHERE forms.form IS NOT NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(r, k) AS root FROM chain GROUP BY word) USING (word)
"""


@job("op13_spelling_variants", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents (some occurrences having lost a letter, as the contract says) and the form each goes back to."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), drop_every=199))


@job("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned in every document, with the corpus counts of the linked ids."""
    return alignment.score(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id").drop("row")
