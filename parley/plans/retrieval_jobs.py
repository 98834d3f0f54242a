"""Retrieval jobs: new pairs, embedding cost, embedding cache, cosine top-k, RAG prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import retrieval as rv
from parley.operators.udfs import embedder, feature_embedding
from parley.plans import inputs
from parley.plans.registry import job
from parley.plans.sqlparts import BLOCKS, LINES, TRANSCRIPTS, strip, with_

RAG_PAIRS_SQL = """
hp AS (SELECT *, list(text) OVER (PARTITION BY conv_id ORDER BY block_idx
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM blocks),
rp AS (SELECT conv_id AS conversation_id, row_number() OVER (PARTITION BY conv_id ORDER BY block_idx) - 1 AS pair_idx,
              coalesce(array_to_string(prior, chr(10)), '') AS context, """ + strip("text") + """ AS response
       FROM hp WHERE speaker = 'Counselor'),
rp2 AS (SELECT *, sha256(context || chr(0) || response) AS hash FROM rp WHERE length(""" + strip("context") + """) > 0)"""

CACHE_SQL = """
cache AS (
  SELECT sha256('Client: ' || u.text || chr(0) || """ + strip("'Counselor: ' || a.text") + """) AS hash,
         """ + strip("'Counselor: ' || a.text") + """ AS response, e.embedding AS embedding, e.vec_id + 1000 AS cached_at
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = 1 AND a.role = 'assistant'
       JOIN embeddings e ON e.vec_id = u.conv_id
  WHERE u.turn = 0 AND u.role = 'user'
  UNION ALL
  SELECT sha256('Client: ' || u.text || chr(0) || """ + strip("'Counselor: ' || a.text") + """),
         """ + strip("'Counselor: ' || a.text") + """, list_reverse(e.embedding), e.vec_id
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = 1 AND a.role = 'assistant'
       JOIN embeddings e ON e.vec_id = u.conv_id
  WHERE u.turn = 0 AND u.role = 'user')"""

BASE = with_(TRANSCRIPTS, LINES, BLOCKS, RAG_PAIRS_SQL, CACHE_SQL)


def _pairs(spark, d):
    return rv.rag_pairs(inputs.transcripts(spark, d))


@job("new_pairs", BASE + """
SELECT conversation_id, pair_idx, hash, context, response, CAST(ceil(length(context) / 4.0) AS BIGINT) AS est_tokens
FROM rp2 WHERE hash NOT IN (SELECT hash FROM cache)""")
def new_pairs(spark, d):
    """Transcripts -> non-blank (context, response) pairs -> content hash -> pairs not in the cache yet."""
    fresh = rv.new_pairs(_pairs(spark, d), inputs.rag_cache(spark, d))
    return fresh.select("conversation_id", F.col("pair_idx").cast("bigint"), "hash", "context", "response",
                        rv.estimated_tokens(F.col("context")).alias("est_tokens"))


@job("embed_cost", BASE + """,
ph AS (SELECT hash, count(*) AS n, bool_or(hash IN (SELECT hash FROM cache)) AS cached, min(context) AS ctx
       FROM rp2 GROUP BY hash),
agg AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs,
               CAST(coalesce(sum(CASE WHEN cached THEN n ELSE 0 END), 0) AS BIGINT) AS n_cached,
               CAST(count_if(NOT cached) AS BIGINT) AS n_new_hashes,
               CAST(coalesce(sum(CASE WHEN NOT cached THEN ceil(length(ctx) / 4.0) END), 0) AS BIGINT) AS new_tokens
        FROM ph)
SELECT n_pairs, n_cached, n_pairs - n_cached AS n_new, n_new_hashes, new_tokens,
       round(new_tokens / 1e6 * 0.02, 8) AS est_cost FROM agg""")
def embed_cost(spark, d):
    """Pairs vs cache -> new distinct contexts -> estimated tokens x $/1M of the embedding model."""
    return rv.embed_cost(_pairs(spark, d), inputs.rag_cache(spark, d), "text-embedding-3-small")


_T = "(CASE WHEN length(context) > 32760 THEN right(context, 32760) ELSE context END)"
_FEATS = ", ".join([
    f"CAST(length({_T}) / 1000.0 AS FLOAT)",
    f"CAST((length({_T}) - length(regexp_replace({_T}, '[aeiouAEIOU]', '', 'g'))) / greatest(length({_T}), 1) AS FLOAT)",
    f"CAST((length({_T}) - length(replace({_T}, ' ', ''))) / greatest(length({_T}), 1) AS FLOAT)",
    f"CAST((length({_T}) - length(regexp_replace({_T}, '[0-9]', '', 'g'))) / greatest(length({_T}), 1) AS FLOAT)"])


@job("embedding_cache", BASE + f""",
latest AS (SELECT hash, arg_max(response, cached_at) AS response, arg_max(embedding, cached_at) AS embedding,
                  'cache' AS source FROM cache GROUP BY hash),
newh AS (SELECT DISTINCT hash, context, response FROM rp2 WHERE hash NOT IN (SELECT hash FROM latest)),
emb AS (SELECT hash, response, [{_FEATS}] AS embedding, 'new' AS source FROM newh),
merged AS (SELECT * FROM latest UNION ALL SELECT * FROM emb)""" + """
SELECT p.conversation_id, p.pair_idx, p.hash, p.context, m.response, m.source,
       round(CAST(m.embedding[1] AS DOUBLE), 6) AS e0, round(CAST(m.embedding[2] AS DOUBLE), 6) AS e1,
       round(CAST(m.embedding[3] AS DOUBLE), 6) AS e2, round(CAST(m.embedding[4] AS DOUBLE), 6) AS e3
FROM rp2 p JOIN merged m ON m.hash = p.hash""")
def embedding_cache(spark, d):
    """Active retrieval index: cached vectors (latest copy) + new contexts embedded once per hash (stub embedder)."""
    idx = rv.embedding_cache(_pairs(spark, d), inputs.rag_cache(spark, d), embedder(feature_embedding))
    return idx.select("conversation_id", F.col("pair_idx").cast("bigint"), "hash", "context", "response", "source",
                      *[F.round(F.col("embedding")[i].cast("double"), 6).alias(f"e{i}") for i in range(4)])


TOPK = 5
COSINE_SQL = """
WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nv
           FROM embeddings WHERE len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
             CASE WHEN q.nv = 0 OR d.nv = 0 THEN 0.0 ELSE list_dot_product(q.v, d.v) / (q.nv * d.nv) END AS score
      FROM n q, n d),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""


@job("cosine_topk", COSINE_SQL + f"""
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= {TOPK}""")
def cosine_topk(spark, d):
    """Exact cosine top-5 stored vectors for every stored vector (block-sharded numpy matmul)."""
    v = inputs.table(spark, d, "embeddings")
    out = rv.cosine_topk(v.select(F.col("vec_id").alias("query_id"), "embedding"),
                         v.select(F.col("vec_id").alias("doc_id"), "embedding"), TOPK)
    return out.select("query_id", F.col("rank").cast("bigint"), "doc_id", F.round("score", 6).alias("score"))


RAG_K = 2
RAG_TEMPLATE = "Respond like these examples.\n{example_responses}\nEnd of examples."


RAG_COSINE_SQL = COSINE_SQL.replace(
    "FROM n q, n d)", "FROM n q, n d WHERE d.vec_id IN (SELECT doc_id FROM documents))")


@job("rag_prompts", RAG_COSINE_SQL + f""",
corpus AS (SELECT e.vec_id AS doc_id, d.text AS context, '[' || d.lang || '] ' || d.source AS response
           FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
t AS (SELECT r.query_id, r.rank, r.doc_id, c.context, c.response FROM r JOIN corpus c ON c.doc_id = r.doc_id
      WHERE r.rank <= {RAG_K})
SELECT query_id, count(*) AS n_examples, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS snippet_ids,
       replace('{RAG_TEMPLATE.replace(chr(10), "' || chr(10) || '")}', '{{example_responses}}',
               string_agg('Example ' || rank || ':' || chr(10) || 'Context: ' || context || chr(10)
                          || 'Counselor response: ' || response, chr(10) || chr(10) ORDER BY rank)) AS prompt
FROM t GROUP BY query_id""")
def rag_prompts(spark, d):
    """Query vectors -> exact top-2 snippets -> ordered examples block -> filled RAG prompt."""
    corpus = inputs.retrieval_corpus(spark, d)
    top = rv.cosine_topk(inputs.retrieval_queries(spark, d), corpus.select("doc_id", "embedding"), RAG_K)
    return rv.rag_prompt(top, corpus, RAG_TEMPLATE)
