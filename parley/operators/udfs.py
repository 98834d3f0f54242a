"""User-function slots: Arrow-batched pandas UDFs around injected callables.

The reference calls hosted models (completion, embedding, NER). Here the model
is a plain Python callable the user injects; Spark ships it to the executors
and feeds it Arrow batches. The deterministic stubs below stand in for real
models in tests and fixture runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def embedder(fn: Callable[[pd.Series], list]) -> Callable[[Column], Column]:
    """Wrap ``fn(texts: pd.Series) -> list[list[float]]`` as an ``array<float>`` pandas UDF."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(fn(texts)))

    return _embed


def request_embedder(call: Callable[[list[str]], list], max_items: int = 2048, max_tokens: int = 250_000,
                     count: Callable[[str], int] | None = None) -> Callable[[Column], Column]:
    """Embed through requests of bounded size: ``call(texts)`` gets at most ``max_items`` texts and ``max_tokens`` tokens.

    A text that would take the open request over a limit opens the next one; a text longer than the limit goes alone.
    The open request is carried over Arrow batches, so a task sends no request that could still take the next text, and
    holds one request. Blank and NULL texts are sent as one blank. A reply of another length than its request is an error.
    ``count`` gives a text's tokens (default: ceil(characters / 4)).
    """
    tokens = count or (lambda text: -(-len(text) // 4))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        request: list[str] = []
        used = 0

        def sent() -> pd.Series:
            vectors = list(call(request))
            if len(vectors) != len(request):
                raise ValueError(f"{len(vectors)} vectors for a request of {len(request)} texts")
            return pd.Series(vectors)

        for batch in batches:
            for text in batch:
                text = text if isinstance(text, str) and text.strip() else " "
                n = tokens(text)
                if request and (used + n > max_tokens or len(request) >= max_items):
                    yield sent()
                    request, used = [], 0
                request.append(text)
                used += n
        if request:
            yield sent()

    return _embed


def feature_embedding(texts: pd.Series) -> list[list[float]]:
    """Deterministic 64-d stub: [chars/1000, vowel share, space share, digit share], sixteen times."""
    s = texts.fillna("")
    n = s.str.len().to_numpy(dtype=np.float64)
    safe = np.where(n == 0, 1.0, n)
    vowels = s.str.count("[aeiouAEIOU]").to_numpy(dtype=np.float64) / safe
    spaces = s.str.count(" ").to_numpy(dtype=np.float64) / safe
    digits = s.str.count("[0-9]").to_numpy(dtype=np.float64) / safe
    return np.tile(np.column_stack([n / 1000.0, vowels, spaces, digits]), 16).astype(np.float32).tolist()


def complete_batch(requests: DataFrame, complete: Callable[[str], str], prompt_col: str = "prompt",
                   max_attempts: int = 5, done: DataFrame | None = None,
                   key: tuple[str, ...] = ("uid", "prompt_template_name")) -> DataFrame:
    """Apply an injected completion function to request rows (``mapInPandas``).

    Output adds ``content``, ``attempts`` and ``error``; one failing row never
    fails the job (after ``max_attempts`` tries its error is recorded).
    Requests whose ``key`` columns are already in ``done`` are skipped (resume by anti join).
    """
    todo = requests.join(done.select(*key).distinct(), list(key), "left_anti") if done is not None else requests
    schema = T.StructType(todo.schema.fields + [T.StructField("content", T.StringType()),
                                                T.StructField("attempts", T.IntegerType()),
                                                T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            contents, attempts, errors = [], [], []
            for prompt in pdf[prompt_col].tolist():
                out, err, n = None, None, 0
                while n < max_attempts:
                    n += 1
                    try:
                        out = complete(prompt)
                        err = None
                        break
                    except Exception as e:  # noqa: BLE001 - recorded per row
                        err = f"{type(e).__name__}: {e}"
                contents.append(out)
                attempts.append(n)
                errors.append(err)
            yield pdf.assign(content=contents, attempts=np.array(attempts, dtype=np.int32), error=errors)

    return todo.mapInPandas(run, schema)


def fenced_json_list(text) -> Column:
    """The JSON list inside a ```json fence (``try_parse_json``); NULL when there is none or it does not parse."""
    inner = F.regexp_extract(text, r"(?s)```json\s*(\[[\s\S]*?\])\s*```", 1)
    return F.try_parse_json(F.nullif(inner, F.lit("")))


def judge_consistency(requests: DataFrame, respond: Callable[[str], str], judge: Callable[[str], str], n_samples: int,
                      key_cols: list[str], prompt_col: str = "prompt", max_attempts: int = 1) -> DataFrame:
    """Stability check: n sampled replies per request, judged together; one row per request with status and score items.

    Replies lose their ``//`` separators; a failed call becomes ``[ERROR] <message>`` and is left out of what the
    judge sees. The judge answers with a fenced JSON list of {question, score}: ``items``, NULL (and ``judge_status``
    ``parse_error``) if it does not parse. Every sample and every request is sent to its model once.
    """
    samples = requests.select(*key_cols, prompt_col, F.explode(F.sequence(F.lit(1), F.lit(n_samples))).alias("sample"))
    samples = samples.withColumn("_req", F.concat(F.lit("#"), F.col("sample").cast("string"), F.lit(" "), F.col(prompt_col)))
    done = complete_batch(samples, respond, prompt_col="_req", max_attempts=max_attempts)
    resp = F.when(F.col("error").isNotNull(), F.concat(F.lit("[ERROR] "), F.col("error"))) \
        .otherwise(F.replace(F.trim(F.col("content")), F.lit("//"), F.lit("")))
    failed = F.lower("response").contains("[error]")
    grouped = (done.withColumn("response", resp).withColumn("_kept", F.when(~failed, F.col("response")))
               .groupBy(*key_cols, prompt_col)
               .agg(F.count(F.lit(1)).alias("n_responses"), F.count_if(failed).alias("n_errors"),
                    F.expr("listagg(_kept, ' || ') WITHIN GROUP (ORDER BY sample)").alias("_kept")))
    judge_in = F.concat(F.lit("PROMPTED WITH: "), F.col(prompt_col), F.lit("\nRESPONSES: "), F.coalesce("_kept", F.lit("")))
    judged = complete_batch(grouped.withColumn("judge_input", judge_in), judge, prompt_col="judge_input", max_attempts=max_attempts)
    items = F.try_variant_get(fenced_json_list(F.col("content")), "$", "array<struct<question:string,score:double>>")
    return judged.select(*key_cols, prompt_col, "n_responses", "n_errors", items.alias("items")).withColumn(
        "judge_status", F.when(F.col("items").isNotNull(), F.lit("ok")).otherwise(F.lit("parse_error")))


def consistency_scores(judged: DataFrame, key_cols: list[str], prompt_col: str = "prompt") -> DataFrame:
    """(keys, prompt, question, score): the judge's items, one row each."""
    return judged.select(*key_cols, prompt_col, F.inline("items")).select(*key_cols, prompt_col, "question", "score")
