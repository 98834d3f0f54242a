"""Token counts, cost estimates, request limits and batch packing.

Price tables are fixed configuration (a few dozen rows): they are inlined as
literal arrays / maps, so a lookup is a per-row expression and never a join.
Totals are single global aggregates (partial per task, one final merge).
Batches are filled by row numbers within length classes, a set-based rule, or as
one pass over all items would; either result depends on the items alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.ranking import ordered_index

from parley.functions.text import col_

# Fixed values: $ per 1M tokens {model: (input, output, batch_input, batch_output)} and the fallback row.
MODEL_PRICING = {
    "gpt-5-nano": (0.05, 0.40, 0.025, 0.20),
    "gpt-5-mini": (0.25, 2.00, 0.125, 1.00),
    "gpt-5.2": (1.75, 14.00, 0.875, 7.00),
    "gpt-4.1": (2.00, 8.00, 1.00, 4.00),
    "gpt-4.1-mini": (0.40, 1.60, 0.20, 0.80),
    "gpt-4.1-nano": (0.10, 0.40, 0.05, 0.20),
    "gpt-4o": (2.50, 10.00, 1.25, 5.00),
    "gpt-4o-mini": (0.15, 0.60, 0.075, 0.30),
}
DEFAULT_PRICING = (2.50, 10.00, 1.25, 5.00)

# Estimated output tokens per eval prompt, and the default.
ESTIMATED_OUTPUT_TOKENS = {"rubric_eval": 200, "empathy_chaining": 60, "forbidden": 70, "multiple_tasks": 60,
                           "pacing": 60, "questions": 60, "risk_assessment": 60}
DEFAULT_OUTPUT_TOKENS = 100

# Fixed values: $ per 1K tokens (input, output) used by the request-limit estimator.
LIMIT_PRICING = {
    "GPT-4": (0.03, 0.06), "GPT4-32k": (0.06, 0.12), "gpt-4o": (0.0025, 0.01),
    "gpt-4o-mini": (0.00015, 0.0006), "gpt-4.1": (0.002, 0.008), "gemini-1.5-flash-002": (0.000075, 0.0003),
    "gemini-2.0-flash": (0.000075, 0.0003), "medlm-medium": (0.000075, 0.0003),
    "Llama-3.3-70B-Instruct": (0.000075, 0.0003), "gemini-1.5-pro-002": (0.00125, 0.005),
    "gemini-1.5-pro": (0.00125, 0.005), "claude-3-7-sonnet-20250219-v1": (0.003, 0.015),
    "o1-mini": (0.003, 0.012), "o1-preview": (0.015, 0.06),
}


def estimate_tokens(text) -> Column:
    """Default tokenizer: ceil(chars / 4); NULL text counts 0."""
    return F.coalesce(F.ceil(F.length(col_(text)) / F.lit(4.0)), F.lit(0)).cast("bigint")


def message_tokens(messages, tokens=estimate_tokens, per_message: int = 4, primer: int = 3) -> Column:
    """Chat token count: primer + sum over messages of (per_message + tokens(role) + tokens(content))."""
    per = F.transform(col_(messages), lambda m: per_message + tokens(m["role"]) + tokens(m["content"]))
    return (F.aggregate(per, F.lit(0).cast("bigint"), lambda a, x: a + x) + primer).cast("bigint")


def _lit_map(d: dict, value_index: int | None = None) -> Column:
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), F.lit(v if value_index is None else v[value_index])]
    return F.create_map(*kv)


def price(model, tier: str) -> Column:
    """$ per 1M tokens for ``tier`` in input / output / batch_input / batch_output; unknown model -> default row."""
    idx = ["input", "output", "batch_input", "batch_output"].index(tier)
    return F.coalesce(F.try_element_at(_lit_map(MODEL_PRICING, idx), col_(model)), F.lit(DEFAULT_PRICING[idx]))


def output_tokens(eval_name) -> Column:
    return F.coalesce(F.try_element_at(_lit_map(ESTIMATED_OUTPUT_TOKENS), col_(eval_name)),
                      F.lit(DEFAULT_OUTPUT_TOKENS)).cast("bigint")


def cost_estimate(requests: DataFrame, tokens=estimate_tokens) -> DataFrame:
    """Requests (model, eval_name, messages) -> tokens and $ per (model, tier) plus per-tier totals
    (GROUPING SETS), with what each saves against the other tier (negative: extra cost), in $ and percent."""
    r = requests.select("model", message_tokens(F.col("messages"), tokens).alias("in_tok"),
                        output_tokens(F.col("eval_name")).alias("out_tok"))
    rates = {"standard": ("input", "output"), "batch": ("batch_input", "batch_output")}
    other = {"standard": "batch", "batch": "standard"}
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), price(F.col("model"), i).alias("pin"), price(F.col("model"), o).alias("pout"),
                               price(F.col("model"), rates[other[t]][0]).alias("other_in"),
                               price(F.col("model"), rates[other[t]][1]).alias("other_out")) for t, (i, o) in rates.items()])
    t = r.select("model", "in_tok", "out_tok", F.inline(tiers))
    t = t.withColumn("other_cost", F.col("in_tok") / 1e6 * F.col("other_in") + F.col("out_tok") / 1e6 * F.col("other_out"))
    t = t.withColumn("in_cost", F.col("in_tok") / 1e6 * F.col("pin")).withColumn("out_cost", F.col("out_tok") / 1e6 * F.col("pout"))
    g = t.groupingSets([["model", "tier"], ["tier"]], "model", "tier").agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum("in_tok").alias("total_input_tokens"),
        F.sum("out_tok").alias("total_output_tokens"), F.sum("in_cost").alias("input_cost"),
        F.sum("out_cost").alias("output_cost"), F.sum("other_cost").alias("other"))
    saved = F.col("other") - (F.col("input_cost") + F.col("output_cost"))
    return g.select(F.coalesce("model", F.lit("ALL")).alias("model"), "tier", "n_requests", "total_input_tokens",
                    "total_output_tokens", F.round("input_cost", 8).alias("input_cost"),
                    F.round("output_cost", 8).alias("output_cost"),
                    F.round(F.col("input_cost") + F.col("output_cost"), 8).alias("total_cost"),
                    F.round(saved, 8).alias("savings"), F.round(saved / F.nullif(F.col("other"), F.lit(0.0)) * 100, 6).alias("savings_percent"))


def limits_estimate(prompts: DataFrame, text_col: str, user_model: str, tokens_per_minute: int = 80_000,
                    max_tokens: int = 16, max_cost_threshold: float | None = 100.0,
                    tokens=estimate_tokens) -> DataFrame:
    """Prompt set -> one row per priced model: request-rate estimate and worst-case costs.

    est_completion = max_tokens + mean + 2 (max - min) / 4; rate = tpm / est_completion;
    input cost = total / 1000 x price; output cost = n x max_tokens / 1000 x price;
    ``exceeds_threshold`` = int(total cost of ``user_model``) > threshold.
    """
    if user_model not in LIMIT_PRICING:
        raise ValueError(f"Pricing estimates for {user_model} not found.")
    lens = prompts.select(tokens(F.col(text_col)).alias("n"))
    g = lens.agg(F.count(F.lit(1)).alias("n_prompts"), F.sum("n").alias("total_tokens"), F.avg("n").alias("mean_tokens"),
                 F.max("n").alias("max_tokens_in"), F.min("n").alias("min_tokens_in"))
    est = (F.lit(max_tokens) + F.col("mean_tokens") + (2 * (F.col("max_tokens_in") - F.col("min_tokens_in"))) / 4)
    g = g.select("n_prompts", "total_tokens", (F.col("n_prompts") * max_tokens).alias("worst_case_output_tokens"),
                 (F.col("total_tokens") / tokens_per_minute).alias("idealized_minutes"),
                 est.alias("est_completion_tokens"), (F.lit(tokens_per_minute) / est).alias("est_request_rate"))
    models = F.array(*[F.struct(F.lit(m).alias("pricing_model"), F.lit(i).alias("pin"), F.lit(o).alias("pout"))
                       for m, (i, o) in LIMIT_PRICING.items()])
    rows = g.select("*", F.inline(models))
    rows = (rows.withColumn("input_cost", F.col("total_tokens") / 1000 * F.col("pin"))
            .withColumn("output_cost", F.col("worst_case_output_tokens") / 1000 * F.col("pout"))
            .withColumn("total_cost", F.col("input_cost") + F.col("output_cost")))
    user_in, user_out = LIMIT_PRICING[user_model]
    user_total = F.col("total_tokens") / 1000 * user_in + F.col("worst_case_output_tokens") / 1000 * user_out
    exceeds = (F.floor(user_total) > max_cost_threshold) if max_cost_threshold is not None else F.lit(False)
    return rows.select("pricing_model", "n_prompts", "total_tokens", "worst_case_output_tokens",
                       *[F.round(c, 6).alias(c) for c in ("idealized_minutes", "est_completion_tokens",
                                                          "est_request_rate", "input_cost", "output_cost", "total_cost")],
                       exceeds.alias("exceeds_threshold"))


def pack_batches(items: DataFrame, id_col: str, tokens_col: str, max_tokens: int, max_items: int | None = None,
                 ids_per_bucket: int = 100_000) -> DataFrame:
    """Batches of items of similar length under ``max_tokens`` (and ``max_items``), shortest first; ids are integers.

    Lengths fall into classes an eighth apart. A class's longest length fixes how many of its items fill a batch, and
    items fill the batches of their class in order of (tokens, id). A batch so never passes a limit, unless it is one
    item that does so alone, and the batches depend on the items only, not on their number or layout. Items are numbered
    by windows over one length and a range of ids, with offsets from the counts of these.
    """
    t = F.col("tokens")
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.lit(0), F.length(F.bin(t)) - 4))
    df = items.select(F.col(id_col), F.greatest(F.col(tokens_col).cast("bigint"), F.lit(0)).alias("tokens"))
    df = df.select(id_col, "tokens", (F.ceil(t / step) * step).cast("bigint").alias("size_class"),
                   F.floor(F.col(id_col) / ids_per_bucket).alias("_bucket"))
    counts = df.groupBy("size_class", "tokens", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("size_class").orderBy("tokens", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("size_class", "tokens", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("size_class", "tokens", "_bucket").orderBy(id_col)
    numbered = df.join(counts, ["size_class", "tokens", "_bucket"]).withColumn("_i", F.col("_before") + F.row_number().over(within) - 1)
    fits = F.greatest(F.lit(1), F.floor(F.lit(max_tokens) / F.greatest(F.lit(1), F.col("size_class"))))
    fits = (F.least(fits, F.lit(max_items)) if max_items is not None else fits).cast("bigint")
    batch = F.floor(F.col("_i") / fits).cast("bigint")
    return numbered.select(id_col, "tokens", "size_class", batch.alias("batch_in_class"), (F.col("_i") % fits).cast("bigint").alias("pos_in_batch"),
                           F.concat_ws("-", F.col("size_class").cast("string"), batch.cast("string")).alias("batch_id"))


def _greedy_plan(max_tokens: int, max_items: int | None):
    """Sequential rule over (tokens, n) in ascending order of tokens, on runs of equal items instead of items."""
    endless = 1 << 62
    most = endless if max_items is None else max_items

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, items, used = -1, 0, 0  # the open batch; none before the first item
        for frame in frames:
            rows = []
            for t, n in zip(frame["tokens"].tolist(), frame["n"].tolist()):
                full = min(max(1, max_tokens // t) if t else endless, most)
                fits = 0 if batch < 0 or used > max_tokens else min((max_tokens - used) // t if t else endless, most - items)
                rows.append((t, batch, items, fits, full))
                if n <= fits:
                    items, used = items + n, used + n * t
                else:
                    closed = (n - fits - 1) // full
                    batch, items = batch + 1 + closed, n - fits - closed * full
                    used = items * t
            yield pd.DataFrame(rows, columns=["tokens", "open_batch", "open_items", "fits", "full"])

    return run


def greedy_batches(items: DataFrame, id_col: str, tokens_col: str, max_tokens: int, max_items: int | None = None,
                   ids_per_bucket: int = 100_000) -> DataFrame:
    """The batches of a sequential pass over all items, shortest first (equal ones by integer id): an item that would take
    the open batch over ``max_tokens`` (or ``max_items``) opens the next one. An item longer than that is a batch alone.

    In this order, items of one length follow one another, and what the pass does with a run of equal items is
    arithmetic: some fill the open batch, the others make full batches. So the pass goes over the counts of the
    lengths (one row per different length, however many items there are), and every item finds its batch from its index
    within its length. A length that many items have is numbered by ranges of ids, in many tasks.

    Null or negative lengths count as 0. Repeated rows are items of their own. No items give no batches.
    """
    df = items.select(F.col(id_col), F.greatest(F.coalesce(F.col(tokens_col).cast("bigint"), F.lit(0)), F.lit(0)).alias("tokens"))
    lengths = df.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).repartition(1).sortWithinPartitions("tokens")
    plan = lengths.mapInPandas(_greedy_plan(max_tokens, max_items), "tokens bigint, open_batch bigint, open_items bigint, fits bigint, full bigint")
    d = ordered_index(df, ["tokens"], id_col, "_i", ids_per_bucket, per_key=plan)
    later = F.col("_i") - F.col("fits")
    batch = F.when(later < 0, F.col("open_batch")).otherwise(F.col("open_batch") + 1 + F.floor(later / F.col("full")))
    pos = F.when(later < 0, F.col("open_items") + F.col("_i")).otherwise(later % F.col("full"))
    return d.select(id_col, "tokens", batch.cast("bigint").alias("batch"), pos.cast("bigint").alias("pos_in_batch"))
