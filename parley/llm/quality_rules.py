"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule. Policies are versioned bit masks over the ledger:
applying another policy, or asking what a rule costs, never reads a text again.
Only DataFrame functions run here.

Edge cases: a null or blank text has no words, so all its counts are 0 and it
fails ``few_words``. Repeated rows give repeated ledger rows. An empty table
gives an empty ledger. Extra columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

WINDOW_WORDS = 8
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: name -> SQL condition over the measurements under which a document fails; the order gives the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "3 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)",
    "shouting": "2 * n_upper > word_chars AND n_words > 0",
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("v1", tuple(RULES)))}


def _repeat_words(words: Column) -> Column:
    """Words covered by runs of eight words that occur at least twice in the text."""
    n = F.size(words) - (WINDOW_WORDS - 1)

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(hashed, i, F.lit(WINDOW_WORDS))))

    def shifted(a: Column) -> Column:
        return F.slice(a, F.lit(2), F.size(a))

    def starts(h: Column) -> Column:
        """Start positions of the repeated windows, ascending: equal hashes are neighbours once sorted."""
        by_hash = F.array_sort(F.arrays_zip(h.alias("h"), F.sequence(F.lit(1), F.size(h)).alias("p")))
        pairs = let(by_hash, lambda s: F.zip_with(s, shifted(s), lambda a, b: F.when(
            a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>"))))
        return F.array_sort(F.array_distinct(F.flatten(pairs)))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, shifted(p), lambda a, b: F.least(F.lit(WINDOW_WORDS), F.coalesce(b - a, F.lit(WINDOW_WORDS))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    counted = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(starts(h), covered)))
    return F.when(n >= 2, counted).otherwise(F.lit(0).cast("bigint"))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key, the measurements, and ``failed_bits`` (bit *i*: rule *i* failed)."""
    body = F.coalesce(F.col("__text"), F.lit(""))
    split = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).select(
        "__key", body.alias("__text"),
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("__words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)).alias("__lines"))
    t = F.col("__text")
    measured = split.select(
        F.col("__key").alias(key),
        F.size("__words").cast("bigint").alias("n_words"),
        _without(t, BLANKS).cast("bigint").alias("word_chars"),
        (F.length(t) - _without(t, SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.length(t) - _without(t, UPPER)).cast("bigint").alias("n_upper"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("__words")).alias("n_repeat_words"))
    bits = sum((F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, cond in enumerate(RULES.values())), F.lit(0))
    return measured.withColumn("failed_bits", bits.cast("bigint"))


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    """Add ``base_failed`` and ``kept``: base failures always reject, then the policy's own rules."""
    failed = lambda p: F.col("failed_bits").bitwiseAND(F.lit(p.mask)) != 0
    return led.withColumn("base_failed", failed(POLICIES["base"])).withColumn("kept", ~(F.col("base_failed") | failed(policy)))


def ablations(led: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents failing it, and documents that only this rule rejects (kept without it)."""
    names = list(RULES)
    rows = [(r, 1 << names.index(r)) for r in policy.rules]
    hit = F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("hit")
    per = led.groupBy(hit).agg(F.count("*").alias("n"))  # one row per bit pattern
    lists = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for r, b in rows])
    return per.select("hit", "n", F.inline(lists)).groupBy("rule").agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"))
