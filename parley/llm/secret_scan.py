"""Secret scan through a trigram inverted index.

For every rule a Boolean trigram query is derived from its regular expression:
an OR of ANDs of trigrams that any match must contain. The index holds the
postings of the trigrams that the rules ask for. Intersecting and uniting
postings gives, per document, the rules that can match at all; only those are
verified with their expression. Rules without mandatory trigrams scan every
text. Only DataFrame functions run here.

Edge cases: a null text is empty and has no spans. Documents with the same or a
null id share postings (their candidate rules are united), and each is verified
on its own text. An empty table gives an empty result.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: An OR of ANDs; the empty AND demands nothing.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: Alternatives kept of an expression while its query is derived; beyond that a part demands nothing.
MOST = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its ``group`` has ``least`` code points or more; ``base`` rules are in the digest."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # whole runs of hex digits, as [0-9a-f]+ with 24 or more
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[A-Za-z0-9._-]{1,64}:[^\x20\x09-\x0D/@:]{3,64}@"),
)


def _simple(query) -> Query:
    """Without alternatives that demand more than another one does."""
    return frozenset(c for c in query if not any(d < c for d in query))


def _and(a: Query, b: Query) -> Query:
    return _simple({x | y for x, y in product(a, b)}) if len(a) * len(b) <= MOST else min(a, b, key=len)


def _grams(strings: set[str]) -> Query:
    return _simple({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def _of_item(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is sre.SUBPATTERN:
        return _of_sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_of_sequence(x) for x in arg[1]]
        finite = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
        return finite, _simple(set().union(*(q for _, q in parts)))
    if op is sre.IN and len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg):
        return {chr(c).lower() for _, c in arg}, ANY
    if op is sre.MAX_REPEAT:
        least, most, inner = arg
        strings, query = _of_sequence(inner)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        return None, query if least else ANY
    return None, ANY


def _of_sequence(items) -> tuple[set[str] | None, Query]:
    """(every string the sequence can match, or None if they are not a small set; what a match must contain)."""
    run, whole, query = {""}, True, ANY
    for op, arg in items:
        strings, own = _of_item(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a, b in product(run, strings)}
        else:
            query, whole = _and(_and(query, _grams(run)), own), False
            run = strings if strings is not None else {""}
    return (run if whole else None), _and(query, _grams(run))


def trigram_query(pattern: str) -> Query:
    """Trigrams (of lower-cased text) that any match of a pattern contains: an OR of ANDs, ``ANY`` if nothing is mandatory."""
    return _of_sequence(sre_parser.parse(pattern))[1]


def build_index(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, key) of the trigrams that the rules' queries name, one row per trigram and document."""
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for g in clause})
    lowered = docs.select(F.col(key).alias("__key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__low"))
    found = F.array_compact(F.array(*[F.when(F.contains("__low", F.lit(g)), F.lit(g)) for g in grams]))
    return lowered.select(F.explode(found).alias("gram"), F.col("__key").alias(key))


def candidates(index: DataFrame, rules=RULES, key: str = "doc_id") -> DataFrame:
    """(key, may): per document with postings, one flag per rule, true if the rule's trigram query holds."""
    postings = index.groupBy(key).agg(F.collect_set("gram").alias("grams"))  # at most all grams the rules name

    def holds(query: Query) -> Column:
        tests = [F.size(F.array_intersect("grams", F.array(*map(F.lit, sorted(c))))) == len(c) for c in sorted(query, key=sorted) if c]
        out = F.lit(frozenset() in query)
        for t in tests:
            out = out | t
        return out

    return postings.select(key, F.array(*[holds(trigram_query(r.pattern)) for r in rules]).alias("may"))


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Matches that count, as array of (start, place of the kind, end) in code points.

    The pieces between matches come from splitting at the pattern; running lengths of pieces and matches give positions.
    """
    empty = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.zip_with(F.arrays_zip(matches.alias("m"), tested.alias("t")), F.split(text, rule.pattern, -1), lambda m, piece: F.struct(
        F.coalesce(F.length(piece), F.lit(0)).alias("gap"), F.coalesce(F.length(m["m"]), F.lit(0)).alias("size"),
        F.coalesce(F.length(m["t"]) >= rule.least, F.lit(False)).alias("ok")))

    def step(acc, x):
        start = (acc["at"] + x["gap"]).cast("int")
        span = F.array(F.struct(start.alias("start"), F.lit(place).alias("kind"), (start + x["size"]).cast("int").alias("end")))
        return F.struct((start + x["size"]).cast("int").alias("at"), F.when(x["ok"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).cast("int").alias("at"), empty.alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(steps, first, step, lambda acc: acc["out"])).otherwise(empty)


def scan(docs: DataFrame, rules=RULES, index: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key, ``found`` (array of start, kind, end by start, then kind) of the rules' matches.

    ``kind`` is the place of the rule in ``rules``. An index built before by ``build_index`` for these rules may be given.
    """
    may = candidates(index if index is not None else build_index(docs, rules, key, text), rules, key).select(
        F.col(key).alias("__may_key"), "may")
    body = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    joined = body.join(may, F.col("__key").eqNullSafe(F.col("__may_key")), "left")
    full = [trigram_query(r.pattern) == ANY for r in rules]
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    found = [F.when(F.lit(full[i]) | F.coalesce(F.get("may", F.lit(i)), F.lit(False)), _spans(F.col("__text"), r, i)).otherwise(none)
             for i, r in enumerate(rules)]
    return joined.select(F.col("__key").alias(key), F.array_sort(F.concat(*found)).alias("found"))


def digest(found: DataFrame, rules=RULES, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    base = [i for i, r in enumerate(rules) if r.base]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda i: F.size(F.filter("found", lambda s: s["kind"] == i)).cast("bigint")
    return found.select(key, *[count(i).alias(f"n_{rules[i].kind}") for i in base],
                        F.sha2(joined(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"))
