"""URL filter: rules by host and path, then a list of URLs behind a blocked Bloom filter.

A rule fits its host and every subdomain, where the path of the URL starts with
the rule's; of several the longest decides. All other URLs are looked up in the
list by their canonical form. The list is folded into a blocked Bloom filter, a
table of 256-bit blocks: a URL that finds its eight bits set in its block may be
listed, and only such URLs meet the list itself in an exact join, which removes
the false positives.

The filter is sized from the number of listed URLs and is broadcast up to a
bound; a larger one is joined by its block number, through the same plan.
Possible hits that make up more than 1/``HEAVY_SHARE`` of all rows (there
are fewer than that many) are settled once per URL and broadcast, so no URL,
however frequent, goes through one task of the exact join.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits
no rule and is not listed. An empty list lists nothing, an empty table gives an
empty result, repeated rows are judged one by one. The row itself comes back as
the struct ``page``, so that its columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import let, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A possible hit with more than this share of the rows is settled once and broadcast.
HEAVY_SHARE = 1024


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Rules of the query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: Scheme, host, path, query (the fragment is left out).
PARTS = r"(?s)\A(.*?)://([^/?#]*)([^?#]*)\??([^#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to a slash, question mark, hash or the end, with A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit(""))


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Host without ``www.`` and default port, path without closing slashes, other than ``utm_`` parameters in order; null without ``://``."""
    name = F.regexp_replace(F.regexp_replace(host, r"\Awww\.", ""), r":(80|443)\z", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(url, PARTS, 4), "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    query = let(F.array_join(params, "&"), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.when(url.contains("://"), F.concat(name, F.rtrim(path, F.lit("/")), query))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r)):  # the longest comes last, so it is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", listed_url: str = "url",
          listed_verdict: str = "block", other_verdict: str = "allow", bits_per_url: float = bloom.BITS_PER_KEY) -> DataFrame:
    """Per row of ``pages``: the row as struct ``page``, its host, path, rule (or null), whether it is ``listed`` (null under a rule), verdict."""
    def known(df: DataFrame, name: str) -> DataFrame:  # host, path and canonical form beside the row
        df = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("page"), F.col(f"`{name}`").alias("url"))
        df = df.select("page", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        return df.withColumn("url", canonical(F.col("url"), F.col("host"), F.col("path")))

    names = written(known(listed.select(F.col(f"`{listed_url}`").alias("url")), "url").where("url IS NOT NULL").select("url").distinct(), "listed")
    n_blocks = bloom.blocks_for(names.count(), bits_per_url)
    blocks = bloom.sendable(bloom.bloom_filter(names, n_blocks, "url"), n_blocks)

    rows = known(pages, url).withColumn("by_rule", rule_for(F.col("host"), F.col("path"), rules))
    probe = rows.withColumn("block", F.when(F.col("url").isNotNull(), bloom.block_of(F.col("url"), n_blocks)))
    possible = bloom.may_hold(bloom.hash_of(F.col("url"))) & F.col("by_rule").isNull() & F.col("url").isNotNull()
    probed = probe.join(blocks, "block", "left").withColumn("possible", possible)
    probed = probed.select("page", "host", "path", "by_rule", "url", "possible")

    in_list = names.withColumn("listed", F.lit(True))
    heavy = probed.where("possible").groupBy("url").count().where(F.col("count") * HEAVY_SHARE > pages.count()).select("url")
    heavy = heavy.join(in_list, "url", "left").select(F.sha2("url", 256).alias("digest"), F.coalesce("listed", F.lit(False)).alias("settled"))
    probed = probed.join(F.broadcast(heavy), F.when(F.col("possible"), F.sha2("url", 256)) == F.col("digest"), "left").drop("digest")
    open_ = F.col("possible") & F.col("settled").isNull()
    found = probed.where(open_).join(in_list, "url", "left").withColumn("settled", F.coalesce("listed", F.lit(False))).select(*probed.columns)
    out = probed.where(~open_).unionByName(found)

    is_listed = F.when(F.col("by_rule").isNull(), F.coalesce("settled", F.lit(False)))
    verdict = F.coalesce("by_rule.verdict", F.when(is_listed, listed_verdict).otherwise(other_verdict))
    return out.select("page", "host", "path", F.col("by_rule.rule").alias("rule"), is_listed.alias("listed"), verdict.alias("verdict"))
