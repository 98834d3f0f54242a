"""URL filter, aligned tokenizers, spelling variants: edge cases and brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from parley.llm import alignment, bloom, queries, spelling, url_filter

from . import brute

SF = "/root/testdata/sf0.001"


def rows_of(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]



URLS = [None, "", "no scheme", "http://", "HTTP://A.Net/x", "http://a.net", "http://net/", "http://anet/", "http://a.example.net/en/1", "http://a.example.net/en",
        "http://www.example.com/de/5?a=1", "http://example.com/fr/5", "http://x.org/fr/", "http://x.org/FR/", "http://x.com/p/?b=2&a=1&utm_x=9#top",
        "https://www.X.com:443/p?a=1&b=2", "http://x.com/p?a=1", "http://x.com/p", "http://x.com/p//", "a://b://c/d", "http://h?q#f", "http://ü.de/ä ö", "http://x.com/\np"]


def split(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    tail = rest[len(host):]
    path = re.split("[?#]", tail, maxsplit=1)[0]
    query = tail[len(path):].split("#", 1)[0][1:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    params = sorted(x for x in query.split("&") if x and not x.startswith("utm_"))
    name = re.sub(r":(80|443)\Z", "", re.sub(r"\Awww\.", "", host))
    return host, path, name + path.rstrip("/") + ("?" + "&".join(params) if params else "")


def judged(urls, listed):
    names, out = {split(u)[2] for u in listed} - {None}, []
    for u in urls:
        host, path, canonical = split(u)
        fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.host + r.path), default=None)
        out.append((host, path, best and best.host + best.path, best.verdict if best else "block" if canonical in names else "allow"))
    return out


def pages_of(spark, urls):
    """Pages whose other columns are called like those of the result."""
    return spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "verdict int, url string, host string, block int").repartition(3)


def run_filter(spark, urls, listed, **kw):
    out = url_filter.judge(pages_of(spark, urls), spark.createDataFrame([(u,) for u in listed], "url string"), **kw)
    rows = sorted(out.collect(), key=lambda r: r["page"]["verdict"])
    assert all(r["page"]["host"] == "h" and r["page"]["block"] == 1 for r in rows)
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows]


def test_urls_by_rule_and_list(spark):
    listed = ["https://x.com/p/?a=1&b=2", "http://x.com/p#a", None, "nothing", "http://net/"]
    assert run_filter(spark, URLS, listed) == judged(URLS, listed)
    assert run_filter(spark, URLS, []) == judged(URLS, [])
    assert run_filter(spark, [], listed) == []


def test_url_filter_false_positives_and_hot_urls(spark):
    """A filter of too few bits lets much through, which the exact join takes out; one URL holds a third of the rows; a filter too large to broadcast."""
    urls = ([f"http://x.com/{i}" for i in range(400)] + [f"http://x.com/{i % 2}" for i in range(200)]) * 2
    listed = [f"http://x.com/{i}" for i in range(1, 400, 7)]
    want = judged(urls, listed)
    assert run_filter(spark, urls, listed, bits_per_url=0.5) == want
    bound, bloom.BROADCAST_BYTES = bloom.BROADCAST_BYTES, 0
    try:
        assert run_filter(spark, urls, listed) == want
    finally:
        bloom.BROADCAST_BYTES = bound


def test_url_filter_has_few_false_positives(spark):
    urls = spark.range(4000).select(F.concat(F.lit("x.com/"), "id").alias("url"))
    n_blocks = bloom.blocks_for(4000)
    blocks = bloom.bloom_filter(urls, n_blocks, "url")
    assert blocks.count() == n_blocks
    asked = spark.range(4000, 24000).select(F.concat(F.lit("x.com/"), "id").alias("url")).unionByName(urls)
    asked = asked.withColumn("block", bloom.block_of(F.col("url"), n_blocks)).join(blocks, "block")
    assert 4000 <= asked.where(bloom.may_hold(bloom.hash_of(F.col("url")))).count() < 4000 + 20000 * 0.02


def test_query_url_filter_plan_is_native(spark):
    plan = queries.JOBS["op11_url_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "html" not in plan


# --- tokens of two tokenizers ---

def plain_alignment(text, a_tokenizer, b_tokenizer, aligner):
    """(A ids, B ids, groups, links) of one text with the library's own calls, by definition; None without tokens."""
    if not text:
        return None
    sides = []
    for ids, table in ((a_tokenizer.encode(" " + text, add_special_tokens=False).ids, aligner.bytes_a), (b_tokenizer.encode(text), aligner.bytes_b)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return None
        ends = list(itertools.accumulate(len(table[i]) for i in ids))
        sides.append([(i, s, e) for i, s, e in zip(ids, [0, *ends], ends)])
    cuts = sorted({e for _, _, e in sides[0]} & {e for _, _, e in sides[1]})
    groups = ["|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in sides) for lo, hi in zip([0, *cuts], cuts)]
    links = [(i, j) for i, s, e in sides[0] for j, t, f in sides[1] if s < f and t < e]
    return [i for i, _, _ in sides[0]], [j for j, _, _ in sides[1]], groups, links


def plain_scores(texts):
    aligner = alignment.Aligner()
    fresh_a = Tokenizer.from_file(alignment.tokenizer_path())
    fresh_a.encode_special_tokens = True
    fresh_b = SentencePieceProcessor(model_file=alignment.piece_path())
    found = [plain_alignment(t, fresh_a, fresh_b, aligner) for t in texts]
    counts = Counter(p for f in found if f for p in set(f[3]))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if not f else
            (len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(counts[p] == best[p[0]] for p in f[3]), sum(counts[p] for p in f[3]),
             hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for f in found]


ODD = ["a  b", " lead", "trail ", "x\t \ty", "a b\n\n c", "", None, "it's 'tis don't\n\nend\n", "tok <|endoftext|> in <s> <unk> <0x41>", "a b c", "a\x1c b",
       "x²5 y½z", "漢字 abł", "▁x", "a ▁b", " ", "\n", "a\r\n b;\r", "  x", "éte", "the the the theatre", "the the the theatre"]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def odd_texts(n):
    rng = random.Random(11)
    return ODD + ["".join(rng.choice("abé'ł²5. \n\t,Ж漢½_-\r　") for _ in range(rng.randint(1, 40))) for _ in range(n)]


def aligned_rows(df):
    return [tuple(r[c] for c in COLUMNS) for r in sorted(df.collect(), key=lambda r: r["key"])]


def test_alignment_against_the_libraries(spark, docs_of):
    texts = odd_texts(400)
    assert aligned_rows(alignment.score(docs_of(texts))) == plain_scores(texts)
    assert alignment.score(docs_of([])).collect() == []


def test_alignment_of_long_texts_by_parts_and_rare_pairs(spark, docs_of):
    """Parts of texts end at cuts; pairs beyond the broadcast bound are joined by shuffle; few chunks are kept; ids are null or come twice."""
    rng = random.Random(2)
    words = ["the", "Straße", "été", "naïve,", "x1y2", "don't", "漢字", "end.\n", "\tq"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 300))) for _ in range(40)] + ODD
    old = alignment.PART_CHARS, alignment.KEPT_CHUNKS, alignment.BROADCAST_PAIRS
    alignment.PART_CHARS, alignment.KEPT_CHUNKS, alignment.BROADCAST_PAIRS = 50, 20, 40
    try:
        aligner = alignment.Aligner()
        assert [(*n, d) for n, d, _, _ in aligner.documents(texts)] == [(*r[:4], r[6]) for r in plain_scores(texts)]
        assert aligned_rows(alignment.score(docs_of(texts))) == plain_scores(texts)
    finally:
        alignment.PART_CHARS, alignment.KEPT_CHUNKS, alignment.BROADCAST_PAIRS = old
    twice = alignment.score(docs_of([(None, "the end"), (7, "the end"), (7, "the end")])).collect()
    assert sorted(str(r["key"]) for r in twice) == ["7", "7", "None"] and len({r["row"] for r in twice}) == 3 and len({tuple(r[c] for c in COLUMNS) for r in twice}) == 1


def test_query_token_alignment(spark):
    rows = sorted(rows_of(spark))[:60]
    got = {r["doc_id"]: r for r in queries.JOBS["op12_token_alignment"](spark, SF).collect()}
    assert set(got) == {i for i, _ in rows_of(spark)}
    for (i, _), want in zip(rows, plain_scores([t for _, t in rows])):  # counts over the corpus are tested on whole small inputs above
        assert (*(got[i][c] for c in COLUMNS[:4]), got[i]["groups_sha256"]) == (*want[:4], want[6])


# --- spelling variants ---

def plain_words(docs, drop_every=199):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_variants(counts):
    near = {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and brute.edit_distance(v, w) == 1] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), form[w] and counts[form[w]]))
    return out


def variants_of(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(words).collect()}


def similar_words(n, letters="abé", lengths=(6, 11), seed=1):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))): rng.choice([5, 6, 25, 30, 150, 900, 5000]) for _ in range(n)}


def test_variants_against_all_pairs(spark):
    counts = similar_words(260)
    assert variants_of(spark, counts) == plain_variants(counts)
    assert variants_of(spark, {}) == set()


def test_variants_of_large_groups(spark):
    """Words that agree on three quarters: groups beyond the bound are divided, and no link is lost."""
    rng = random.Random(4)
    counts = {w[:k] + "licence" + w[k:]: n for w, n in similar_words(200, "abcdefgh", (2, 4), 3).items() for k in (0, len(w))}
    counts |= {"documentation" + rng.choice("abcdefghij") + rng.choice("abcdefghij"): rng.choice([5, 30, 200]) for _ in range(90)}
    old, spelling.MOST = spelling.MOST, 3
    try:
        assert variants_of(spark, counts) == plain_variants(counts)
    finally:
        spelling.MOST = old


def test_divided_groups_do_not_give_all_pairs(spark):
    """Two thousand words with one common stem: rows that meet grow with the words, not with their square."""
    words = spark.range(2000).select(F.concat(F.lit("commonstemofwords"), F.lpad(F.conv(F.col("id") * 7919, 10, 26), 5, "q")).alias("w"))
    words = words.select(F.translate("w", "0123456789", "qrstuvwxyz").alias("word"), F.lit(9).cast("bigint").alias("n")).distinct()
    pairs = spelling.near_pairs(words)
    listed = [r["word"] for r in words.collect()]
    want = {(v, w) for v, w in itertools.permutations(listed, 2) if len(v) == len(w) and sum(map(str.__ne__, v, w)) == 1}
    assert {(r["word"], r["near"]) for r in pairs.collect()} >= want


def test_word_counts(spark, docs_of):
    texts = [None, "", "ABCdefÀ× abcdefÀ× tiny", "Über-Straße überstraße " * 30, "x" * 50 + " " + "longword " * 400] + [f"repeated words number {i} Repeated" for i in range(300)]
    old = spelling.PIECE_CHARS, spelling.HELD_WORDS
    spelling.PIECE_CHARS, spelling.HELD_WORDS = 100, 7
    try:
        for drop in (199, 3, None):
            got = {r["word"]: r["n"] for r in spelling.word_counts(docs_of(texts), drop_every=drop).collect()}
            assert got == plain_words(list(enumerate(texts)), drop)
    finally:
        spelling.PIECE_CHARS, spelling.HELD_WORDS = old
    assert spelling.word_counts(docs_of([])).collect() == []


def test_roots_follow_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("a", "b")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w11" for i in range(11)}, "a": "b"}
