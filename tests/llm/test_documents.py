"""Dedup, joins, scans and rules against plain versions."""

import hashlib
import os
import pathlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import bloom, common
from parley.llm import components as C
from parley.llm import decontaminate, line_dedup, ngram_join, quality_rules, secret_scan, suffix_dedup

from . import brute


def mutated(rng, tokens, n, choices):
    out = list(tokens)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(choices)
    return out


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_linked_lines_are_all_within_the_threshold(spark, threshold):
    rng = random.Random(threshold)
    lines = {"short", "x" * 23, "x" * 24, "x" * 25}
    for _ in range(12):
        base = [rng.choice("abcdé漢 ") for _ in range(rng.randint(22, 70))]
        lines.add("".join(base))
        for _ in range(8):
            s = list(base)
            for _ in range(rng.randint(1, 4)):
                k, kind = rng.randrange(len(s)), rng.random()
                s[k:k + 1] = [rng.choice("abcdé漢 ")] if kind < 0.4 else [s[k], rng.choice("abc")] if kind < 0.7 else []
            lines.add("".join(s))
    lines = sorted(x for x in lines if x.strip())
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("lid"), "line")
    text = {r["lid"]: r["line"] for r in df.collect()}
    got = {tuple(sorted((text[r["a"]], text[r["b"]]))) for r in line_dedup.linked_lines(df, threshold).collect()}
    want = {(a, b) for i, a in enumerate(lines) for b in lines[i + 1:]
            if min(len(a), len(b)) >= line_dedup.SHORTEST and abs(len(a) - len(b)) <= threshold and brute.edit_distance(a, b) <= threshold}
    assert got == want


def test_lines_with_one_edited_word_are_linked(spark):
    rng = random.Random(11)
    lines = set()
    for n in (25, 31, 33, 47, 49, 63, 66, 79, 82, 97, 111, 113, 126, 129, 133, 158, 163, 201, 252, 400, 900):
        base = ""
        while len(base) < n:
            base += rng.choice(["thorreou", "nterti", "is", "by", "whst", "漢字é", "ndble"]) + " "
        base = base[:n]
        lines.add(base)
        for _ in range(6):
            k, size = rng.randrange(n), rng.randint(1, 9)
            lines.add(rng.choice([base[:k] + base[k + size:], base[:k] + "whstndernt"[:size] + base[k:], base[:k] + "q" * size + base[k + size:]]))
    lines = sorted(lines)
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("lid"), "line")
    text = {r["lid"]: r["line"] for r in df.collect()}
    got = {tuple(sorted((text[r["a"]], text[r["b"]]))) for r in line_dedup.linked_lines(df).collect()}
    want = {(a, b) for i, a in enumerate(lines) for b in lines[i + 1:]
            if (m := min(len(a), len(b))) >= line_dedup.SHORTEST and abs(len(a) - len(b)) <= 8 and brute.edit_distance(a, b) <= max(1, min(8, m // 16))}
    assert got == want and any(abs(len(a) - len(b)) == 8 for a, b in want)


def test_near_copies_too_far_apart_are_seldom_paired(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinsrhldcumg") for _ in range(rng.randint(3, 8)))
    base = [word() for _ in range(80)]
    lines = [base if i == 40 else [word() if rng.random() < 0.08 else w for w in base] for i in range(80)]
    lines += [[*base[:9], base[9] + "x", *base[10:]]]  # linked with the base only
    made, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *args: made.append(pairs.count()) or verified(pairs, *args))
    df = spark.createDataFrame([(i, " ".join(x), i) for i, x in enumerate(lines)], "lid long, line string, first long")
    assert 80 in {r["lid"] for r in line_dedup.later_lines(df).collect()}
    assert sum(made) < 80 * 79 / 2 / 4, made


def test_lines_are_read_again_only_if_they_meet_by_their_lengths(spark, monkeypatch):
    rng = random.Random(5)
    start = "a heading of twenty-odd letters: "
    lines = [start + "".join(rng.choice("abcdefgh ") for _ in range(n - len(start))) for n in (160, 170, 180, 190)]
    near = [*lines, lines[0][:80] + "q" + lines[0][80:]]
    read, beside = [], line_dedup._beside
    monkeypatch.setattr(line_dedup, "_beside", lambda shared, *args: read.append({r["lid"] for r in shared.collect()}) or beside(shared, *args))
    for some, links in ((lines, set()), (near, {4})):
        df = spark.createDataFrame([(i, x, i) for i, x in enumerate(some)], "lid long, line string, first long")
        assert {r["lid"] for r in line_dedup.later_lines(df).collect()} == links
    assert read == [set(), {0, 4}]


def test_segments_are_cut_from_both_ends():
    ways = line_dedup._shifts(8)
    assert len(ways) == 41 and max(abs(shift) for _, shift in ways) == 4
    assert all(abs(shift) <= min(i, 8 - i) for i, shift in ways)


def test_the_driver_collects_its_garbage_before_a_table_is_written(spark, monkeypatch):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    for share, collected in ((1.0, False), (0.0, True)):
        monkeypatch.setattr(common, "GARBAGE_SHARE", share)
        before = full()
        assert common.written(spark.range(3), "few").count() == 3
        assert (full() > before) == collected


def test_line_dedup_keeps_the_first_of_linked_lines(docs_of):
    a = "a line that is long enough to be compared"
    rows = [(3, f"{a}\n\nown line of three\nshort"), (1, f"first own line\n{a}\n{a}!"), (2, "short\n" + a.replace("long", "1ong")), (4, None), (5, ""), (5, ""), (None, "short\nno id")]
    df = docs_of(rows)
    out = line_dedup.dedup(df)
    got = sorted(((r["doc_id"], r["text"], r["__n_lines"], r["__n_removed"]) for r in out.collect()), key=str)
    assert got == sorted([(None, "short\nno id", 2, 0), (1, f"first own line\n{a}", 3, 1), (2, "", 2, 2), (3, "\nown line of three", 3, 2), (4, None, 0, 0), (5, "", 0, 0), (5, "", 0, 0)], key=str)
    assert out.columns[:-2] == df.columns
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_lines_of_one_template_meet_their_earliest_first(spark, monkeypatch):
    """Whatever is linked with the earliest goes, the others are compared with all earlier ones; nothing is lost, also where filters are joined."""
    rng = random.Random(3)
    lines = {"Copyright by " + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) + ", all rights are reserved to" for _ in range(70)}
    lines |= {x[:k] + "q" + x[k:] for x in sorted(lines)[::3] for k in (0, len(x) // 2)}
    lines = sorted(lines)
    rng.shuffle(lines)
    df = spark.createDataFrame([(x, (i,)) for i, x in enumerate(lines)], "line string, first struct<k:long>").select(F.xxhash64("line").alias("lid"), "line", "first")
    text = {r["lid"]: r["line"] for r in df.collect()}
    far = {(a, b): abs(len(a) - len(b)) <= 8 and brute.edit_distance(a, b) for i, a in enumerate(lines) for b in lines[:i]}
    want = {a for (a, b), d in far.items() if d is not False and d <= line_dedup.limit(min(len(a), len(b)))}
    for bound in (bloom.BROADCAST_BYTES, 0):
        monkeypatch.setattr(bloom, "BROADCAST_BYTES", bound)
        got = [text[r["lid"]] for r in line_dedup.later_lines(df).collect()]
        assert sorted(got) == sorted(want) and 5 < len(want) < len(lines) - 5


def test_lines_that_share_a_phrase_only_are_not_paired(spark, monkeypatch):
    rng = random.Random(8)
    letters = "etaoinsrhldcumg"
    lines = {"as the committee has said before, " + "".join(rng.choice(rng.sample(letters, 4)) for _ in range(rng.randint(200, 230))) for _ in range(80)}
    lines = sorted(lines | {x + "!" for x in sorted(lines)[:3]})
    made = {}

    def counting(df, name, write=line_dedup.written):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "written", counting)
    df = spark.createDataFrame([(x, (i,)) for i, x in enumerate(lines)], "line string, first struct<k:long>").select(F.xxhash64("line").alias("lid"), "line", "first")
    assert line_dedup.later_lines(df).count() == 3
    assert made["pairs"] < len(lines)  # all of them share the segments of the phrase


def test_line_dedup_leaves_no_large_tables_and_no_shuffle_files(spark, docs_of):
    from parley.llm.common import written
    from parley.session import ensure_checkpoint_dir

    folder = pathlib.Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    names = lambda: {p.name for p in folder.iterdir()}
    line = "a line that is long enough to be compared"
    before = names()
    out = line_dedup.dedup(docs_of([(1, line), (2, f"{line}!\nown line"), (3, None)]))
    left = {n.rsplit("-", 1)[0] for n in names() - before}
    assert not left & {"lines", "probes", "entries", "segments", "met"}
    assert sorted(map(str, (r["text"] for r in out.collect()))) == ["None", line, "own line"]

    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for _, _, found in os.walk(d) for f in found if f.startswith("shuffle_")}
    had, deadline = files(), time.time() + 10  # files go in the background
    written(spark.range(5000).groupBy((F.col("id") % 999).alias("k")).count(), "counts")
    while files() - had and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - had


def test_line_dedup_beside_clashing_columns(spark):
    names = ["__hash", "__nos", "__n_lines", "row", "rk", "lines", "first", "k"]
    line = "a line that is long enough to be compared"
    df = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate([line, f"{line}\nown line", line + "!"])], ["doc_id", "text", *names])
    out = line_dedup.dedup(df)
    kept = [n for n in names if n != "__n_lines"]
    assert out.columns == ["doc_id", "text", *kept, "__n_lines", "__n_removed"]
    rows = sorted(out.collect())
    assert [r["text"] for r in rows] == [line, "own line", ""] and [r["__n_removed"] for r in rows] == [0, 1, 1]
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in kept)


def test_filters_are_mentioned_once_in_a_plan(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("key"), "id")
    few = bloom.bloom_filter(rows.where("id % 100 = 0").select("key"), bloom.blocks_for(30), prefix="few")
    more = bloom.bloom_filter(rows.where("id % 100 = 1").select("key"), bloom.blocks_for(30), prefix="more")
    filters = [(few, bloom.blocks_for(30), "few"), (more, bloom.blocks_for(30), "more")]
    for some in (filters[:1], filters):
        out = bloom.passing(rows, "key", some)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert sum(line.count("scalar-subquery#") for line in plan.splitlines() if not line.lstrip(" :+-").startswith("Aggregate")) == len(some)
        got = {r["id"] for r in out.collect()}
        assert got >= {i for i in range(3000) if i % 100 < len(some)} and len(got) < 200
        assert out.columns == rows.columns


def test_filters_beside_clashing_columns_and_string_item_ids(spark):
    names = ["__hash", "__key", "__one", "__nth", "__items", "__items_", "row", "found", "text_hash"]
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words) + " more", "something else that is no copy of it", None, ""]
    df = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([("b", "something else that is no"), (None, "else that is no copy"), ("a", "copy of it")], "item_id string, text string")
    for out, ids in ((ngram_join.one_per_group(df), [0, 2, 3, 4]), (decontaminate.remove(df, items), [0, 1, 3, 4])):
        rows = sorted(out.collect(), key=lambda r: r["doc_id"])
        assert out.columns == df.columns and [r["doc_id"] for r in rows] == ids
        assert all(r["text"] == texts[r["doc_id"]] and r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    found = {r["doc_id"]: [m["item_id"] for m in r["__items"]] for r in decontaminate.matches(df, items, block_shingles=1).collect()}
    assert found == {0: [], 1: [], 2: [None, "a", "b"], 3: [], 4: []}


def test_ngram_components_match_all_pairs(docs_of, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one")]
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 160))]
        for _ in range(10):
            base = mutated(rng, base, rng.choice([0, 1, 1, 2, 6]), vocabulary)
            docs.append((len(docs), " ".join(base) + rng.choice(["", " ", "\n"])))
    want = brute.components(docs)
    assert len({c for _, c in want.values()}) < len(docs)
    for block in (2000, 4):  # small blocks go through chunks and the nodes left over
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs_of(docs), block_nodes=block).collect()}
        assert got == want


def test_ngram_one_per_group(docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text), (7, text), (3, text + " more"), (9, "other words that stand alone here"), (1, None), (1, None), (None, text)]
    df = docs_of(rows)
    out = ngram_join.one_per_group(df)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(None, text), (9, rows[3][1]), (1, None), (1, None)], key=str) or got == sorted([(3, text + " more"), (9, rows[3][1]), (1, None), (1, None)], key=str)
    assert out.columns == df.columns
    assert ngram_join.one_per_group(df.limit(0)).count() == 0


def test_count_tree_bounds_lose_no_link():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, rng.integers(5, 300), dtype=np.uint64)
        for _ in range(5):
            keep = base[rng.random(len(base)) < 0.95]
            sets.append(np.unique(np.r_[keep, rng.integers(0, 1 << 63, max(0, len(base) // 30), dtype=np.uint64)]))
    sets = [s for s in sets if len(s)]
    tree = ngram_join.CountTree(np.stack([ngram_join.point_of(s) for s in sets]))
    partners = ngram_join._partners(tree.points[:60])
    for i, a in enumerate(sets):
        near = set(tree.near(i).tolist())
        for j, b in enumerate(sets):
            common = len(np.intersect1d(a, b))
            if 100 * common >= 75 * (len(a) + len(b) - common):
                assert j in near and (i == j or max(i, j) >= 60 or partners[i] > 0)


def test_points_of_long_sets_tell_them_apart():
    rng = np.random.default_rng(4)
    new = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    sets = [new(n) for n in (3000, 3100, 4090, 4100, 9000, 700, 20)]
    sent = lambda some: [np.frombuffer(ngram_join.fine_point_of(s), dtype=np.uint8) for s in some]
    assert not ngram_join._partners(sent(sets)).any()  # the counts of 128 groups are too much alike
    linked = [np.unique(np.r_[s[:-(len(s) // 9)], new(len(s) // 20)]) for s in sets]  # 4100 and its partner differ in their number of groups
    both = sets + linked + [new(n) for n in rng.integers(2000, 6000, 60)]
    for a, b in zip(sets, linked):
        common = len(np.intersect1d(a, b))
        assert 100 * common >= 75 * (len(a) + len(b) - common)
    for some in (sets + linked, both):  # below and above the size of a tree
        partners = ngram_join._partners(sent(some))
        assert (partners[:14] > 0).all() and not partners[14:].any()
    assert {len(p) for p in sent([sets[3], linked[3]])} == {1024, 2048}
    crowd = np.arange(600, dtype=np.uint64) << np.uint64(8)  # 300 in one group are too many for a byte
    assert len(sent([crowd])[0]) > 256 and sent([crowd])[0].sum() == 600


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (-5, 300)]
    got = {r["node"]: r["root"] for r in C.connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 100, -5: -5, 300: -5}
    assert C.connected(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_suffix_dedup_matches_all_windows(docs_of, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choice("abc déf") for _ in range(400))
    rows = [(0, passage), (1, "x" * 350), (2, None), (3, passage[:99]), (4, passage[50:149]), (5, passage[40:140]), (6, "tail " + passage[200:] + passage[:150]),
            (7, "ab" * 200), (8, "ba" * 60), (9, passage), (10, "é" * 120), (11, passage[:180] + "#" + passage[181:])]
    for i in range(12, 30):
        k = rng.randrange(300)
        rows.append((i, "".join(rng.choice("abcd ") for _ in range(rng.randrange(200))) + passage[k:k + rng.randrange(180)] + rng.choice(["", "zz"])))
    want = brute.kept_bytes(rows)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup(docs_of(rows)).collect()}
    assert got == want
    assert suffix_dedup.dedup(docs_of(rows).limit(0)).count() == 0


def test_suffix_dedup_of_long_texts_in_pieces(docs_of):
    rng = random.Random(4)
    block = "".join(rng.choice("abcdefgh ") for _ in range(900_000))
    rows = [(0, block + block[1000:5000]), (1, "start" + block[300_000:700_000] + "end"), (1, "start" + block[300_000:700_000] + "end"), (None, block[5:305])]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup(docs_of(rows)).collect())
    assert got == [("0", 904_000, 4_300, 2), ("1", 400_008, 400_000, 1), ("1", 400_008, 400_000, 1), ("None", 300, 0, 0)]


ITEM = "the quick brown fox jumps over the lazy dog and then runs far away into the dark woods at night"


def test_containment_matches_exact_sets(spark, docs_of):
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 9, 20, 60])))) for i in range(40)] + [(90, ITEM), (91, ITEM.upper()), (92, None), (93, " ")]
    docs = [(0, None), (1, ""), (2, ITEM), (3, "lead " + ITEM.title() + " tail")]
    for i in range(4, 40):
        k = rng.randrange(len(items) - 2)
        part = mutated(rng, (items[k][1] or "x").split(), rng.choice([0, 0, 1, 3]), vocabulary)
        docs.append((i, " ".join([rng.choice(vocabulary) for _ in range(rng.randrange(400))] + part)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for d, text in docs:
        for i, item in items:
            own = brute.shingles(item)
            if own:
                have = brute.shingles(text, len(next(iter(own)))) if brute.words(text) else set()
                if 100 * len(own & have) >= 75 * len(own):
                    want.add((d, i))
    for block in (1 << 20, 50):
        found = decontaminate.matches(docs_of(docs), bench, block_shingles=block)
        assert {(r["doc_id"], m["item_id"]) for r in found.collect() for m in r["__items"]} == want
    left = decontaminate.remove(docs_of(docs), bench)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.remove(docs_of(docs), bench.limit(0)).count() == len(docs)
    assert decontaminate.remove(docs_of(docs).limit(0), bench).count() == 0


def test_items_without_an_id_are_found(spark, docs_of):
    bench = spark.createDataFrame([(4, ITEM), (None, ITEM.upper()), (None, "seven other words that stand alone here"), (-3, ITEM), (None, None)], "item_id bigint, text string")
    docs = docs_of([(0, "lead " + ITEM), (1, "so seven other words that stand alone here"), (2, "clean")])
    for block in (1 << 20, 1):
        found = {r["doc_id"]: [m["item_id"] for m in r["__items"]] for r in decontaminate.matches(docs, bench, block_shingles=block).collect()}
        assert found == {0: [None, -3, 4], 1: [None], 2: []}
    assert [r["doc_id"] for r in decontaminate.remove(docs, bench).collect()] == [2]


def plain_spans(text):
    text, found = text or "", []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_match_the_expressions(docs_of):
    key = "AKIA" + "Q7" * 8
    texts = [None, "", "é漢😀 password: hunter22!", "Token = 'abc'", "secret:token:abcdefg", "API_KEY=\"abc.def/ghi\" apikey: 12345", key + " AKIAAKIA" + "A" * 15,
             "f" * 23 + " " + "0123456789abcdef" * 3, "PASSWD=" + "a" * 30, f"{key}:{key}\nsecret  =   {'0' * 24}", "token=secret=abcdef secret='x' secret=longer1",
             "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "https://user:pass1@host", "x" * 20000 + "password=abcdef"]
    rows = list(enumerate(texts)) + [(2, "no secret here"), (None, "token=abcdefg"), (None, "token=abcdefg")]
    names = [r.kind for r in secret_scan.RULES]
    got = secret_scan.digest(secret_scan.scan(docs_of(rows))).collect()
    want = []
    for i, t in rows:
        base = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in plain_spans(t))
        want.append((i, *(sum(k == n for _, k, _ in plain_spans(t)) for n in range(3)), hashlib.sha256(base.encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[11] == "private_key:0:31" and "github:0:44" in spans[12] and "url_login" in spans[13]
    assert secret_scan.scan(docs_of(rows).limit(0)).count() == 0


def test_trigram_queries():
    q = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES}
    assert q["hex"] == secret_scan.ANY
    assert q["access"] == frozenset([frozenset({"aki", "kia"})])
    assert frozenset({"sec", "ecr", "cre", "ret"}) in q["assign"] and len(q["assign"]) == 6
    assert secret_scan.trigram_query("(abc)+x*def") == frozenset([frozenset({"abc", "def"})])


def test_quality_ledger_and_ablation(docs_of):
    rng = random.Random(8)
    clean = " ".join(f"word{rng.randrange(10**6)}" for _ in range(60))
    eight = "a b c d e f g h"
    texts = [None, "", " \n\t", clean, clean + "\n" + clean, eight + " " + eight, "x " * 40, eight, "l one\nl one\n\n\nl one\nother", "A1# $$ " * 30, " ".join(f"LOUDWORDS{i}" for i in range(30)), "é漢 " * 10, eight + " z " + eight[2:] + " a b"]
    led = quality_rules.ledger(docs_of(texts))
    got = {r["doc_id"]: r for r in led.collect()}
    for i, t in enumerate(texts):
        w = brute.WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if brute.WORD.search(x)]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), brute.repeated_words(t)), i
    policy = quality_rules.POLICIES["v1"]
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.apply_policy(led, policy).collect()}
    assert kept[3] == (False, True) and kept[0] == (True, False) and kept[4] == (True, False) and kept[10] == (False, False)
    names = list(quality_rules.RULES)
    for r in quality_rules.ablations(led, policy).collect():
        bit = 1 << names.index(r["rule"])
        assert r["n_failed"] == sum(bool(x["failed_bits"] & bit) for x in got.values())
        assert r["n_only_this"] == sum(x["failed_bits"] == bit for x in got.values())
    assert quality_rules.ledger(docs_of(texts).limit(0)).count() == 0
