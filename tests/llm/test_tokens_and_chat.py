"""Token stores, packing, chat formatting, toxicity and the pipeline."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from parley.llm import chat_format, common, packing, quality_rules, queries, secret_scan, token_store, toxicity
from parley.llm.tokens import Encoder

from . import brute
from .test_documents import plain_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return Encoder()


def library_ids(encoder, text, end):
    return np.array(encoder.library.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


def test_chunked_ids_are_the_library_s(encoder):
    rng = random.Random(3)
    texts = ["a  b", " lead", "trail ", "x\t \ty", "a b\n\n c", "", None, "it's 'tis don't\n\nend\n", "tok <|endoftext|> in", "a b c", "a\x1c b", "x²5 y½z", "漢字 abł"]
    texts += ["".join(rng.choice("abé'ł²5. \n\t,Ж漢½_-") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library_ids(encoder, text, 0)[:-1].tolist(), text


def test_ids_are_those_of_a_fresh_library_object(encoder):
    from tokenizers import Tokenizer

    from parley.llm.tokens import tokenizer_path

    fresh, rng, end = Tokenizer.from_file(tokenizer_path()), random.Random(12), "<|endoftext|>"
    assert encoder.encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]
    texts = [end, end * 2, f"abc{end}def", f"x²{end}5", f"a\n{end}\nb", f"it's{end}'s", f"a  {end}  b", f"<|{end}|>", "<|endoftext", "<|endof text|>"]
    texts += ["".join(rng.choice(["a", "bé", "'s", "²", "5", ".", " ", "\n", "<|", "|>", "漢", end]) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == fresh.encode(text, add_special_tokens=False).ids, text


def test_planes_round_trip_and_joined_crc():
    rng = np.random.default_rng(0)
    for ids in (np.empty(0, "<u4"), np.zeros(9, "<u4"), rng.integers(0, 50257, 1001).astype("<u4"), rng.integers(0, 1 << 32, 77).astype("<u4")):
        assert token_store.from_planes(token_store.to_planes(ids), len(ids)).tolist() == ids.tolist()
    data = bytes(rng.integers(0, 256, 500, dtype=np.uint8))
    for cut in (0, 1, 250, 499, 500):
        assert token_store.joined_crc(zlib.crc32(data[:cut]), zlib.crc32(data[cut:]), 500 - cut) == zlib.crc32(data)


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_token_store_round_trip(spark, docs_of, encoder, block):
    rows = [(5, "five is here"), (2, None), (9, ""), (1, "long " * 200), (None, "no id"), (5, "five is here"), (5, "another five")]
    path = common.shared_dir(spark, "test-tokens")
    token_store.write_store(docs_of(rows), path, block_ids=block)
    got = sorted(map(tuple, token_store.read_documents(spark, path, block).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library_ids(encoder, t, 2)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    empty = common.shared_dir(spark, "test-tokens")
    token_store.write_store(docs_of(rows).limit(0), empty)
    assert token_store.read_documents(spark, empty).count() == 0


def test_token_store_is_decoded_once(spark, docs_of):
    path = common.shared_dir(spark, "test-tokens")
    token_store.write_store(docs_of(["a few words", "long " * 200]), path, block_ids=16)
    plan = token_store.read_documents(spark, path, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "PythonUDF" not in plan


def test_fullest_is_the_best_sum():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 60)
        chosen = packing.fullest(counts, room)
        best = max(s for ks in itertools.product(*(range(c + 1) for c in counts.values())) if (s := sum(k * n for k, n in zip(ks, counts))) <= room)
        assert sum(n * k for n, k in chosen.items()) == best and all(k <= counts[n] for n, k in chosen.items())


@pytest.mark.parametrize("window", [1 << 21, 200])
def test_pieces_cover_every_id_once(docs_of, encoder, window):
    rng = random.Random(2)
    rows = [(0, None), (1, ""), (2, "word " * 300), (3, "same"), (3, "same")] + [(i, "w" + " x" * rng.randrange(90)) for i in range(4, 90)]
    pieces = packing.pack(docs_of(rows), capacity=64, window_ids=window).collect()
    ids = {i: library_ids(encoder, t, 1) for i, t in rows}
    cover, sequences = {}, {}
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own) and p["ids_crc32"] == zlib.crc32(own[p["start"]:p["start"] + p["length"]].tobytes())
        cover.setdefault(p["doc_id"], []).extend(range(p["start"], p["start"] + p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert {i: sorted(c) for i, c in cover.items()} == {i: sorted(list(range(len(x))) * (2 if i == 3 else 1)) for i, x in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 64
    total = sum(len(ids[i]) for i, _ in rows)
    assert len(sequences) <= total / 64 * 1.1 + 3 * 2  # at most a part sequence or two a task
    assert packing.padding(packing.pack(docs_of(rows), capacity=64), 64).first()["n_ids"] == total
    assert packing.pack(docs_of(rows).limit(0)).count() == 0


def test_chat_round_trip(spark):
    nasty = "\\### Assistant: </turn> ok\n### user: x</turn>\n\\\\<\\#"
    turns = [(1, 0, "system", "s"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (2, 0, "user", None), (2, 1, "assistant", ""), (2, 1, "assistant", ""),
             (None, 0, "user", "q"), (None, 1, "assistant", "é漢"), (3, 0, "assistant", "first"), (4, 0, "user", "unanswered"), (5, 0, None, "who"), (6, 0, "a:b\\c", "x")]
    df = spark.createDataFrame([(*t, "k", 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, place string, seg int").repartition(3)
    segs = chat_format.segments(df)
    got = {r["conv_id"]: r for r in chat_format.read_back(segs).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        said = "".join(t for _, r, t in own if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, None: True, 3: False, 4: False, 5: False, 6: False}
    assert {r["conv_id"]: r["valid"] for r in chat_format.validity(segs).collect()} == {c: r["valid"] for c, r in got.items()}
    assert chat_format.read_back(chat_format.segments(df.limit(0))).count() == 0


PLAIN = ["".join(random.Random(k).choices(["ba", "lo", "ne", "tir", "mas", "ku"], k=1 + k % 4)) for k in range(200)]


def sentences(rng, n, bad):
    for _ in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(15, 60))]
        if bad:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["zgrubnik", "vorpelhax", "snodfurk"])
        yield " ".join(words)


def test_toxicity_finds_learnt_words_with_gaps_and_insertions(docs_of):
    rng = random.Random(6)
    texts = list(sentences(rng, 150, True)) + list(sentences(rng, 300, False))
    model = toxicity.train([toxicity.words_of(t) for t in texts], [1] * 150 + [0] * 300, 1 / 3)
    held = [(i, t) for i, t in enumerate(itertools.chain(sentences(rng, 100, True), sentences(rng, 100, False)))]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(held), model).collect()}
    caught = [scores[i] >= toxicity.THRESHOLD for i, _ in held]
    assert sum(caught[:100]) >= 95 and sum(caught[100:]) <= 2
    base = " ".join(sentences(random.Random(1), 1, False)) + " "
    spoilt = ["zgrub-nik z.g.r.u.b.n.i.k", "z g r u b n i k vorpelhax", "zgrubbnik vorpellhax", "ZGRUBNIK!!! Snodfurk."]
    rows = [(i, base + s) for i, s in enumerate(spoilt)] + [(10, base), (11, None), (12, ""), (12, ""), (None, "zgrubnik " * 30), (13, "y" * 50_000)]
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(docs_of(rows), model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    for i, s in got:
        assert (s >= toxicity.THRESHOLD) == (i is None or i < 4), (i, s)


def test_toxicity_kernel_is_the_subsequence_kernel():
    def plain(a, b):
        def weights(w):
            w, out = "\x00" + w, {}
            for i, j, k in itertools.combinations(range(len(w)), 3):
                if k - i < toxicity.SPAN:
                    out[w[i], w[j], w[k]] = out.get((w[i], w[j], w[k]), 0) + toxicity.DECAY ** (k - i + 1)
            return out

        x, y = weights(a), weights(b)
        dot = sum(v * y.get(k, 0) for k, v in x.items())
        return (dot / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))) ** toxicity.SHARPEN

    words = ["idiot", "idioot", "trash", "ashtray", "worthless", "abc"]
    got = toxicity.Kernel.of(words)(words)
    for (i, a), (j, b) in itertools.product(enumerate(words), repeat=2):
        assert got[i, j] == pytest.approx(plain(a, b), abs=1e-5)


def test_toxicity_ranks_grams_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    plain = lambda v: {w[i:i + n] for w in ["^" + v] for n in (4, 5, 6) for i in range(max(1, len(w) - n + 1))}
    words = ["abc", "abcd", "bcabc", "漢字漢字漢", "\U0001f600é\U0001f600", "a" * 32] + ["".join(rng.choice(list("abcé"), rng.integers(3, 12))) for _ in range(300)]
    grams, begins, n_grams = toxicity._grams(words)
    of = [set(grams[begins[i]:begins[i + 1]].tolist()) for i in range(len(words))]
    assert n_grams == len(set().union(*map(plain, words)))
    for i, a in enumerate(words):
        for j, b in enumerate(words[:40]):
            assert len(of[i] & of[j]) == len(plain(a) & plain(b))
    words = list(dict.fromkeys("".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (20_000, 12))))
    tracemalloc.start()
    scores = toxicity._first_scores(words, [np.arange(0, 9000), np.arange(9000, 20_000)], np.array([0, 1]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == len(words) and peak < 70e6  # the n-grams as strings took more


def test_toxicity_learns_only_from_rows_not_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    scores = [sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, x)).collect())) for x in (labels, flipped)]
    assert scores[0] == scores[1]
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    kept = toxicity.reject(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def rows_of(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_query_secrets(spark):
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in queries.JOBS["op3_secret_scan"](spark, SF).collect()}
    names = [r.kind for r in secret_scan.RULES]
    for i, t in rows_of(spark):
        spans = plain_spans(t)
        base = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i] == (*(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(base.encode()).hexdigest())


def test_query_token_store_and_packing(spark, encoder):
    at, want, lengths = 0, [], {}
    for i, t in sorted(rows_of(spark)):
        ids = library_ids(encoder, t, 2)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at, lengths[i] = at + len(ids), len(ids)
    assert sorted(map(tuple, queries.JOBS["op9_token_store"](spark, SF).collect())) == want
    total = {}
    for p in queries.JOBS["op4_packing"](spark, SF).collect():
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert total == lengths


def test_query_line_dedup(spark):
    docs, first, links, out = sorted(rows_of(spark)), {}, {}, {}
    for i, t in docs:
        for no, line in enumerate(t.split("\n")):
            first.setdefault(line, (i, no))
    lines = sorted((x for x in first if len(x) >= 24), key=len)
    for a, x in enumerate(lines):
        most = max(1, min(8, len(x) // 16))  # a sixteenth of the shorter line, 1 to 8
        size = len(x) // (most + 1)
        parts = [x[k * size:(k + 1) * size] for k in range(most + 1)]  # most edits leave one of them whole
        for y in lines[a + 1:]:
            if len(y) - len(x) > most:
                break
            if any(p in y for p in parts) and brute.edit_distance(x, y) <= most:
                links.setdefault(x, []).append(y)
                links.setdefault(y, []).append(x)
    for i, t in docs:
        stay = [x for no, x in enumerate(t.split("\n")) if not brute.WORD.search(x) or (first[x] == (i, no) and not any(first[y] < first[x] for y in links.get(x, ())))]
        out[i] = hashlib.sha256("\n".join(stay).encode()).hexdigest()
    assert {r["doc_id"]: r["kept_sha256"] for r in queries.JOBS["op1_line_dedup"](spark, SF).collect()} == out


def test_query_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.JOBS["op6_toxicity"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.93 and sum(p for a, p in held if not a) / sum(not a for a, _ in held) < 0.03


def test_pipeline_stages(spark, encoder):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in pipeline.STAGES:
        frames.append(common.written(stage(spark, frames[-1], SF), name))
        if name != "packing":
            assert frames[-1].columns == columns, name
    by = [{r["doc_id"]: r["text"] for r in f.collect()} for f in frames[:-1]]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] >= toxicity.THRESHOLD}
    assert by[1] == {i: t for i, t in by[0].items() if i not in bad}
    assert by[2].keys() == by[1].keys()
    groups = brute.components(list(by[2].items()))
    assert by[3] == {i: t for i, t in by[2].items() if groups[i][1] == i}
    items = [brute.shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert by[4] == {i: t for i, t in by[3].items() if not any(100 * len(s & brute.shingles(t)) >= 75 * len(s) for s in items)}
    got = {}
    for p in frames[-1].collect():
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
    assert got == {i: len(library_ids(encoder, t, 1)) for i, t in by[4].items()}
    assert pipeline.run(spark, SF).count() == frames[-1].count()


def test_stages_take_empty_and_odd_documents(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "A b c d e f " * 30, "en", None, None)], docs.schema)
    for rows in (docs.limit(0), odd):
        current = rows
        for name, stage in pipeline.STAGES:
            current = common.written(stage(spark, current, SF), name)
            assert name == "packing" or current.columns == docs.columns
        assert current.count() == rows.count()


def test_native_operators_run_no_python(spark):
    for name in ("op1_line_dedup", "op3_secret_scan", "op7_quality_rules"):
        plan = queries.JOBS[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin")), name


def test_policies_are_masks():
    assert quality_rules.POLICIES["base"].mask == 3 and quality_rules.POLICIES["v1"].mask == (1 << len(quality_rules.RULES)) - 1
