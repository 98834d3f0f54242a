"""Batch packing vs greedy per shard; token counts; redaction rules."""

import random
import re

from pyspark.sql import functions as F

from parley.operators import cost as cs
from parley.operators import redact as rd


def test_pack_batches_within_limits_on_any_layout(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([0, 5, 39, 40, 90, 250, rnd.randrange(1, 120)])) for i in range(600)] + [(10_000_000, 40)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    outs = [sorted(map(tuple, cs.pack_batches(x, "doc_id", "tokens", max_tokens=200, max_items=4, ids_per_bucket=b).collect()))
            for x, b in ((df.coalesce(1), 100), (df.repartition(7, "tokens"), 100), (df.repartition(5), 1_000_000))]
    assert outs[0] == outs[1] == outs[2] and len(outs[0]) == len(rows)
    batches = {}
    for doc_id, tokens, size_class, _, pos, batch in outs[0]:
        batches.setdefault(batch, []).append((pos, tokens, doc_id))
        assert tokens <= size_class <= tokens * 1.25
    for items in batches.values():
        items.sort()
        assert [p for p, *_ in items] == list(range(len(items))) and len(items) <= 4
        assert sum(t for _, t, _ in items) <= 200 or len(items) == 1
        assert [x[1:] for x in items] == sorted(x[1:] for x in items)


def _one_pass(items, max_tokens, max_items):
    out, batch, used, n = {}, -1, 0, 0
    for tokens, i, key in sorted((max(t or 0, 0), i, key) for key, (i, t) in enumerate(items)):
        if batch < 0 or used + tokens > max_tokens or n == max_items:
            batch, used, n = batch + 1, 0, 0
        out[key] = (i, tokens, batch, n)
        used, n = used + tokens, n + 1
    return sorted(out.values())


def test_greedy_batches_are_those_of_one_pass(spark):
    rnd = random.Random(3)
    hot = [(i, 7) for i in range(1000, 2000)]  # one length holds most items
    cases = [([(i, rnd.choice([None, -3, 0, 1, 39, 40, 201, 900, rnd.randrange(120)])) for i in range(300)], 200, None),
             ([(rnd.randrange(50), rnd.randrange(9)) for _ in range(400)], 30, 5), (hot + [(i, rnd.randrange(60)) for i in range(200)], 100, None),
             (hot, 7, None), ([(i, 0) for i in range(40)] + [(99, 500)], 10, None), ([(i, 0) for i in range(40)], 10, 6), ([(1, 5)], 3, 2), ([], 10, None)]
    for items, most, many in cases:
        df = spark.createDataFrame(items, "doc_id long, tokens long")
        for layout, bucket in ((df.coalesce(1), 7), (df.repartition(5), 1_000_000)):
            got = sorted(map(tuple, cs.greedy_batches(layout, "doc_id", "tokens", most, many, ids_per_bucket=bucket).collect()))
            assert got == _one_pass(items, most, many), (most, many)


def test_message_tokens(spark):
    df = spark.createDataFrame([([("system", "abcd"), ("user", "abcde")],)], "messages array<struct<role:string,content:string>>")
    # 3 + (4 + 2 + 1) + (4 + 1 + 2)
    assert df.select(cs.message_tokens("messages").alias("n")).first().n == 17


def test_extend_linear_form_is_equivalent():
    rnd = random.Random(9)
    alphabet = "ab1 .<>/-PHI"
    for label, pat in rd.EXTEND_PATTERNS:
        fast = re.compile(rd._linear(pat).replace("++", "+"))   # Python re: same language, no possessive needed
        slow = re.compile(pat)
        for _ in range(300):
            s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 20)))
            s = s.replace("PHI", f"<{label}>")
            assert slow.sub("<PHI>", s) == fast.sub("<PHI>", s), (label, s)


def test_redact_names_and_spans(spark):
    df = spark.createDataFrame([(1, "Anna met ANNA and annabel, anna."), (2, "éanna stays; anna_b stays")], "id long, text string")
    names = spark.createDataFrame([("anna",)], "name string")
    got = {r.id: r.out for r in rd.redact_names(df, "text", names, "out").collect()}
    assert got == {1: "[NAME] met [NAME] and annabel, [NAME].", 2: "éanna stays; anna_b stays"}
    # rows without a unique key, names that are no single word, a long list
    twice = spark.createDataFrame([(7, "Hi Mary Ann"), (7, "second Bob row"), (7, None), (7, "Hi Mary Ann"), (8, "")], "id long, text string")
    many = spark.createDataFrame([(n,) for n in ["mary ann", "o'neil", " BOB ", *(f"name{i}" for i in range(5000))]], "name string")
    out = sorted((r.id, r.out) for r in rd.redact_names(twice, "text", many, "out").where("out IS NOT NULL").collect())
    assert out == [(7, "Hi Mary Ann"), (7, "Hi Mary Ann"), (7, "second [NAME] row"), (8, "")]
    spans = spark.createDataFrame([("Call Bob at 5551234 now", [(5, 8, "PER", 0.9), (12, 19, "DATE", 0.3), (20, 23, "X", 0.5)])],
                                  "text string, spans array<struct<start:int,end:int,label:string,score:double>>")
    assert spans.select(rd.apply_spans(F.col("text"), F.col("spans")).alias("o")).first().o == "Call <PERSON> at 5551234 <PHI>"


def test_accuracy_counts_null_as_wrong(spark):
    df = spark.createDataFrame([("1", "none"), ("0", "email (x), age (a message)"), (None, None)], "label_m string, errors_m string")
    r = rd.accuracy_report(df, ["m"]).first()
    assert (r.n_messages_correct, r.n_messages_incorrect, r.n_unlabelled) == (1.0, 2.0, 1)
    assert r.email == 1 and r.age == 1 and abs(r.overall_accuracy - 1 / 3) < 1e-9


def test_fast_email_form_is_equivalent():
    rnd = random.Random(4)
    slow = re.compile(rd.PHI_PATTERNS[0][1])
    fast = re.compile(rd._FAST_FORMS["email"].replace("++", "+"))
    alphabet = "ab.1-_ @x"
    for _ in range(2000):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 24)))
        assert slow.sub("<E>", s) == fast.sub("<E>", s), s


def test_accuracy_strict_error_types(spark):
    df = spark.createDataFrame([("0", "age (a message), email (x)")], "label_m string, errors_m string")
    loose = rd.accuracy_report(df, ["m"]).first()
    strict = rd.accuracy_report(df, ["m"], strict=True).first()
    assert (loose.age, loose.email) == (1, 1) and (strict.age, strict.email) == (1, 1)
    df2 = spark.createDataFrame([("0", "other (a message)")], "label_m string, errors_m string")
    assert rd.accuracy_report(df2, ["m"]).first().age == 1 and rd.accuracy_report(df2, ["m"], strict=True).first().age == 0


def test_extend_parity_and_typed(spark):
    df = spark.createDataFrame([("call <PERSON>Smith, then Acme Corp<ORGANIZATION>. On 1/2/2024<DATE_TIME>",)], "t string")
    parity = rd.extend_column(df, "t").first().t
    typed = rd.extend_column(df, "t", typed=True).first().t
    # the organisation pattern swallows the whole run of words and blanks before its placeholder
    assert parity == "call <PHI><PHI> On <PHI>"
    assert typed == "call <PERSON><ORGANIZATION> On <DATE_TIME>"


def test_star_import():
    scope = {}
    exec("from parley.operators.redact import *", scope)  # every exported name exists
    assert "redact_patterns_df" in scope


def _whole_text(text, threshold=0.45):
    spans = sorted((x for x in rd.regex_detector(text) if x[3] >= threshold), key=lambda x: x[0])
    out, pos = [], 0
    for s, e, label, _ in spans:
        out += [text[pos:s], rd.ENTITY_PLACEHOLDER.get(label, "<PHI>")]
        pos = e
    return "".join([*out, text[pos:]]), len(spans)


def test_redact_spans_in_windows_is_that_of_the_whole_text(spark):
    rnd = random.Random(8)
    words = ["Anna", "Acme Inc", "bob", "12345", "Élan", "x", "Roberta.", "Big Ltd,", "\n", "7", "été", "Wilhelmina"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 900))) for _ in range(40)] + [None, "", "Anna", "  ", "Z" * 3000 + " Roberta"]
    texts += texts[:3]  # equal long texts
    df = spark.createDataFrame([(i % 5, t, "kept") for i, t in enumerate(texts)], "n_spans int, text string, out string").repartition(3)
    seen = {t: (None, 0) if t is None else _whole_text(t) for t in texts}
    for tokens, context in ((510, 32), (40, 12), (25, 10)):
        got = rd.redact_spans(df.select("text", "out"), "text", rd.regex_detector, "out", max_tokens=tokens, context=context).collect()
        assert len(got) == len(texts) and all((r.out, r.n_spans) == seen[r.text] for r in got), (tokens, context)


def test_a_long_text_is_detected_in_several_tasks(spark):
    """A text of ten million characters: many windows in several tasks, each within the limit."""
    text = "Wilhelmina said nothing to Bo. " * 322_581
    df = spark.createDataFrame([(text,)], "text string")
    windows = rd.text_windows(df.select(F.lit("k").alias("key"), "text"))
    sizes = windows.select(F.spark_partition_id().alias("p"), F.regexp_count("text", F.lit(rd._JVM_TOKEN)).alias("n"),
                           (F.col("own_hi") - F.col("own_lo")).alias("own")).groupBy("p").agg(F.max("n").alias("n"), F.sum("own").alias("own")).collect()
    assert len(sizes) > 2 and max(r.n for r in sizes) <= rd.WINDOW_TOKENS and sum(r.own for r in sizes) == len(text) > 10_000_000
    got = rd.redact_spans(df, "text", rd.regex_detector, "out").first()
    assert got.n_spans == 322_581 and got.out == text.replace("Wilhelmina", "<PERSON>")
