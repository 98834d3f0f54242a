"""File sources, the driver contract and plan shape checks."""

import os
import tempfile

from parley.sources import files

from conftest import SF


def test_scan_csv_and_jsonl(spark):
    d = tempfile.mkdtemp(prefix="parley-src-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write('uid,conversation\nx1,"Client: hi\nCounselor: ""quoted"" hello"\nx2,plain\n')
    df = files.scan_csv(spark, os.path.join(d, "a.csv"), "uid string, conversation string", multiline=True)
    rows = {r.uid: r.conversation for r in df.collect()}
    assert rows["x1"] == 'Client: hi\nCounselor: "quoted" hello' and df.first().file_name == "a.csv"
    with open(os.path.join(d, "b.jsonl"), "w") as f:
        f.write('{"metadata": {"k": "v"}}\n\n[1, 2]\n{"metadata": {"k": "w"}}\n')
    j = files.scan_jsonl(spark, os.path.join(d, "b.jsonl"))
    assert j.count() == 3
    assert files.scan_jsonl_filter(j, {"k": ["v"]}).count() == 1


def test_entry_contract(spark):
    import __spark_entry__ as e

    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 50
    df = e.entry(spark)
    assert df.columns == ["uid", "conversation_id", "pair_idx", "convo_history", "counselor_message"]
    assert df.count() >= 0


def test_plans_stay_jvm_side(spark):
    import __spark_entry__ as e

    for name in ("score_stats", "weighted_rubric", "speaker_blocks", "latency_metrics", "cost_estimate"):
        plan = e.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
    scan = e.queries()["first_n_per_group"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderkey" in scan and "o_totalprice" not in scan  # pruned projection reaches the scan


def test_scan_csv_dir_row_index(spark):
    d = tempfile.mkdtemp(prefix="parley-csvdir-")
    for name, n in (("a.csv", 5), ("b.csv", 3)):
        with open(os.path.join(d, name), "w") as f:
            f.write("line,text\n" + "".join(f"{10 * i + 3},t{i}\n" for i in range(n)))
    df = files.scan_csv_dir(spark, d, "line long, text string", order_col="line")
    got = sorted((r.file_name, r.line, r.row_index) for r in df.collect())
    assert [x[2] for x in got if x[0] == "a.csv"] == [0, 1, 2, 3, 4]
    assert [x[2] for x in got if x[0] == "b.csv"] == [0, 1, 2]


def test_wholetext_sinks_and_small_helpers(spark):
    from pyspark.sql import functions as F

    from parley.functions.text import collapse_ws
    from parley.operators.prompts import limit_samples
    from parley.operators.redact import crosswalk
    from parley.operators.retrieval import record_to_query

    d = tempfile.mkdtemp(prefix="parley-misc-")
    for name, text in (("a.txt", "Client: hi\nCounselor: hello\n"), ("b.txt", "x")):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    w = {r.file_name: r.text for r in files.scan_wholetext(spark, os.path.join(d, "*.txt")).collect()}
    assert w == {"a.txt": "Client: hi\nCounselor: hello\n", "b.txt": "x"}
    df = spark.createDataFrame([(1, "a  b\n c "), (2, "z")], "uid long, t string")
    out = os.path.join(d, "out")
    files.sink_jsonl(df, out + "/j")
    files.sink_csv(df, out + "/c")
    files.sink_split(df, out + "/s", 2, "uid")
    assert spark.read.json(out + "/j").count() == 2 and spark.read.json(out + "/s").count() == 2
    assert spark.read.option("header", True).option("multiLine", True).csv(out + "/c").count() == 2
    assert [r.c for r in df.select(collapse_ws("t").alias("c")).orderBy("uid").collect()] == ["a b c", "z"]
    assert limit_samples(df.withColumn("prompt_template_name", F.lit("t")), 1).count() == 1
    assert [tuple(r) for r in crosswalk(df, "uid", True).orderBy("uid").collect()] == [(1, True), (2, True)]
    rec = spark.createDataFrame([("", None, [("user", "m1"), ("user", "m2")], ("u1",))],
                                "body string, prompt string, messages array<struct<role:string,content:string>>, "
                                "metadata struct<uid:string>")
    q = rec.select(record_to_query(F.col("body"), F.col("prompt"), F.col("messages"), F.col("metadata")).alias("q")).first().q
    assert q == "m1\nm2"


def test_jsonl_completions_returns_every_line(spark):
    from parley.plans import file_jobs, judge_jobs  # noqa: F401 - they register the jobs
    from parley.plans.registry import JOBS

    sf, cols = "/root/testdata/sf0.01", ["prompt_template_name", "content", "input_file_name", "status", "error", "normalized_text"]
    want = JOBS["extract_completions"](spark, sf).select(*cols).collect()
    got = JOBS["jsonl_completions"](spark, sf).select(*cols).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
