"""JSON parsing and score flattening on inline replies."""

from pyspark.sql import functions as F

from parley.functions import jsonx
from parley.operators import judge as jg


def test_strict_parse_rejects_trailing_text(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 1}\nthanks',), ('{"a":1}, {"b":2}',), ("  [1, 2]  ",), ("nope",)],
                               "t string")
    got = [r.ok for r in df.select(jsonx.strict_parse_json("t").isNotNull().alias("ok")).collect()]
    assert got == [True, False, False, True, False]


def test_json_block_paths(spark):
    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("Sure: {\"a\": 2} done",), ("{broken",)], "t string")
    got = [r.p for r in df.select(jsonx.json_block_path("t").alias("p")).collect()]
    assert got == ["whole", "brace", "failed"]


def test_flatten_rules(spark):
    rows = [
        ("e1", "rubric", '{"P1": true, "P2": "NA", "P3": "2", "P_justification": "pj", "notes": "x"}'),
        ("e2", "concern", '```json\n{"score": 4, "rationale": "fits"}\n```'),
        ("e3", "real", '{"language": {"score": 3, "justification": "j"}, "real.total": {"score": 5}}'),
        ("e4", "bad", "not json"),
    ]
    df = spark.createDataFrame(rows, "trace_id string, eval_name string, raw string")
    got = {(r.trace_id, r.score_name): (r.value, r.comment) for r in jg.flatten_scores(df).collect()}
    assert got == {("e1", "rubric.P1"): (1.0, "pj"), ("e1", "rubric.P3"): (2.0, "pj"),
                   ("e2", "concern.score"): (4.0, "fits"), ("e3", "real.language"): (3.0, "j"),
                   ("e3", "real.total"): (5.0, None)}


def test_completion_shapes(spark):
    lines = [
        ("f.jsonl", 1, '{"completion": "hello", "uid": "u1", "prompt_template_name": "t"}'),
        ("f.jsonl", 2, '[{"messages": []}, {"choices": [{"message": {"content": "hi"}}]}, {"metadata": {"uid": "u2"}}]'),
        ("f.jsonl", 3, '[{"messages": []}, ["rate limit"], {"metadata": {"uid": "u3"}}]'),
        ("f.jsonl", 4, "garbage"),
        ("f.jsonl", 5, "   "),
    ]
    df = spark.createDataFrame(lines, "file_name string, line_no long, line string")
    got = {r.status: (r.uid, r.content, r.error) for r in jg.completion_extract(df).collect()}
    assert got["ok"] in [("u1", "hello", None), ("u2", "hi", None)]
    assert got["failed"] == ("u3", None, "rate limit")
    assert got["unparsed"][1] is None
    assert jg.completion_extract(df).count() == 4


def test_eval_unpivot_unit_score_keys(spark):
    name = "dialogue|dlg1_x_anxiety_3|cp|ed|model|20240101.jsonl"
    rows = [(name, 0, '{"realism": {"score": 3, "rationale": "r"}}'),
            (name, 1, '{"q": {"n_question_messages": 2, "explanation": "e"}, "u": {"unsafe_behavior": 1}, "s": "skip"}'),
            (name, 2, '{"emp": {"score": 4, "rationale": "x"}}'),
            ("bad|name.jsonl", 0, "{}")]
    df = spark.createDataFrame(rows, "file_name string, line_no long, text string")
    out, errors = jg.eval_unpivot(df)
    got = {(r.evaluation_type, r.category): (r.score, r.rationale) for r in out.collect()}
    assert got[("counselor_unit_test", "q")] == (2.0, "e")
    assert got[("counselor_unit_test", "u")] == (1.0, None)
    assert ("counselor_unit_test", "s") not in got
    r = out.first()
    assert (r.dialogue_name, r.patient_type, r.timestamp) == ("dlg1", "anxiety_3", "20240101")
    assert [e.error for e in errors.collect()] == ["bad file name"]


def test_unit_test_keys_are_normalized(spark):
    name = "dialogue|dlg2_x_dep_1|cp|ed|model|20240102.jsonl"
    rows = [(name, 0, "{}"), (name, 1, '{"n_tasks": {"Total Number of Tasks": 3, "rationale": "r"}}'), (name, 2, "{}")]
    out, _ = jg.eval_unpivot(spark.createDataFrame(rows, "file_name string, line_no long, text string"))
    assert [(r.category, r.score) for r in out.collect()] == [("n_tasks", 3.0)]
