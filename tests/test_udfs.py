"""User-function slots: resume, and one call per sample."""

from parley.operators import udfs


def test_resume_keeps_open_templates_of_a_done_uid(spark):
    reqs = spark.createDataFrame([("u", "a", "p1"), ("u", "b", "p2"), ("v", "a", "p3")], "uid string, prompt_template_name string, prompt string")
    done = reqs.where("uid = 'u' AND prompt_template_name = 'a'")
    out = udfs.complete_batch(reqs, lambda p: p.upper(), done=done).collect()
    assert sorted((r.uid, r.prompt_template_name, r.content) for r in out) == [("u", "b", "P2"), ("v", "a", "P3")]


def test_each_sample_is_sent_to_its_model_once(spark):
    calls = spark.sparkContext.accumulator(0)
    judged = spark.sparkContext.accumulator(0)

    def respond(prompt):
        calls.add(1)
        return "reply // " + prompt

    def judge(prompt):
        judged.add(1)
        return '```json\n[{"question": "q", "score": 3}]\n```' if "p1" in prompt else "no list"

    reqs = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "item long, prompt string")
    rows = udfs.judge_consistency(reqs, respond, judge, 3, ["item"]).collect()
    assert calls.value == 12 and judged.value == 4
    assert sorted((r.item, r.n_responses, r.n_errors, r.judge_status) for r in rows) == [(0, 3, 0, "parse_error"), (1, 3, 0, "ok"), (2, 3, 0, "parse_error"), (3, 3, 0, "parse_error")]
