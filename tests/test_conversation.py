"""Conversation operators on inline transcripts (edge cases the driver tables do not contain)."""

from pyspark.sql import functions as F

from parley.operators import conversation as conv

PREFIXES = ("Counselor:", "Patient:", "Therapist:", "Client:")


def blocks_py(text):
    """Plain-Python statement of the block rule: a prefixed line with a new speaker opens a block."""
    out, cur, who = [], [], None
    for line in text.split("\n"):
        sp = next((p for p in PREFIXES if line.startswith(p)), None)
        if sp is not None and sp != who:
            if cur:
                out.append("\n".join(cur))
            cur, who = [line], sp
        else:
            cur.append(line)
    if cur:
        out.append("\n".join(cur))
    return out


TEXTS = [
    "Intro line\nsecond intro\nClient: hi\nClient: still me\nCounselor: hello\nunprefixed more\nCounselor: again\n"
    "Client: ok\nCounselor:   last one  ",
    "Counselor: opening\nClient: a\nTherapist: b\nPatient: c\nCounselor: d",
    "no speakers at all\nstill none",
    "Client: x\n\nClient: y\nCounselor: z\n",
    "  Counselor: indented is not a prefix\nClient: q\nCounselor: r",
]


def _transcripts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "conv_id long, conversation string")


def test_speaker_blocks_match_rule(spark):
    b = conv.speaker_blocks(conv.turns_from_text(_transcripts(spark)))
    got = {}
    for r in b.collect():
        got.setdefault(r.conv_id, []).append((r.block_idx, r.text))
    for i, t in enumerate(TEXTS):
        assert [x for _, x in sorted(got[i])] == blocks_py(t)
        # blocks re-joined give the input back
        assert "\n".join(x for _, x in sorted(got[i])) == t


def test_history_pairs_and_prefix_strip(spark):
    tr = _transcripts(spark)
    b = conv.speaker_blocks(conv.turns_from_text(tr))
    pairs = {(r.conversation_id, r.pair_idx): r for r in conv.history_pairs(b, tr).collect()}
    for i, t in enumerate(TEXTS):
        blocks = blocks_py(t)
        exp = []
        for k, blk in enumerate(blocks):
            if blk.startswith("Counselor:"):
                lines = [ln[len("Counselor:"):].strip() if ln.startswith("Counselor:") else ln
                         for ln in blk.strip().split("\n")]
                exp.append(("\n".join(blocks[:k]), "\n".join(lines).strip()))
        got = [(pairs[(i, j)].convo_history, pairs[(i, j)].counselor_message) for j in range(len(exp))]
        assert got == exp
        assert (i, len(exp)) not in pairs


def test_trim_edges_counts(spark):
    rows = [(c, j) for c, n in [(1, 4), (2, 5), (3, 2), (4, 0)] for j in range(n)]
    df = spark.createDataFrame(rows, "conversation_id long, pair_idx long")  # no count column: joined count
    for n in (0, 1, 2):
        got = {r.conversation_id: r["count"] for r in conv.trim_edges(df, n).groupBy("conversation_id").count().collect()}
        for c, total in [(1, 4), (2, 5), (3, 2)]:
            assert got.get(c, 0) == (total if n == 0 else max(0, total - 2 * n))


def test_sample_per_group_is_layout_independent(spark):
    rows = [(c, j) for c in range(20) for j in range(7)]
    df = spark.createDataFrame(rows, "conversation_id long, pair_idx long")
    a = {tuple(r) for r in conv.sample_per_group(df, 3, 16, "conversation_id", "pair_idx").collect()}
    b = {tuple(r) for r in conv.sample_per_group(df.repartition(7), 3, 16, "conversation_id", "pair_idx").collect()}
    assert a == b and len(a) == 60


def test_client_message_runs(spark):
    text = "Client: a\nclient: b\nCounselor: x\nCLIENT:   c\n\nClient: d\nother\nClient: e"
    df = spark.createDataFrame([(1, text)], "conv_id long, conversation string")
    got = [r.message for r in conv.client_messages(df).orderBy("msg_idx").collect()]
    assert got == ["a // b", "c", "d", "e"]


def test_dialogue_cleanup_marker_and_cap(spark):
    rows = [(1, 0, "user", "p1"), (1, 1, "assistant", "c1 // c1b"), (1, 2, "user", "bye [END CONVERSATION]"),
            (1, 3, "assistant", "never"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"),
            (2, 3, "assistant", "d"), (2, 4, "user", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.turn, r.part_idx, r.message)
                 for r in conv.dialogue_cleanup(df, max_messages=100).collect())
    # conv 1: the marker reply is kept (with its parts), nothing after it
    assert [g for g in got if g[0] == 1] == [(1, 0, 0, "p1"), (1, 1, 0, "c1 "), (1, 1, 1, " c1b"),
                                             (1, 2, 0, "bye [END CONVERSATION]")]
    capped = sorted((r.conv_id, r.turn) for r in conv.dialogue_cleanup(df, max_messages=3).collect())
    # history starts at 1 entry and grows by 2 per message part; a patient turn starts only below 6 entries
    assert [t for c, t in capped if c == 1] == [0, 1, 1]
    assert [t for c, t in capped if c == 2] == [0, 1, 2, 3]


def test_first_n_per_group(spark):
    rows = [(i, i % 3, None if i % 2 else "7", f"2024-01-{(i % 28) + 1:02d} 10:00:00", None if i == 4 else f"m{i}")
            for i in range(30)]
    df = spark.createDataFrame(rows, "ID long, Ticket_ID long, Agent_ID string, Sent_Date_And_Time string, Thread_Content string")
    out = conv.first_n_per_group(df, n=3)
    got = out.groupBy("ticket_id").count().collect()
    assert all(r["count"] <= 3 for r in got)
    assert out.filter(F.col("message").isNull()).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan


def test_chunked_scans_match_single_chunk(spark):
    tr = _transcripts(spark)
    lines = conv.turns_from_text(tr)
    one = {tuple(r) for r in conv.speaker_blocks(lines).collect()}
    tiny = {tuple(r) for r in conv.speaker_blocks(lines, chunk_rows=2).collect()}
    assert one == tiny
    for size in (1, 2, 3):
        tiny = {tuple(r) for r in conv.speaker_blocks(lines, chunk_rows=size).collect()}
        assert one == tiny, size
    hp1 = {tuple(r) for r in conv.history_pairs(conv.speaker_blocks(lines), tr).collect()}
    hp2 = {tuple(r) for r in conv.history_pairs(conv.speaker_blocks(lines, chunk_rows=1), tr).collect()}
    assert hp1 == hp2
    text = "Client: a\nclient: b\nCounselor: x\nCLIENT:   c\n\nClient: d\nother\nClient: e"
    df = spark.createDataFrame([(1, text)], "conv_id long, conversation string")
    assert ({tuple(r) for r in conv.client_messages(df).collect()}
            == {tuple(r) for r in conv.client_messages(df, chunk_rows=2).collect()})
