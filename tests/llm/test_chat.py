import hashlib
import random

from pyspark.sql import functions as F

from plumbline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", "plain", r"\### Assistant: </turn> ok", "</turn>", "####", "a </turn>\n### User: b", "\\", "\\\\</turn>", "<\\/turn>", "é😀\n", "$1 \\$", "</tur</turn>", "### ", None]


def expect(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    state, bad = "start", None
    allowed = {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
    for i, r in enumerate(rows):
        state = allowed.get(state, {}).get(r[2], "bad")
        bad = i if state == "bad" and bad is None else bad
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(rows), sha(turns), len(loss), sha(loss), state == "assistant", bad)


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid, r.first_invalid) for r in df.collect()}


def test_reads_back_what_it_wrote(spark):
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "tool", "Assistant", "a: b", None]
    data = [(c, t, rng.choice(roles[:3] if c % 2 else roles), rng.choice(NASTY)) for c in range(40) for t in range(rng.randint(1, 9))]
    data += [(100, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(600)]  # over several blocks
    data += [(101, 5, "user", "same turn"), (101, 5, "user", "same turn"), (101, None, "system", "no turn"), (None, 0, "user", "no id")]
    by = {}
    for r in data:
        by.setdefault(r[0], []).append(r)
    df = spark.createDataFrame(data, SCHEMA).withColumn("segments", F.lit("clash")).withColumn("block", F.lit(1))
    assert got(chat.digest(chat.format_conversations(df))) == {c: expect(rows) for c, rows in by.items()}


def test_no_control_is_left_in_a_text(spark):
    rows = [(0, i, "assistant", t) for i, t in enumerate(NASTY)]
    segments = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first().segments
    bodies = [s.text for s in segments if s.loss]
    assert len(bodies) == len(NASTY) and not any(c in b for b in bodies for c in chat.Template().controls)
    assert "".join(s.text for s in segments).count("</turn>") == len(NASTY)


def test_empty_table(spark):
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_states_of_the_machine(spark):
    rows = [(1, 0, "user", "q"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "assistant", "a"), (4, 0, "system", "s"), (4, 1, "system", "s")]
    out = {r.conv_id: (r.valid, r.first_invalid) for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: (False, None), 2: (True, None), 3: (False, 0), 4: (False, 1)}
