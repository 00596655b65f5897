"""Prefix-target examples: exact round trips, also of texts that hold control strings."""

import random

from pyspark.sql import functions as F

from footgrid.llm import chat

BITS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "<\\s>", "[\\\\/INST]", "<INST]", "a", " ", "\n", "é", "😀", ">", "]", "/s>", "$1"]


def fixture():
    rng = random.Random(4)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, 3, None]), rng.choice(["user", "assistant", "system", None, "a[/INST]b", "</s>"]),
                         rng.choice([None, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 15)))])))
    return rows + [rows[0], rows[1], (99, 0, "user", "only"), (98, 0, "assistant", "y" * 100000)]


def test_round_trip(spark):
    rows = fixture()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, line string, stop int")
    made = chat.examples(frame).cache()
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    assert set(back) == set(convs)
    for conv, turns in convs.items():
        turns = [(r[2] or "", r[3] or "") for r in sorted(turns, key=order)]
        got = back[conv]
        assert [(t.role, t.text) for t in got.turns] == turns
        assert got.loss == "".join(t for r, t in turns if r == "assistant")
    examples = made.collect()
    for conv, turns in convs.items():
        own = sorted((e for e in examples if e.conv_id == conv), key=lambda e: len(e.text))
        ordered = [(r[2] or "", r[3] or "") for r in sorted(turns, key=order)]
        replies = [k for k, (r, _) in enumerate(ordered) if r == "assistant"]
        tail = not replies or replies[-1] < len(ordered) - 1
        assert len(own) == len(replies) + tail and sum(e.last for e in own) == 1
        assert sum(len(e.text) for e in own) == back[conv].formatted_chars
        for e, k in zip(own, replies):
            assert e.text.count("</s>") == k + 1 and e.text[e.loss_end:] == "</s>" and own[-1].text.startswith(e.text)
    made.unpersist()


def test_escape_is_reversible_and_hides_control_strings(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t and not any(c in r.e for c in BITS[:4])


def test_empty_table(spark):
    made = chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert made.count() == 0 and chat.read_back(made).count() == 0
