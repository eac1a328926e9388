"""Formatted conversations are read back to what they were."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat_format, queries
from tests.oracle import compared

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["\\", "\\\\", "<turn>", "</turn>", "<part>", "\n", "\n</turn>\n", "\n<part>\n", "<", "é", "a b", "### Assistant:", "<turn>assistant\n", "$1", "%0A", ""]


def chats(n, most, seed=3):
    random.seed(seed)
    rows = []
    for conv in range(n):
        for turn in range(random.randint(1, most)):
            text = "".join(random.choice(BITS) for _ in range(random.randint(0, 6)))
            rows.append((conv, turn, random.choice(("user", "assistant", "assistant", "sys%0A\ntem")), text))
    random.shuffle(rows)
    return rows


def told(rows):
    """conv_id -> (role, text) in order."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def read(df):
    got = df.select("conv_id", "formatted", chat_format.turns(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r.conv_id: ([tuple(t) for t in r.t], r.loss, r.formatted) for r in got.collect()}


@pytest.mark.parametrize("turns", [1024, 3])
def test_round_trip(spark, turns):
    rows = chats(40, 14)
    got = read(chat_format.formatted(spark.createDataFrame(rows, SCHEMA).repartition(4), turns=turns))
    want = told(rows)
    assert got.keys() == want.keys()
    for conv, own in want.items():
        said, loss, text = got[conv]
        assert said == own
        assert loss == "".join(t for r, t in own if r == "assistant")
        runs = 1 + sum(a[0] != b[0] for a, b in zip(own, own[1:]))
        assert text.count("\n</turn>\n") == runs  # adjacent turns of a role are one block
        unguarded = text.replace("\\\\", ".").replace("\\<", ".")
        assert unguarded.count("<turn>") == unguarded.count("</turn>") == runs


def test_long_conversations_give_the_same_text(spark):
    random.seed(8)
    rows = [(1, t, random.choice(("user", "assistant")), f"text {t} \\ <part>") for t in range(3000)] + chats(5, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r.conv_id: r for r in chat_format.formatted(df, turns=10_000).collect()}
    parts = {r.conv_id: r for r in chat_format.formatted(df, turns=64).collect()}
    assert whole == parts


def test_spans_are_of_the_escaped_texts(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<part>b"), (1, 2, "assistant", "\\"), (1, 3, "user", "")]
    r = chat_format.formatted(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.formatted == "<turn>user\nhi\n</turn>\n<turn>assistant\na\\<part>b\n<part>\n\\\\\n</turn>\n<turn>user\n\n</turn>\n"
    assert [[tuple(s) for s in block] for block in r.loss_spans] == [[], [(16, 9), (33, 2)], []]


def test_odd_tables(spark):
    rows = [
        (None, 1, "user", "no conversation"), (None, None, None, None), (2, None, "assistant", None), (2, 0, "assistant", "x" * 3_000_000),
        (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 1, "assistant", "tie"), (4, 0, "user", "never answered"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("blocks", F.lit(1)).withColumn("long_id", F.lit("x")).withColumn("formatted", F.lit("y")).withColumn("t", F.lit(0))
    for turns in (1024, 1):
        got = read(chat_format.formatted(df, turns=turns))
        assert {k: v[0] for k, v in got.items()} == told(rows)
        assert got[4][1] == ""
    assert chat_format.formatted(df.limit(0)).count() == 0
    assert chat_format.digests(chat_format.formatted(df.limit(0))).count() == 0


def test_digests(spark):
    rows = chats(10, 5, seed=4)
    want = told(rows)
    for r in chat_format.digests(chat_format.formatted(spark.createDataFrame(rows, SCHEMA))).collect():
        own = want[r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()


def test_query(spark):
    assert compared(spark, queries.op12_chat_format, queries.OP12_SQL) > 1
    added = queries.op12_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    assert added.n_turns == 2 and added.loss_sha256 == hashlib.sha256(rb"\### Assistant: </turn> ok").hexdigest()


def test_no_python_in_the_plan(spark):
    plan = queries.op12_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
