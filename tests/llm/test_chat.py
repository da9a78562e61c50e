import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PIECE = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "<\\/s>", "[\\\\INST]", "é", " ", "\n", "x$1", "<\\s>"])
TEXT = st.lists(PIECE, max_size=6).map("".join)


def expected(rows, loss_role="assistant"):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        lines = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == loss_role)
        out[c] = (len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("clash")).withColumn("rounds", F.lit(1))
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digest(out).collect()}
    want = expected(rows)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    for r in out.collect():
        at, loss = 0, ""
        for s in r.mask:
            part = r.formatted[at : at + s.length]
            loss += part if s.loss else ""
            at += s.length
        assert at == len(r.formatted) == got[r.conv_id].formatted_chars
        assert r.rounds or len(loss) == want[r.conv_id][2]
    return got


def test_conflicts_and_odd_rows(spark):
    trap = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", trap), (-7, 1, "assistant", trap), (1, 1, "assistant", None), (1, 0, None, "hi"), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, None, "assistant", "é😀"), (None, 3, "tool[/INST]", "<s>"), (3, 0, "assistant", ""), (4, 0, "user", "a \\ b <\\s> c"), (5, 0, "user", "long " * 100000)]
    got = check(spark, rows)
    assert got[-7].rounds == got[4].rounds == got[None].rounds == 1 and got[1].rounds == got[5].rounds == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.digest(chat.format_conversations(empty)).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 2), st.one_of(st.just("assistant"), TEXT), TEXT), min_size=1, max_size=40))
def test_any_text_reads_back(spark, rows):
    check(spark, rows)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    check(spark, [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_main_path_runs_no_python(spark, sf_dir):
    df = chat.digest(chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("text", ["<s>[INST]user[/INST]hi", "x</s>", "<s>[INST]user</s>", "<s>[INST]a[/INST]b</s>tail"])
def test_bad_grammar_is_null(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(chat.parse(F.col("t"))).first()[0] is None


def test_the_loss_is_read_through_the_mask(spark):
    rows = [(1, 0, "user", "ab"), (1, 1, "assistant", "</s>x"), (1, 2, "assistant", "yz")]
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    assert out.select(chat.under_loss(F.col("formatted"), F.col("mask")).alias("t")).first().t == ["</s>x", "yz"]
    other = F.transform("mask", lambda s, i: F.struct(s["length"].alias("length"), (i == 1).alias("loss")))
    got = chat.digest(out.withColumn("mask", other)).first()
    assert (got.loss_chars, got.loss_sha256) == (2, hashlib.sha256(b"ab").hexdigest())
    wrong = F.transform("mask", lambda s, i: F.struct((s["length"] + F.when(i == 1, 1).when(i == 2, -1).otherwise(0)).alias("length"), s["loss"].alias("loss")))
    with pytest.raises(Exception, match="mask"):
        chat.digest(out.withColumn("mask", wrong)).collect()
