from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from penstock.llm import op2_chat_format as chat

MARKS = chat.marks(chat.TEMPLATE)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "</other>", None]), st.text("ab\\<>[/]s" ) | st.sampled_from(MARKS).map(lambda m: m + m[:-1] + "\\b")), max_size=5), min_size=1, max_size=25))
def test_round_trip(spark, chats):
    rows = [(c, t, role, text) for c, turns in enumerate(chats) for t, (role, text) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_chats(frame).select("conv_id", "segments", "formatted", chat.read_back(F.col("formatted")).alias("back")).collect()
    for r in done:
        want = [((role or ""), text) for role, text in chats[r.conv_id]]
        assert [(b.role, b.text) for b in r.back] == want
        assert "".join(s.text for s in r.segments) == r.formatted
        assert sum(s.loss for s in r.segments) == sum(role == "assistant" for role, _ in want)


def test_machine(spark):
    cases = {1: "system user assistant", 2: "user assistant user assistant", 3: "assistant user", 4: "user user assistant", 5: "user", 6: "user tool", 7: "system system"}
    rows = [(c, t, role, "x") for c, roles in cases.items() for t, role in enumerate(roles.split())]
    got = {r.conv_id: (r.valid, r.bad_turn) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, 1), 6: (False, 1), 7: (False, 1)}


def test_odd_rows(spark):
    rows = [(1, 2, "assistant", None), (1, None, "user", "first"), (1, 2, "assistant", None), (None, 0, None, "x"), (2, 0, "user", "y" * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).withColumn("turns", F.lit(1))
    got = {r.conv_id: [(b.role, b.text) for b in r.back] for r in chat.format_chats(frame).select("conv_id", chat.read_back(F.col("formatted")).alias("back")).collect()}
    assert got[1] == [("user", "first"), ("assistant", ""), ("assistant", "")]
    assert got[None] == [("", "x")] and len(got[2][0][1]) == 200_000


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
