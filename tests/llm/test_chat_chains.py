"""Chains of any length, and circles."""

import json

from quarry.llm import chat


def ordered(spark, edges):
    df = spark.createDataFrame(edges, "conv_id long, turn long, other long")
    return {(r.conv_id, r.turn): (r.at, r.depth, r.turn) for r in chat._ordered(df.select("conv_id", "turn").distinct(), df).collect()}


def test_a_long_chain_stored_backwards_is_ordered(spark):
    chain = 70
    got = ordered(spark, [(1, i, i + 1) for i in range(chain)])
    assert [k[2] for k in sorted(got.values())] == list(range(chain, -1, -1))


def test_circles_keep_their_turns_and_what_is_behind_follows(spark):
    circle = [(1, 5, 6), (1, 6, 7), (1, 7, 5)]
    behind = [(1, 2, 6), (1, 1, 2), (1, 3, 9), (1, 3, 5), (1, 8, 7)]
    got = ordered(spark, [*circle, *behind, (2, 0, 1)])
    assert [got[1, t] for t in (5, 6, 7)] == [(5, 0, 5), (6, 0, 6), (7, 0, 7)]
    assert got[1, 2] == (6, 1, 2) and got[1, 1] == (6, 2, 1) and got[1, 3] == (9, 1, 3) and got[1, 8] == (8, 0, 8) and got[2, 0] == (1, 1, 0)


def test_messages_of_a_long_chain(spark):
    rows = [(1, 0, "tool", json.dumps({"tool_call_id": "a", "content": "x"})), (1, 1, "assistant", '<tool_call>{"id": "a", "name": "f", "arguments": {}}</tool_call>')]
    got = {r.turn: (r.at, r.depth) for r in chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (1, 1), 1: (1, 0)}


def test_large_ids_beside_null_ones_stay(spark):
    big = 9007199254740993
    rows = [(big, 0, "user", "a"), (None, 1, "user", "b"), (big, None, None, None), (big + 1, big, "assistant", '<tool_call>{"id": "c", "name": "x"}</tool_call>'), (big + 1, big + 2, "tool", '{"tool_call_id": "c"}')]
    got = chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    want = sorted(((c, t) for c, t, _, _ in rows), key=repr)
    assert sorted(((r.conv_id, r.turn) for r in got), key=repr) == want
    assert sorted(((x["conv_id"], x["turn"]) for x in (json.loads(r.line) for r in got)), key=repr) == want
    assert {r.answered_by for r in got} == {None, big} and {r["at"] for r in got} == {0, 1, None, big, big + 2}
