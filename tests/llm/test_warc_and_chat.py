import hashlib
import json
import re
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from quarry.llm import _json, chat, warc
from tests.llm import helpers

BIG = "<p>" + "same words here " * 20 + "</p>"
PAGES = [
    (3, "http://h/3", BIG), (1, "http://h/1", BIG), (2, "http://h/2", "short"), (4, "http://h/4", "short"), (5, None, None), (6, "http://h/\r\n6", ""),
    (7, "u", "é" * 60), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 9 + "\x00\U0001f600"), (None, "n", BIG), (9, "v", "x" * 3_000_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)


def test_round_trip(spark):
    got = {r.page_id: r for r in warc.round_trip(pages(spark)).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        raw = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 1) if html == BIG and i != 1 else ("response", None))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
    assert got[6].url == "http://h/  6" and got[5].url is None


def test_empty_table(spark):
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_archives_are_of_the_format(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html>{'common boilerplate text ' * 10}{i * 7919}</html>") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = str(tmp_path / "out")
    words = warc.train(warc.sample(df, 300))
    assert words
    warc.write_archives(warc.with_revisits(df).coalesce(1), folder, words)
    data = next((tmp_path / "out").glob("part-*")).read_bytes()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and data[8 : 8 + size] == words
    # each record is a frame of its own, read with the dictionary alone
    frames = list(warc.frames(data))
    assert len(frames) == 300
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)).decompress(frames[17][1])
    assert warc.parse(one)["warc-type"] == "response"
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    plain = sum(len(zstandard.compress(reader.decompress(f), 3)) for _, f in frames)
    assert sum(len(f) for _, f in frames) < plain
    # any reader of the format takes the file as one stream
    whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)).stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 300


def test_broken_archives_raise():
    with pytest.raises(ValueError, match="no frame"):
        list(warc.frames(b"nonsense"))
    with pytest.raises(ValueError, match="WARC"):
        warc.parse(b"HTTP/1.1\r\n\r\n")


SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["string", "null"]}}, "additionalProperties": False}}


def call(i, name="add", **arguments):
    return f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': arguments})}</tool_call>"


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def lines(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("line", F.lit("clash"))
    return {(r.conv_id, r.turn): r for r in chat.linked(df, SCHEMAS).collect()}


def test_calls_and_results_meet(spark):
    got = lines(
        spark,
        [
            (1, 0, "user", "add"), (1, 1, "assistant", "sure " + call("x", a=1) + call("y", a=-1, c=2)), (1, 2, "tool", result("x")), (1, 3, "tool", result("y", {"v": 2})),
            (1, 4, "tool", result("gone")), (1, 5, "assistant", call("z", "other")), (2, 0, "tool", result("x")), (2, 1, "assistant", call("x", a={"$ref": "nowhere"})),
        ],
    )
    a = got[1, 1]
    assert (a.n_calls, a.n_answered, a.n_invalid) == (2, 2, 1) and got[1, 2].answered_by == 1 and got[1, 4].answered_by is None and got[1, 5].n_invalid == 1
    assert json.loads(a.line)["tool_calls"][1]["errors"] == ["$.a: below minimum", "$.c: unknown"] or json.loads(a.line)["tool_calls"][1]["errors"] == ["$.c: unknown", "$.a: below minimum"]
    assert a.line == json.dumps(json.loads(a.line), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[1, 3].line)["content"] == '{"v":2}' and json.loads(a.line)["content"] == "sure"
    # the result that came before its call stands behind it
    assert (got[2, 0].at, got[2, 0].depth) == (1, 1) and got[2, 1].n_needs_unmet == 1


def test_order_is_topological(spark):
    rows = [
        (1, 0, "tool", result("a")), (1, 1, "tool", result("b")), (1, 2, "assistant", call("b", a={"$ref": "a"})), (1, 3, "assistant", call("a", a=1)),
        (2, 0, "assistant", call("p", a={"$ref": "q"})), (2, 1, "tool", result("p")), (2, 2, "assistant", call("q", a={"$ref": "p"})), (2, 3, "tool", result("q")),
        (3, 0, "user", None), (3, 1, None, "x"), (None, 0, "tool", "{bad"), (3, 2, "assistant", "<tool_call>{bad</tool_call>"),
    ]
    got = lines(spark, rows)
    key = lambda c, t: (got[c, t].at, got[c, t].depth, t)
    assert key(1, 3) < key(1, 0) < key(1, 2) < key(1, 1)
    assert len(got) == len(rows) and json.loads(got[3, 0].line)["content"] == "" and got[3, 2].n_invalid == 1


def test_schemas():
    check = lambda v, s: _json.violations(v, s)
    assert check(True, {"type": "integer"}) and not check(1, {"type": "number"}) and check("x", {"enum": ["y"]}) == ["$: not in enum"]
    assert check({"l": [1, "a"]}, {"properties": {"l": {"items": {"type": "integer"}}}}) == ["$.l[1]: not of type integer"]
    assert check("ab", {"pattern": "^b"}) == ["$: no match of pattern"] and check(3, {"maximum": 2}) == ["$: above maximum"]


def test_more_schema_words():
    for value, schema, wrong in [
        ("ab", {"minLength": 3}, "too short"), ("ab", {"maxLength": 1}, "too long"), (1, {"const": True}, "not the constant"), (1.0, {"const": 1}, None), (1, {"enum": [True]}, "not in enum"),
        (5, {"anyOf": [{"type": "string"}, {"maximum": 3}]}, "breaks anyOf"), (5, {"oneOf": [{"minimum": 1}, {"minimum": 2}]}, "breaks oneOf"), (5, {"allOf": [{"minimum": 1}, {"minimum": 9}]}, "breaks allOf"),
        (5, {"not": {"type": "integer"}}, "breaks not"), ([1, 1.0], {"uniqueItems": True}, "repeated items"), ([1, True], {"uniqueItems": True}, None), ([], {"minItems": 1}, "too few items"), ([1], {"maxItems": 0}, "too many items"),
        (2, {"exclusiveMinimum": 2}, "below minimum"), (2, {"exclusiveMaximum": 2}, "above maximum"), (5, {"multipleOf": 2}, "no multiple"), (2.0, {"type": "integer"}, None), (2.5, {"type": "integer"}, "not of type integer"),
        ({}, {"minProperties": 1}, "too few properties"), ({"a": 1}, {"maxProperties": 0}, "too many properties"), (1, False, "not allowed"), (1, {"title": "x", "description": "y"}, None),
    ]:
        _json.understood(schema)
        assert _json.violations(value, schema) == ([f"$: {wrong}"] if wrong else [])
    assert _json.violations({"a": "x"}, {"additionalProperties": {"type": "integer"}}) == ["$.a: not of type integer"]
    for schema in ({"minimun": 1}, {"properties": {"a": {"if": {}}}}, {"type": "str"}, {"items": 3}, {"pattern": "("}):
        with pytest.raises((ValueError, re.error)):
            _json.understood(schema)


def test_calls_that_json_cannot_hold_are_told_and_kill_nothing(spark):
    deep, odd = "[" * 2000 + "]" * 2000, "\\ud800"
    within = '<tool_call>{"id": "t", "name": "add", "arguments": {"a": 1, "b": "</tool_call> {"}} </tool_call>'
    rows = [
        (1, 0, "assistant", f'<tool_call>{{"id": "x{odd}", "name": "add", "arguments": {{"b": "{odd}", "a": 1}}}}</tool_call>'), (1, 1, "tool", f'{{"tool_call_id": "x{odd}", "content": "{odd}"}}'),
        (2, 0, "assistant", f'<tool_call>{{"id": "d", "name": "add", "arguments": {deep}}}</tool_call>'), (2, 1, "tool", f'{{"tool_call_id": "d", "content": {deep}}}'),
        (3, 0, "assistant", '<tool_call>{"id": "n", "name": "add", "arguments": {"a": NaN}}</tool_call>'), (3, 1, "assistant", '<tool_call>{"id": "n", "arguments": {"a": 1e999}}</tool_call>'),
        (4, 0, "assistant", f"before {within} after"), (4, 1, "assistant", "open <tool_call>{"), (4, 2, "assistant", f'<tool_call>{{"id": "s", "name": "add", "arguments": {json.dumps(deep)}}}</tool_call>'),
        (5, 0, "assistant", "<tool_call>[</tool_call> and <tool_call>{} x</tool_call>"), (6, 0, "assistant", f'<tool_call>{{"id": "{odd}", "name": "{odd}"}}</tool_call>'),
    ]
    got = lines(spark, rows)
    told = {k: json.loads(r.line) for k, r in got.items()}
    assert len(got) == len(rows) and all(_json.read(r.line) for r in got.values())
    assert told[1, 0]["tool_calls"] == [{"arguments": {"a": 1, "b": "\ud800"}, "errors": [], "id": "x\\ud800", "name": "add"}]
    assert (got[1, 0].n_answered, got[1, 1].answered_by, told[1, 1]["content"]) == (1, 0, "\\ud800")
    assert told[2, 0]["tool_calls"][0]["errors"] == ["nested deeper than 128"] and told[2, 0]["tool_calls"][0]["id"] is None and told[2, 1]["content"] == rows[3][3]
    assert [told[3, t]["tool_calls"][0]["errors"] for t in (0, 1)] == [["not a JSON object"]] * 2
    assert told[4, 0]["content"] == "before  after" and told[4, 0]["tool_calls"][0]["arguments"] == {"a": 1, "b": "</tool_call> {"} and not told[4, 0]["tool_calls"][0]["errors"]
    assert (told[4, 1]["content"], told[4, 1]["tool_calls"]) == ("open <tool_call>{", []) and told[4, 2]["tool_calls"][0]["errors"][0] == "arguments: nested deeper than 128"
    assert [c["errors"] for c in told[5, 0]["tool_calls"]] == [["not a JSON object"]] * 2 and told[5, 0]["content"] == "and"
    assert told[6, 0]["tool_calls"][0]["errors"] == ["unknown tool"] and told[6, 0]["tool_calls"][0]["name"] == "\\ud800"


def test_depth_is_that_of_brackets_outside_of_strings():
    assert _json.read("[" * 128 + "]" * 128) and _json.read('{"a": "[[["}') == {"a": "[[["}
    with pytest.raises(_json.TooDeep):
        _json.read("[" * 129 + "]" * 129)
    assert _json.end_of('x{"}": [1]} y', 1) == (11, 2) and _json.end_of("{[", 0) is None and _json.end_of("x", 0) is None


def test_odd_messages(spark):
    rows = [(i, 0, l, t) for i, t, l, _ in helpers.ODD]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.linked(df).collect()
    wanted = sorted(_json.canonical({"content": t or "", "conv_id": i, "role": l, "tool_calls": [], "turn": 0}) for i, _, l, t in rows)
    assert sorted(r.line for r in got) == wanted
    assert {(r.at, r.depth, r.n_calls, r.n_answered, r.n_invalid, r.n_needs_unmet, r.answered_by) for r in got} == {(0, 0, 0, 0, 0, 0, None)}
    assert chat.linked(df.limit(0)).count() == 0
