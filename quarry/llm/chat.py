"""Chat formatting: tool calls linked with their results.

Messages carry calls and results in their text: a call is <tool_call>{"id", "name", "arguments"}
</tool_call> in an assistant's message, a result a message of role tool whose text is a JSON object
with "tool_call_id" and "content". Calls and results meet in a hash join by conversation and id, are
ordered so that each follows what it needs, arguments are checked against schemas, and every message
becomes one line of canonical JSON (sorted keys, no spaces).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._json import TooDeep, canonical, encodable, end_of, read, understood, violations
from quarry.session import checkpointed

OPEN, CLOSE = "<tool_call>", "</tool_call>"
SPACE = re.compile(r"\s*")

_CALL = "struct<id:string,name:string,arguments:string,needs:array<string>,errors:array<string>>"
_PARSED = f"conv_id long, turn long, role string, content string, calls array<{_CALL}>, answers string"


def _needs(value: object) -> list[str]:
    """The ids of results that arguments refer to: {"$ref": id} at any depth."""
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return [value["$ref"]]
        return [x for k in sorted(value) for x in _needs(value[k])]
    return [x for v in value for x in _needs(v)] if isinstance(value, list) else []


def _string(value: object) -> str | None:
    return encodable(value) if isinstance(value, str) else None


def _call(raw: str, schemas: dict[str, dict]) -> dict:
    try:
        found, wrong = read(raw), "not a JSON object"
    except TooDeep as deep:
        found, wrong = None, str(deep)
    except ValueError:
        found, wrong = None, "not a JSON object"
    if not isinstance(found, dict):
        return {"id": None, "name": None, "arguments": canonical(raw), "needs": [], "errors": [wrong]}
    name, given = found.get("name"), found.get("arguments", {})
    errors = [] if isinstance(found.get("id"), str) else ["no id"]
    if isinstance(given, str):
        try:
            given = read(given)
        except TooDeep as deep:
            errors.append(f"arguments: {deep}")
        except ValueError:
            pass
    if not isinstance(name, str) or name not in schemas:
        errors.append("unknown tool")
    else:
        errors += violations(given, schemas[name])
    return {"id": _string(found.get("id")), "name": _string(name), "arguments": canonical(given), "needs": [encodable(x) for x in _needs(given)], "errors": [encodable(x) for x in errors]}


def _calls(body: str) -> tuple[str, list[str]]:
    """The text outside of calls, and what each call holds. A call ends at the closing tag behind its JSON object; a tag
    within a string of it is part of the string. What is no object ends at the next closing tag;
    a call that isn't closed is text."""
    rest, held, at = [], [], 0
    while (opened := body.find(OPEN, at)) >= 0:
        start = opened + len(OPEN)
        found = end_of(body, SPACE.match(body, start).end())
        closed = SPACE.match(body, found[0]).end() if found else -1
        if not found or not body.startswith(CLOSE, closed):
            closed = body.find(CLOSE, start)
        if closed < 0:
            break
        rest.append(body[at:opened])
        held.append(body[start:closed].strip())
        at = closed + len(CLOSE)
    return "".join([*rest, body[at:]]).strip(), held


def parsed(messages: DataFrame, schemas: dict[str, dict], conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, content, calls, answers): answers is the id that a result answers.

    A call that is no strict JSON object, NaN and numbers that no float holds included, or that nests deeper
    than DEPTH, has no id, its text as arguments and an error that says so; a result of that kind
    is text. Lone surrogates, which UTF-8 can't hold, stay as escapes. Raises ValueError for a schema
    with a keyword that isn't understood."""
    for schema in schemas.values():
        understood(schema)

    def told(kind: str | None, body: str | None) -> tuple[str, list, str | None]:
        body = body or ""
        if kind == "assistant" and OPEN in body:
            content, held = _calls(body)
            return content, [_call(x, schemas) for x in held], None
        if kind == "tool":
            try:
                found = read(body)
            except ValueError:
                found = None
            if isinstance(found, dict) and isinstance(found.get("tool_call_id"), str):
                content = found.get("content", "")
                return encodable(content) if isinstance(content, str) else canonical(content), [], encodable(found["tool_call_id"])
        return body, [], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        call = pa.struct([("id", text), ("name", text), ("arguments", text), ("needs", pa.list_(text)), ("errors", pa.list_(text))])
        for batch in batches:
            made = [told(k, x) for k, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            added = [pa.array([x[i] for x in made], kind) for i, kind in enumerate((text, pa.list_(call), text))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *added], names=["conv_id", "turn", "role", "content", "calls", "answers"])

    rows = messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _PARSED)


def linked(messages: DataFrame, schemas: dict[str, dict] | None = None, **columns: str) -> DataFrame:
    """One row for each message: (conv_id, turn, role, at, depth, n_calls, n_answered, n_invalid,
    n_needs_unmet, answered_by, line).

    (at, depth, turn) orders a conversation topologically: a message stands at its own turn, or later,
    right behind the last of what it needs (a result its call, a call the results that its arguments
    refer to); messages that wait for one another in a circle keep their own turns. Chains may have any
    length; each link that moves is a round. A call's first
    result by turn is the one that counts, and an id's first call; results of no call are orphans
    (answered_by is null). A conversation is never gathered in one task: links are joins by
    conversation and id, and lines are made message by message. Null texts and roles count as empty
    content and no role; null conversations link with nothing."""
    rows = checkpointed(parsed(messages, schemas or {}, **columns))
    calls = rows.select("conv_id", "turn", F.explode("calls").alias("c")).where("c.id is not null")
    first_call = calls.groupBy("conv_id", F.col("c.id").alias("id")).agg(F.min("turn").alias("call_turn"))
    results = rows.where("answers is not null").groupBy("conv_id", F.col("answers").alias("id")).agg(F.min("turn").alias("result_turn"))
    met = first_call.join(results, ["conv_id", "id"], "left")
    # what a message needs: (conv_id, turn) -> turn of the other
    of_result = rows.where("answers is not null").select("conv_id", "turn", F.col("answers").alias("id")).join(first_call, ["conv_id", "id"])
    needs = calls.select("conv_id", "turn", F.explode("c.needs").alias("id")).join(results, ["conv_id", "id"])
    edges = of_result.select("conv_id", "turn", F.col("call_turn").alias("other")).union(needs.select("conv_id", "turn", F.col("result_turn").alias("other"))).where("turn <> other").distinct()
    ordered = _ordered(rows.select("conv_id", "turn").distinct(), checkpointed(edges))
    answered = met.where("result_turn is not null").groupBy("conv_id", F.col("call_turn").alias("turn")).agg(F.count("*").alias("n_answered"))
    wanted = calls.select("conv_id", "turn", F.explode("c.needs").alias("id"))
    unmet = wanted.join(results, ["conv_id", "id"], "left_anti").groupBy("conv_id", "turn").agg(F.count("*").alias("n_needs_unmet"))
    by = first_call.select("conv_id", F.col("id").alias("answers"), F.col("call_turn").alias("answered_by"))
    out = rows.join(ordered, ["conv_id", "turn"], "left").join(answered, ["conv_id", "turn"], "left").join(unmet, ["conv_id", "turn"], "left").join(by, ["conv_id", "answers"], "left")
    lined = out.select(
        "conv_id", "turn", "role", F.coalesce("at", "turn").alias("at"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.size("calls").cast("long").alias("n_calls"), F.coalesce("n_answered", F.lit(0)).alias("n_answered"),
        F.size(F.filter("calls", lambda c: F.size(c["errors"]) > 0)).cast("long").alias("n_invalid"),
        F.coalesce("n_needs_unmet", F.lit(0)).alias("n_needs_unmet"), "answered_by", "content", "calls", "answers",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for conv_id, turn, role, content, calls, answers in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "content", "calls", "answers")), strict=True):
                line = {"content": content, "conv_id": conv_id, "role": role, "turn": turn}
                line["tool_calls"] = [{"arguments": json.loads(c["arguments"]), "errors": c["errors"], "id": c["id"], "name": c["name"]} for c in calls]
                if answers is not None:
                    line["tool_call_id"] = answers
                lines.append(canonical(line))
            kept = batch.drop_columns(["content", "calls", "answers"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lines, pa.string())], names=[*kept.schema.names, "line"])

    return lined.mapInArrow(run, "conv_id long, turn long, role string, at long, depth int, n_calls long, n_answered long, n_invalid long, n_needs_unmet long, answered_by long, line string")


def _ordered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, turn, at, depth) of the messages that need others. Keys grow along the edges until
    none does any more, however long a chain is. A message is settled once all that it needs are; when
    no more settle while keys still grow, the rest are on circles or behind them. Messages on circles,
    and between two, then keep their own turns, and those behind follow them."""
    if edges.where("other > turn").isEmpty():
        return edges.select("conv_id", "turn", F.col("turn").alias("at"), F.lit(0).alias("depth")).distinct()
    grown, open_ = _grown(edges)
    if open_ is None:
        return grown
    return _grown(edges.join(_circles(edges, open_), ["conv_id", "turn"], "left_anti"), edges)[0]


def _grown(edges: DataFrame, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(conv_id, turn, at, depth) of the ends of edges, and None; or where circles are, what of it is not
    settled as (conv_id, turn). ends are the edges whose ends get keys, if not the same."""
    ends = edges if ends is None else ends
    edges = checkpointed(edges)
    keys = ends.select("conv_id", "turn").union(ends.select("conv_id", F.col("other").alias("turn"))).distinct()
    own = F.struct(F.col("turn").alias("at"), F.lit(0).alias("depth"))
    keys = checkpointed(keys.select("conv_id", "turn", own.alias("k"), F.lit(False).alias("settled")))
    settled = 0
    while True:
        need = keys.select("conv_id", F.col("turn").alias("other"), F.struct("k.at", (F.col("k.depth") + 1).alias("depth")).alias("k"), "settled")
        least = edges.join(need, ["conv_id", "other"]).groupBy("conv_id", "turn").agg(F.max("k").alias("most"), F.min("settled").alias("told"))
        keys = checkpointed(
            keys.join(least, ["conv_id", "turn"], "left").select(
                "conv_id", "turn", F.greatest(own, F.coalesce("most", own)).alias("k"), F.col("k").alias("was"), F.coalesce("told", F.lit(True)).alias("settled")
            )
        )
        now = keys.agg(F.count_if("settled").alias("settled"), F.count_if(F.col("k") != F.col("was")).alias("moving")).first()
        if not now.moving:
            return keys.select("conv_id", "turn", "k.*"), None
        if now.settled == settled:
            return keys, keys.where("not settled").select("conv_id", "turn")
        settled = now.settled


def _circles(edges: DataFrame, among: DataFrame) -> DataFrame:
    """(conv_id, turn) of the messages on circles, or between two, of those that are not settled: what
    stays when those that none of the rest needs are taken away until there are none."""
    rest, n = checkpointed(among), -1
    while (left := rest.count()) != n:
        n = left
        needed = edges.join(rest, ["conv_id", "turn"], "left_semi").select("conv_id", F.col("other").alias("turn")).distinct()
        rest = checkpointed(rest.join(needed, ["conv_id", "turn"], "left_semi"))
    return rest
