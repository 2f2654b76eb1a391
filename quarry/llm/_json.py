"""Strict JSON with a bounded depth, its canonical form, and schemas."""

from __future__ import annotations

import json
import math
import re

#: Deepest nesting of arrays and objects that is read.
DEPTH = 128

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', re.S)
_SURROGATE = re.compile("[\ud800-\udfff]")


class TooDeep(ValueError):
    pass


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON value")


def _finite(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _refuse(text)


def end_of(text: str, at: int) -> tuple[int, int] | None:
    """(end, depth) of the array or object that begins at a place: brackets within strings don't count.
    None where none begins or ends."""
    depth = deepest = 0
    if text[at : at + 1] not in ("{", "["):
        return None
    for token in _TOKEN.finditer(text, at):
        kind = token[0][0]
        if kind in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif kind != '"':
            depth -= 1
            if not depth:
                return token.end(), deepest
    return None


def read(text: str) -> object:
    """The value of a JSON text. Raises ValueError for what is none, constants as NaN and numbers that a float
    can't hold included, and TooDeep beyond DEPTH."""
    depth = 0
    for token in _TOKEN.finditer(text):
        kind = token[0][0]
        depth += (kind in "[{") - (kind in "]}")
        if depth > DEPTH:
            raise TooDeep(f"nested deeper than {DEPTH}")
    return json.loads(text, parse_constant=_refuse, parse_float=_finite)


def encodable(text: str) -> str:
    """The text with each lone surrogate, which UTF-8 lacks, as its JSON escape."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    """Sorted keys, no spaces, characters as they are; lone surrogates stay escaped."""
    return encodable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None), "integer": int, "number": (int, float)}
#: Keywords that say nothing about which values are valid.
_NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "format", "deprecated", "readOnly", "writeOnly"}
_WORDS = {
    "type", "enum", "const", "required", "properties", "additionalProperties", "minProperties", "maxProperties", "items", "minItems", "maxItems", "uniqueItems",
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "pattern", "minLength", "maxLength", "anyOf", "oneOf", "allOf", "not",
}


def understood(schema: object) -> None:
    """Raises ValueError for a schema with a keyword, type or pattern that isn't understood."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"no schema: {schema!r}")
    if unknown := sorted(set(schema) - _WORDS - _NOTES):
        raise ValueError(f"schema keywords that are not understood: {unknown}")
    kinds = schema.get("type", [])
    if unknown := sorted({*([kinds] if isinstance(kinds, str) else kinds)} - set(_TYPES)):
        raise ValueError(f"types that are not understood: {unknown}")
    re.compile(schema.get("pattern", ""))
    below = [*schema.get("properties", {}).values(), *(x for k in ("anyOf", "oneOf", "allOf") for x in schema.get(k, [])), *(schema[k] for k in ("items", "additionalProperties", "not") if k in schema)]
    for part in below:
        understood(part)


def _number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _is(value: object, kind: str) -> bool:
    if kind == "integer":
        return _number(value) and value == int(value)
    return _number(value) if kind == "number" else isinstance(value, _TYPES[kind])


def _alike(a: object, b: object) -> bool:
    """Equality of JSON values: 1 is 1.0, but not true."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_alike(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_alike, a, b))
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def violations(value: object, schema: object, at: str = "$") -> list[str]:
    """What of a value breaks a schema, in the order of the rules below; keys in sorted order."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    kind = schema.get("type")
    kinds = kind if isinstance(kind, list) else [kind] if kind else []
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not of type {'|'.join(kinds)}"]
    out = []
    if "enum" in schema and not any(_alike(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and not _alike(value, schema["const"]):
        out.append(f"{at}: not the constant")
    for word, wrong in (("anyOf", lambda n, m: n == 0), ("oneOf", lambda n, m: n != 1), ("allOf", lambda n, m: n != m)):
        if word in schema and wrong(sum(not violations(value, x, at) for x in schema[word]), len(schema[word])):
            out.append(f"{at}: breaks {word}")
    if "not" in schema and not violations(value, schema["not"], at):
        out.append(f"{at}: breaks not")
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif more is False:
                out.append(f"{at}.{k}: unknown")
            else:
                out += violations(value[k], more, f"{at}.{k}")
        out += [f"{at}: too few properties"] if len(value) < schema.get("minProperties", 0) else []
        out += [f"{at}: too many properties"] if len(value) > schema.get("maxProperties", len(value)) else []
    if isinstance(value, list):
        for i, x in enumerate(value if "items" in schema else []):
            out += violations(x, schema["items"], f"{at}[{i}]")
        out += [f"{at}: too few items"] if len(value) < schema.get("minItems", 0) else []
        out += [f"{at}: too many items"] if len(value) > schema.get("maxItems", len(value)) else []
        if schema.get("uniqueItems") and any(_alike(x, y) for i, x in enumerate(value) for y in value[:i]):
            out.append(f"{at}: repeated items")
    if _number(value):
        out += [f"{at}: below minimum"] if value < schema.get("minimum", value) or value <= schema.get("exclusiveMinimum", value - 1) else []
        out += [f"{at}: above maximum"] if value > schema.get("maximum", value) or value >= schema.get("exclusiveMaximum", value + 1) else []
        out += [f"{at}: no multiple"] if "multipleOf" in schema and value % schema["multipleOf"] else []
    if isinstance(value, str):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get("maxLength", len(value)) else []
        out += [f"{at}: no match of pattern"] if "pattern" in schema and not re.search(schema["pattern"], value) else []
    return out
