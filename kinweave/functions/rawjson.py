"""JSON documents that are edited without loss: key order, number literals and unknown keys stay."""

from __future__ import annotations

import json
from json.encoder import encode_basestring as quoted


class Number(str):
    """A number as it was written."""


def parse(text: str):
    return json.loads(text, parse_float=Number, parse_int=Number, parse_constant=Number)


def dump(value) -> str:
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{quoted(k)}:{dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def pretty(value, indent: str = "") -> str:
    """As dump, two spaces a level."""
    deeper = indent + "  "
    if isinstance(value, dict) and value:
        return "{\n" + ",\n".join(f"{deeper}{quoted(k)}: {pretty(v, deeper)}" for k, v in value.items()) + f"\n{indent}}}"
    if isinstance(value, list) and value:
        return "[\n" + ",\n".join(deeper + pretty(v, deeper) for v in value) + f"\n{indent}]"
    return dump(value)
