"""From picked values of one document to a plan for all: the least general path that covers the picks.

Picks are concrete paths. One outside arrays means itself. Several fields of one array's items mean that field of every
item, or, if a field's value tells the picked items from the others, of the items with that value. The plan
runs as an operator over a DataFrame and reads as jq and JSONPath.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from tracewright.operators.infer import picked
from tracewright.plans.program import Op, parse_path


@dataclass
class Plan:
    """``status`` is safe, or ambiguous: one picked item may stand for all."""

    status: str
    ops: list[Op]
    jq: str
    jsonpath: str | None
    question: str | None = None


def dotted(parts: list[str | int]) -> str:
    """A path's text from its parts, without a leading dot."""
    out = "".join(f"[{p}]" if isinstance(p, int) else f".{p}" if p.isidentifier() and p.isascii() else f"[{json.dumps(p)}]" for p in parts)
    return out.removeprefix(".")


def _jq(parts: list[str | int]) -> str:
    return "." + dotted(parts)


def _json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)


def plan(document: dict, picks: list[str], every: bool | None = None) -> Plan:
    """A plan for picked paths of one document; ``every`` answers the question a single array item raises."""
    paths = [parse_path(p) for p in dict.fromkeys(picks)]
    if not paths:
        raise ValueError("nothing is picked")
    contexts = [_context(p) for p in paths]
    if len(paths) == 1 and (contexts[0] is None or every is False):
        return Plan("safe", [Op("set", "value", {"source": dotted(paths[0])})], _jq(paths[0]), "$" + _tail(paths[0]))
    first = contexts[0]
    if len(paths) == 1 and every is None:
        held = dotted(first[0])
        return Plan("ambiguous", [Op("set", "value", {"source": dotted(paths[0])})], _jq(paths[0]), "$" + _tail(paths[0]), f"only {dotted(paths[0])}, or {dotted(first[2]) or 'the item'} of every item of {held}?")
    if first and all(c and (c[0], c[2]) == (first[0], first[2]) for c in contexts):
        where = None if len(paths) == 1 else _telling(document, first[0], first[2], sorted(c[1] for c in contexts))
        return _of_array(first[0], first[2], where)
    ops = [Op("set", f"value{i + 1}", {"source": dotted(p)}) for i, p in enumerate(paths)]
    return Plan("safe", ops, "[" + ", ".join(map(_jq, paths)) + "]", None)


def _context(parts: list) -> tuple[list, int, list] | None:
    """The first array on a path, the picked index, and what follows."""
    at = next((i for i, p in enumerate(parts) if isinstance(p, int)), None)
    return None if at is None else (parts[:at], parts[at], parts[at + 1 :])


def _tail(parts: list) -> str:
    return "".join(f"[{p}]" if isinstance(p, int) else f".{p}" if p.isidentifier() and p.isascii() else f"[{json.dumps(p)}]" for p in parts)


def _telling(document: dict, array: list, extract: list, chosen: list[int]) -> dict | None:
    """A field that has one value on all picked items and on no other."""
    items = picked(document, dotted(array))
    if not isinstance(items, list) or len(chosen) < 2 or len(chosen) >= len(items):
        return None
    for field in _scalars(next((x for x in items if isinstance(x, dict)), {})):
        if field == extract:
            continue
        values = [_get(x, field) for x in items]
        value = values[chosen[0]]
        if isinstance(value, (str, int, bool)) and [i for i, v in enumerate(values) if v == value and type(v) is type(value)] == chosen:
            return {"path": dotted(field), "equals": value}
    return None


def _scalars(item: dict, base: tuple = ()) -> list[list]:
    out = []
    for k, v in item.items():
        out += _scalars(v, (*base, k)) if isinstance(v, dict) else [[*base, k]] if not isinstance(v, list) else []
    return out


def _get(item, parts: list):
    for p in parts:
        item = item.get(p) if isinstance(item, dict) else None
    return item


def _of_array(array: list, extract: list, where: dict | None) -> Plan:
    params = {"source": dotted(array), **({"extract": dotted(extract)} if extract else {}), **({"where": where} if where else {})}
    select = f" | select(.{where['path']} == {_json(where['equals'])})" if where else ""
    step = f" | {_jq(extract)}" if extract else ""
    inside = f"[?(@.{where['path']}=={_json(where['equals'])})]" if where else "[*]"
    return Plan("safe", [Op("arrayMap", "value", params)], f"[{_jq(array)}[]{select}{step}]", "$" + _tail(array) + inside + _tail(extract))
