"""Suggestions of text, choice and array operators, read from a few evidence rows.

Array operators are found bottom-up: filters of an array are applied to the evidence once each, and
what they leave is tried as count, sum, pick, join, find, list, projection or group. A step that
bears out fewer than ``HOPE`` of the rows is not pursued. Whether a suggestion holds is decided by
counting it over all rows in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import combinations
from urllib.parse import unquote

from tracewright.plans.program import Op

#: Share of the evidence that a step must bear out.
HOPE = 0.6
#: Distinct values of an item's field up to which it may be a filter's; sources of a template.
MOST_VALUES, MOST_PARTS = 12, 4
#: Separators of joined and split texts.
JOINS = (", ", ",", " ", "-", "_", "|", "/", ";", ".")
_QUANTITY = re.compile(r"^\s*([+-]?\d+(?:\.\d+)?)\s*([A-Za-z%]*)\s*$")

Rows = list[dict]


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _holds(pairs) -> bool:
    """Whether most of the (got, wanted) pairs are equal, numbers by value."""
    pairs = list(pairs)
    same = sum(abs(a - b) < 1e-9 * max(1, abs(a)) if _number(a) and _number(b) else type(a) is type(b) and a == b for a, b in pairs)
    return bool(pairs) and same >= HOPE * len(pairs)


def suggestions(rows: Rows, inputs: list[str], target: str) -> list[Op]:
    """Operators for rows with input fields and ``_out`` (not null)."""
    out: list[Op] = []
    add = lambda kind, **p: out.append(Op(kind, target, p))
    texts = [s for s in inputs if any(isinstance(r[s], str) for r in rows)]
    arrays = [s for s in inputs if any(isinstance(r[s], list) for r in rows)]
    if any(isinstance(r["_out"], str) for r in rows):
        _texts(rows, texts, add)
        _templates(rows, inputs, add)
    _choices(rows, inputs, add)
    for s in texts:
        if any(isinstance(r["_out"], list) for r in rows):
            _split(rows, s, add)
    for s in arrays:
        _arrays(rows, s, add)
    return out


def _texts(rows: Rows, texts: list[str], add: Callable) -> None:
    for s in texts:
        both = [(r[s], r["_out"]) for r in rows if isinstance(r[s], str) and isinstance(r["_out"], str)]
        scaled = {}
        for x, y in both:
            a, b = _QUANTITY.match(x), _QUANTITY.match(y)
            if a and b and a[2] and float(a[1]):
                key = (round(float(b[1]) / float(a[1]), 9), b[2])
                scaled[key] = scaled.get(key, 0) + 1
        for (factor, unit), n in scaled.items():
            if n >= HOPE * len(both):
                add("quantityTransform", source=s, factor=factor, unit=unit)
        countries: dict[str, int] = {}
        for x, y in both:
            digits = re.sub(r"\D", "", x)
            if y.startswith("+") and y[1:].isdigit() and len(digits) >= 6:
                local = digits.lstrip("0")
                code = y[1 : len(y) - len(local)] if y.endswith(local) and not x.strip().startswith(("+", "00")) else ""
                countries[code] = countries.get(code, 0) + 1
        for code in countries:
            if len(code) <= 3:
                add("stringNormalize", source=s, mode="phone", **({"country": code} if code else {}))
        if any("%" in x or "+" in x for x, _ in both) and _holds((unquote(x.replace("+", " ")), y) for x, y in both):
            add("stringNormalize", source=s, mode="s3KeyDecode")


#: Cases of a template's part.
_CASES = {None: lambda t: t, "upper": str.upper, "lower": str.lower, "title": str.title}


def _templates(rows: Rows, inputs: list[str], add: Callable) -> None:
    """Literal texts between sources: each row's output is cut, from the left, at the longest source text."""
    for r in rows:
        y = r["_out"]
        if not isinstance(y, str):
            continue
        shown = [(case, s, f(str(r[s]))) for s in inputs if isinstance(r[s], (str, int)) and not isinstance(r[s], bool) and str(r[s]) for case, f in _CASES.items() if case is None or isinstance(r[s], str) and f(r[s]) != r[s]]
        parts, literal, at = [], "", 0
        while at < len(y):
            here = [(len(t), case is None, s, case) for case, s, t in shown if y.startswith(t, at) and (len(t) > 1 or y in (t,))]
            if here:
                size, _, s, case = max(here)
                parts += ([{"literal": literal}] if literal else []) + [{"source": s, **({"transform": case} if case else {})}]
                literal, at = "", at + size
            else:
                literal, at = literal + y[at], at + 1
        parts += [{"literal": literal}] if literal else []
        sources = sum("source" in p for p in parts)
        if 1 <= sources <= MOST_PARTS and len(parts) > 1:
            add("template", parts=parts)


def _choices(rows: Rows, inputs: list[str], add: Callable) -> None:
    plain = [s for s in inputs if not any(isinstance(r[s], (list, dict)) for r in rows)]
    empty = {s for s in plain if any(r[s] in (None, "") for r in rows)}
    for a in empty:
        for b in plain:
            if a != b and _holds((r[a] if r[a] not in (None, "") else r[b], r["_out"]) for r in rows):
                add("fallback", sources=[a, b])
                for c in plain:
                    if b in empty and c not in (a, b) and any(r[a] in (None, "") and r[b] in (None, "") for r in rows):
                        add("fallback", sources=[a, b, c])
    outputs = [r["_out"] for r in rows if not isinstance(r["_out"], (list, dict))]
    common = sorted({o for o in outputs if outputs.count(o) > 1}, key=lambda o: (-outputs.count(o), str(o)))[:2]
    if len(common) < 2:
        return
    for s in plain:
        for then, other in (common, common[::-1]):
            values = [r[s] for r in rows if r["_out"] == then and r[s] is not None]
            if not values:
                continue
            v = max(set(values), key=lambda x: (values.count(x), str(x)))
            if isinstance(v, (str, int, float)) and _holds((then if r[s] == v else other, r["_out"]) for r in rows):
                add("conditional", source=s, test="equals", value=v, then=then, **{"else": other})


def _split(rows: Rows, s: str, add: Callable) -> None:
    both = [(r[s], r["_out"]) for r in rows if isinstance(r[s], str) and isinstance(r["_out"], list)]
    for sep in sorted({x.strip() or x for x in JOINS}, key=len):
        for trim in (False, True):
            if any(sep in x for x, _ in both) and _holds(([p.strip() for p in x.split(sep)] if trim else x.split(sep), y) for x, y in both):
                add("stringSplit", source=s, separator=sep, trim=trim)


def _path(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_]\w*", name) else '["' + name.replace('"', '\\"') + '"]'


def _fields(items: list) -> list[str | None]:
    """Paths of an item's scalar fields, nested ones with dots; None for items that are no records."""
    if not any(isinstance(x, dict) for x in items):
        return [None]
    out: dict[str, None] = {}

    def walk(record: dict, prefix: str) -> None:
        for k, v in record.items():
            path = prefix + _path(k)
            if isinstance(v, dict):
                walk(v, path + ".")
            elif not isinstance(v, list):
                out[path] = None

    for x in items:
        if isinstance(x, dict):
            walk(x, "")
    return list(out)


def _pick(item, path: str | None):
    if path is None:
        return item
    for part in re.findall(r'\["((?:[^"\\]|\\.)*)"\]|([A-Za-z_]\w*)', path):
        item = item.get(part[0].replace('\\"', '"') or part[1]) if isinstance(item, dict) else None
    return item


def _filters(items: list, fields: list) -> list[dict | None]:
    """No filter, and each value of each field that has few of them."""
    out: list[dict | None] = [None]
    for f in fields:
        if f is None:
            continue
        values = {v for x in items if isinstance(v := _pick(x, f), (str, bool, int))}
        if 1 < len(values) <= MOST_VALUES:
            out += [{"path": f, "equals": v} for v in sorted(values, key=str)]
    return out


def _arrays(rows: Rows, s: str, add: Callable) -> None:
    both = [(r[s], r["_out"]) for r in rows if isinstance(r[s], list)]
    items = [x for a, _ in both for x in a]
    if not items:
        return
    fields = _fields(items)
    outputs = [y for _, y in both]
    kind = max((t for t in (bool, int, float, str, list, dict)), key=lambda t: sum(type(y) is t for y in outputs))
    number = kind in (int, float)
    numeric = [f for f in fields if any(_number(_pick(x, f)) for x in items)]
    for where in _filters(items, fields):
        left = [[x for x in a if where is None or _pick(x, where["path"]) == where["equals"]] for a, _ in both]
        w = {"where": where} if where else {}
        if kind is int and _holds(zip(map(len, left), outputs, strict=True)):
            add("arrayCount", source=s, **w)
        if number:
            _sums(left, outputs, numeric, s, w, add)
        for f in fields:
            e = {"extract": f} if f is not None else {}
            plucked = [[_pick(x, f) for x in a] for a in left]
            if kind is list and _holds(zip(plucked, outputs, strict=True)):
                add("arrayMap", source=s, **w, **e)
            if kind is str:
                for sep in JOINS:
                    if _holds((sep.join("" if v is None else str(v) for v in a), y) for a, y in zip(plucked, outputs, strict=True)):
                        add("arrayJoin", source=s, separator=sep, **w, **e)
            if kind not in (list, dict):
                if where and _holds((a[0] if a else None, y) for a, y in zip(plucked, outputs, strict=True)):
                    add("arrayFind", source=s, where=where, **e)
                if not where:
                    for index, i in (("first", 0), ("last", -1), (1, 1), (2, 2)):
                        if _holds((a[i] if -len(a) <= i < len(a) else None, y) for a, y in zip(plucked, outputs, strict=True)):
                            add("arrayIndex", source=s, index=index, **e)
        if kind is list and fields != [None]:
            _projects(left, outputs, fields, s, w, add)
    if kind is list and fields == [None]:
        steps = {"trim": str.strip, "collapseWhitespace": lambda t: " ".join(t.split()), "lower": str.lower, "upper": str.upper}
        for mode, f in steps.items():
            if _holds(([f(x) if isinstance(x, str) else x for x in a], y) for a, y in both):
                add("arrayStringTransform", source=s, mode=mode)
    if kind is dict:
        _groups(both, fields, s, add)


def _sums(left: list, outputs: list, numeric: list, s: str, w: dict, add: Callable) -> None:
    value = lambda x, f: float(v) if _number(v := _pick(x, f)) else 0.0
    for factors in [(f,) for f in numeric] + (list(combinations(numeric, 2)) if None not in numeric else []):
        sums = [sum(value(x, factors[0]) * (value(x, factors[1]) if len(factors) > 1 else 1) for x in a) for a in left]
        for divisor in (1, 100, 1000):
            if _holds((t / divisor, float(y) if _number(y) else y) for t, y in zip(sums, outputs, strict=True)):
                what = {"factors": list(factors)} if len(factors) > 1 else {"extract": factors[0]} if factors[0] is not None else {}
                add("arraySum", source=s, divisor=divisor, **w, **what)


def _projects(left: list, outputs: list, fields: list, s: str, w: dict, add: Callable) -> None:
    """A source field, as it is or in another case, for each field of the records that are wanted."""
    pairs = [(x, z) for a, y in zip(left, outputs, strict=True) if isinstance(y, list) and len(a) == len(y) for x, z in zip(a, y, strict=True) if isinstance(z, dict)]
    if not pairs or len([1 for a, y in zip(left, outputs, strict=True) if isinstance(y, list) and len(a) == len(y)]) < HOPE * len(left):
        return
    found = []
    for name in pairs[0][1]:
        for f in fields:
            if _holds((_pick(x, f), z.get(name)) for x, z in pairs):
                found.append({"source": f, "target": name})
                break
            case = next((c for c, g in _CASES.items() if c and _holds((g(v) if isinstance(v := _pick(x, f), str) else v, z.get(name)) for x, z in pairs)), None)
            if case:
                found.append({"source": f, "target": name, "transform": case})
                break
        else:
            return
    add("arrayProject", source=s, fields=found, **w)


def _groups(both: list, fields: list, s: str, add: Callable) -> None:
    for by in fields:
        for extract in fields:
            made = []
            for a, y in both:
                groups: dict = {}
                for x in a:
                    if _pick(x, by) is not None:
                        groups.setdefault(str(_pick(x, by)), []).append(_pick(x, extract))
                made.append((groups, y))
            if _holds(made):
                add("arrayGroupBy", source=s, groupBy=by, extract=extract)
