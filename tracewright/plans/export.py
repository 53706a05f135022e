"""Programs as text: Spark SQL, PySpark and jq."""

from __future__ import annotations

import json
import re

from tracewright.plans.program import Op, parse_path


def _split_sql(source: str, separator: str) -> str:
    pattern = re.sub(r"([.*+?^${}()|\\[\]])", r"\\\\\1", separator).replace("'", "''")
    return f"split({source}, '{pattern}', -1)"


def _array_sql(p: dict, q, lit) -> str:
    out, where = q(p["source"]), p.get("where")
    if where:
        out = f"filter({out}, x -> x.{q(where['path'])} <=> {lit(where['equals'])})"
    return f"transform({out}, x -> x.{q(p['extract'])})" if p.get("extract") else out


def spark_sql(program: list[Op], table: str) -> str:
    """A SELECT for the operators that SQL says directly; any other is refused, for a column of nulls would be wrong."""
    out = []
    for op in program:
        p = op.params
        q = lambda s: ".".join(f"`{x}`" for x in parse_path(s))
        lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else json.dumps(v)
        made = {
            "set": lambda: q(p["source"]),
            "constant": lambda: lit(p["value"]),
            "stringCase": lambda: f"{p['mode']}({q(p['source'])})" if p["mode"] in ("upper", "lower", "trim") else None,
            "numericTransform": lambda: {"add": f"{q(p['source'])} + {p.get('value')}", "multiply": f"{q(p['source'])} * {p.get('value')}", "divide": f"try_divide({q(p['source'])}, {p.get('value')})", "absolute": f"abs({q(p['source'])})"}[p["mode"]],
            "numericBinary": lambda: f"{q(p['left'])} { {'add': '+', 'subtract': '-', 'multiply': '*'}[p['mode']]} {q(p['right'])}",
            "valueMap": lambda: f"CASE {q(p['source'])} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in p["map"].items()) + " END",
            "concat": lambda: "concat(" + q(p["sources"][0]) + "".join(f", {lit(s)}, {q(x)}" for s, x in zip(p["separators"], p["sources"][1:], strict=True)) + ")",
            "booleanNot": lambda: f"NOT {q(p['source'])}",
            "numericCompare": lambda: f"{q(p['source'])} {'<' if p['comparison'] == 'lessThan' else '>'} {p.get('value', 0)}",
            "stringReplace": lambda: f"replace({q(p['source'])}, {lit(p['search'])}, {lit(p['replacement'])})",
            "fallback": lambda: "coalesce(" + ", ".join(f"nullif({q(x)}, '')" for x in p["sources"]) + ")",
            "template": lambda: "concat(" + ", ".join(lit(x["literal"]) if "literal" in x else f"{x.get('transform', '')}({q(x['source'])})" for x in p["parts"]) + ")" if all(x.get("transform", "") in ("", "upper", "lower") for x in p["parts"]) else None,
            "splitPart": lambda: f"coalesce(get({_split_sql(q(p['source']), p['separator'])}, {p['index']}), '')",
            "stringSplit": lambda: _split_sql(q(p["source"]), p["separator"]) if not p.get("trim") else None,
            "arrayMap": lambda: _array_sql(p, q, lit),
            "arrayCount": lambda: f"coalesce(size({_array_sql({**p, 'extract': None}, q, lit)}), 0)",
            "arraySum": lambda: f"aggregate({_array_sql(p, q, lit)}, 0D, (a, x) -> a + coalesce(cast(x AS double), 0D)) / {p.get('divisor', 1)}" if "factors" not in p else None,
            "arrayFind": lambda: f"get({_array_sql(p, q, lit)}, 0)",
            "arrayJoin": lambda: f"array_join(transform({_array_sql(p, q, lit)}, x -> cast(x AS string)), {lit(p['separator'])}, '')",
            "arrayIndex": lambda: (f"try_element_at({q(p['source'])}, -1)" if p["index"] == "last" else f"get({q(p['source'])}, {0 if p['index'] == 'first' else p['index']})") + (f".{q(p['extract'])}" if p.get("extract") else ""),
            "conditional": lambda: f"CASE WHEN {q(p['source'])} {'=' if p['test'] == 'equals' else '<>'} {lit(p['value'])} THEN {lit(p['then'])} ELSE {lit(p['else'])} END",
        }.get(op.kind, lambda: None)()
        if not made:
            raise ValueError(f"{op.kind} of {op.target} has no SQL text: run the program")
        out.append(f"{made} AS `{op.target}`")
    return f"SELECT {', '.join(out)} FROM {table}"


def pyspark(program: list[Op]) -> str:
    """Python that rebuilds and runs the program."""
    ops = ",\n    ".join(f"Op({op.kind!r}, {op.target!r}, {op.params!r})" for op in program)
    return f"from tracewright.plans.program import Op, run\n\nPROGRAM = [\n    {ops},\n]\n\n\ndef transform(df):\n    return run(df, PROGRAM)\n"


def _step(path: str) -> str:
    return "".join(f"[{x}]" if isinstance(x, int) else f".{x}" if str(x).isidentifier() else f"[{json.dumps(x)}]" for x in parse_path(path)) or "."


def _items(p: dict) -> str:
    """An array's items, filtered and plucked, as a jq stream."""
    where, extract = p.get("where"), p.get("extract")
    return f"({_step(p['source'])} // [])[]" + (f" | select({_step(where['path'])} == {json.dumps(where['equals'])})" if where else "") + (f" | {_step(extract)}" if extract else "")


_JQ = {
    "set": lambda p: _step(p["source"]),
    "constant": lambda p: json.dumps(p["value"]),
    "stringCase": lambda p: f"({_step(p['source'])} | { {'upper': 'ascii_upcase', 'lower': 'ascii_downcase'}[p['mode']]})" if p["mode"] in ("upper", "lower") else None,
    "numericTransform": lambda p: {"add": f"({_step(p['source'])} + {p.get('value')})", "multiply": f"({_step(p['source'])} * {p.get('value')})", "divide": f"({_step(p['source'])} / {p.get('value')})"}.get(p["mode"]),
    "numericBinary": lambda p: f"({_step(p['left'])} { {'add': '+', 'subtract': '-', 'multiply': '*'}[p['mode']]} {_step(p['right'])})",
    "booleanNot": lambda p: f"({_step(p['source'])} | not)",
    "conditional": lambda p: f"(if {_step(p['source'])} {'==' if p['test'] == 'equals' else '!='} {json.dumps(p['value'])} then {json.dumps(p['then'])} else {json.dumps(p['else'])} end)",
    "fallback": lambda p: "([" + ", ".join(map(_step, p["sources"])) + '] | map(select(. != null and . != "")) | first)',
    "valueMap": lambda p: f"({json.dumps(p['map'])}[{_step(p['source'])} | tostring])" if "map" in p else None,
    "stringReplace": lambda p: f"({_step(p['source'])} | split({json.dumps(p['search'])}) | join({json.dumps(p['replacement'])}))",
    "concat": lambda p: "(" + _step(p["sources"][0]) + "".join(f" + {json.dumps(s)} + {_step(x)}" for s, x in zip(p["separators"], p["sources"][1:], strict=True)) + ")",
    "template": lambda p: "(" + " + ".join(json.dumps(x["literal"]) if "literal" in x else f"({_step(x['source'])} | tostring{ {'upper': ' | ascii_upcase', 'lower': ' | ascii_downcase'}.get(x.get('transform'), '')})" for x in p["parts"]) + ")" if all(x.get("transform") in (None, "upper", "lower") for x in p["parts"]) else None,
    "splitPart": lambda p: f"(({_step(p['source'])} | split({json.dumps(p['separator'])}))[{p['index']}] // \"\")",
    "stringSplit": lambda p: f"({_step(p['source'])} | split({json.dumps(p['separator'])}))" if not p.get("trim") else None,
    "arrayMap": lambda p: f"[{_items(p)}]",
    "arrayCount": lambda p: f"([{_items(p)}] | length)",
    "arraySum": lambda p: f"([{_items(p)}] | (add // 0) / {p.get('divisor', 1)})" if "factors" not in p else f"([({_step(p['source'])} // [])[] | " + " * ".join(map(_step, p["factors"])) + f"] | (add // 0) / {p.get('divisor', 1)})",
    "arrayFind": lambda p: f"(first({_items(p)}) // null)",
    "arrayIndex": lambda p: f"({_step(p['source'])}[{ {'first': 0, 'last': -1}.get(p['index'], p['index'])}]" + (f" | {_step(p['extract'])}" if p.get("extract") else "") + ")",
    "arrayJoin": lambda p: f"([{_items(p)} | tostring] | join({json.dumps(p['separator'])}))",
    "arrayProject": lambda p: f"[{_items(p)} | {{" + ", ".join(f"{json.dumps(f['target'])}: {_step(f['source'])}" for f in p["fields"]) + "}]" if not any("transform" in f for f in p["fields"]) else None,
}


def jq(program: list[Op]) -> str:
    """A jq object that does what the program does; an operator that jq does not say in the same way is refused."""
    tree: dict = {}
    for op in program:
        text = _JQ.get(op.kind, lambda p: None)(op.params)
        if not text:
            raise ValueError(f"{op.kind} of {op.target} has no jq text: run the program")
        *above, name = parse_path(op.target)
        here = tree
        for part in above:
            here = here.setdefault(part, {})
        here[name] = text
    shown = lambda node: node if isinstance(node, str) else "{" + ", ".join(f"{json.dumps(k)}: {shown(v)}" for k, v in node.items()) + "}"
    return shown(tree)
