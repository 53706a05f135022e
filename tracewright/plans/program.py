"""Row programs: operators over paths, compiled to one projection.

A program is a list of operators, each with a target path. Compiling gives one Column per target
and a diagnostics array; running is one ``select`` without a shuffle.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import values as V

_PART = re.compile(r"\.?([A-Za-z_][A-Za-z0-9_]*)|\[(\d+)\]|\[\"((?:[^\"\\]|\\.)*)\"\]|\['((?:[^'\\]|\\.)*)'\]")
_FORBIDDEN = {"__proto__", "prototype", "constructor"}


def parse_path(path: str) -> list[str | int]:
    """``$.a.b[0]["c d"]`` as parts. The ``$`` may be left out."""
    rest, parts = path.removeprefix("$"), []
    while rest:
        m = _PART.match(rest)
        if not m:
            raise ValueError(f"bad path {path!r} at {rest!r}")
        name = next((g for g in (m[1], m[3], m[4]) if g is not None), None)
        parts.append(int(m[2]) if name is None else name.replace('\\"', '"').replace("\\'", "'"))
        rest = rest[m.end() :]
    if any(p in _FORBIDDEN for p in parts):
        raise ValueError(f"unsafe path {path!r}")
    return parts


def at(path: str, root: Column | None = None) -> Column:
    """The Column that a path reads; out of range is null."""
    out = root
    for part in parse_path(path):
        if out is None:
            out = F.col(f"`{part}`")
        else:
            out = F.get(out, part) if isinstance(part, int) else out.getField(part)
    return out


def nested(targets: dict[str, Column]) -> list[Column]:
    """Columns that build all targets, nested ones as one struct each."""
    tree: dict = {}
    for path, value in targets.items():
        parts = parse_path(path)
        here = tree
        for p in parts[:-1]:
            here = here.setdefault(p, {})
        here[parts[-1]] = value

    def build(node):
        if isinstance(node, Column):
            return node
        if all(isinstance(k, int) for k in node):
            return F.array(*[build(node[i]) for i in sorted(node)])
        return F.struct(*[build(v).alias(str(k)) for k, v in node.items()])

    return [build(v).alias(str(k)) for k, v in tree.items()]


@dataclass(frozen=True)
class Op:
    """One operator: its kind, the target path and its parameters."""

    kind: str
    target: str
    params: dict[str, Any] = field(default_factory=dict)

    def sources(self) -> list[str]:
        p = self.params
        own = [p[k] for k in ("source", "left", "right", "base", "rate") if k in p]
        return own + list(p.get("sources", [])) + [x["source"] for x in p.get("parts", []) if "source" in x]

    def to_dict(self) -> dict:
        return {"op": self.kind, "target": self.target, **self.params}


def load(text: str) -> list[Op]:
    """A program from its JSON form."""
    return [Op(d.pop("op"), d.pop("target"), d) for d in json.loads(text)["ops"]]


def dump(program: list[Op]) -> str:
    return json.dumps({"version": 1, "ops": [op.to_dict() for op in program]}, sort_keys=True)


def _picked(item: Column, path: str | None) -> Column:
    return item if path in (None, "$", "") else at(path, item)


def _where(items: Column, where: dict | None) -> Column:
    return items if not where else F.filter(items, lambda x: _picked(x, where["path"]).eqNullSafe(F.lit(where["equals"])))


def _numeric(path: str) -> Column:
    """A path's number for arithmetic: an empty text is 0, booleans are 0 and 1."""
    c = at(path)
    text = V.trimmed(c.cast("string"))
    return F.when(text == "", 0.0).when(text == "true", 1.0).when(text == "false", 0.0).otherwise(V.number(text))


def _text(path: str) -> Column:
    return at(path).cast("string")


def _kinds() -> dict:
    def formula(p):
        rate = _numeric(p["rate"]) / p.get("rateDivisor", 100)
        base = _numeric(p["base"]) / p.get("baseDivisor", 1)
        signed = rate if p.get("direction", "add") == "add" else -rate
        value = base * (1 + signed) if p.get("evaluationOrder", "factor") == "factor" else base + base * signed
        return V.rounded(value, p.get("rounding", "half-up"), p.get("decimals", 2))

    def transform(p):
        x, v = _numeric(p["source"]), p.get("value", 1)
        return {"add": lambda: x + v, "multiply": lambda: x * v, "divide": lambda: F.try_divide(x, F.lit(float(v))), "absolute": lambda: F.abs(x) / v}[p["mode"]]()

    def binary(p):
        a, b = _numeric(p["left"]), _numeric(p["right"])
        return {"add": a + b, "subtract": a - b, "multiply": a * b}[p["mode"]]

    def normalize(p):
        c = _text(p["source"])
        return {
            "collapseWhitespace": lambda: V.collapsed(c),
            "phone": lambda: V.phone(c, p.get("country")),
            "dateNormalize": lambda: F.when(V.trimmed(c).rlike(r"^\d{4}-\d{2}-\d{2}T"), c).otherwise(F.coalesce(V.date_text(c, "isoDate"), c)),
            "s3KeyDecode": lambda: V.decoded_key(c),
        }[p["mode"]]()

    def coerce(p):
        c = at(p["source"])
        return {"number": lambda: V.number(c), "string": lambda: c.cast("string"), "boolean": lambda: V.boolean(c)}[p["to"]]()

    def conditional(p):
        same = at(p["source"]).eqNullSafe(F.lit(p["value"]))
        return F.when(same if p["test"] == "equals" else ~same, F.lit(p["then"])).otherwise(F.lit(p["else"]))

    def template(p):
        def part(x):
            if "literal" in x:
                return F.lit(x["literal"])
            c = _text(x["source"])
            return F.coalesce(V.cased(c, x["transform"]) if x.get("transform") else c, F.lit(f"[missing {x['source']}]"))

        return F.concat(*[part(x) for x in p["parts"]])

    def concat(p):
        out = [_text(p["sources"][0])]
        for separator, source in zip(p["separators"], p["sources"][1:], strict=True):
            out += [F.lit(separator), _text(source)]
        return F.concat(*out)

    def value_map(p):
        if "map" not in p:
            raise ValueError("a lookup kept as a table is joined: use run() or lookup()")
        entries = [x for k, v in p["map"].items() for x in (F.lit(k), F.lit(v))]
        return F.try_element_at(F.create_map(*entries), _text(p["source"]))

    def array_strings(p):
        step = {"trim": V.trimmed, "collapseWhitespace": V.collapsed, "lower": F.lower, "upper": F.upper}[p["mode"]]
        return F.transform(at(p["source"]), step)

    def project(p):
        fields = lambda x: F.struct(*[(V.cased(_picked(x, f["source"]).cast("string"), f["transform"]) if f.get("transform") else _picked(x, f["source"])).alias(f["target"]) for f in p["fields"]])
        return F.transform(_where(at(p["source"]), p.get("where")), fields)

    def array_sum(p):
        factors = p.get("factors") or [p.get("extract")]
        one = lambda x: reduce(lambda a, b: a * b, [F.coalesce(_picked(x, f).cast("double"), F.lit(0.0)) for f in factors])
        return F.aggregate(_where(at(p["source"]), p.get("where")), F.lit(0.0), lambda a, x: a + one(x)) / p.get("divisor", 1)

    def index(p):
        i = {"first": 0, "last": -1}.get(p["index"], p["index"])
        item = F.try_element_at(at(p["source"]), F.lit(-1)) if i == -1 else F.get(at(p["source"]), F.lit(int(i)))
        return _picked(item, p.get("extract"))

    def join(p):
        items = F.transform(_where(at(p["source"]), p.get("where")), lambda x: _picked(x, p.get("extract")).cast("string"))
        return F.array_join(items, p["separator"], "")

    def group(p):
        items = at(p["source"])
        keys = F.array_distinct(F.transform(items, lambda x: _picked(x, p["groupBy"]).cast("string")))
        keys = F.filter(keys, lambda k: k.isNotNull())
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.transform(F.filter(items, lambda x: _picked(x, p["groupBy"]).cast("string") == k), lambda x: _picked(x, p["extract"])))))

    def split(p):
        parts = V.split_at(_text(p["source"]), p["separator"])
        return F.transform(parts, V.trimmed) if p.get("trim") else parts

    return {
        "set": lambda p: at(p["source"]),
        "constant": lambda p: F.lit(p["value"]),
        "coerce": coerce,
        "stringCase": lambda p: V.cased(_text(p["source"]), p["mode"]),
        "stringNormalize": normalize,
        "stringReplace": lambda p: F.replace(_text(p["source"]), F.lit(p["search"]), F.lit(p["replacement"])),
        "numericTransform": transform,
        "numericBinary": binary,
        "numericFormula": formula,
        "numericCompare": lambda p: _numeric(p["source"]) < p.get("value", 0) if p["comparison"] == "lessThan" else _numeric(p["source"]) > p.get("value", 0),
        "quantityTransform": lambda p: V.quantity(_text(p["source"]), p["factor"], p["unit"]),
        "booleanNot": lambda p: ~at(p["source"]).cast("boolean"),
        "conditional": conditional,
        "fallback": lambda p: F.coalesce(*[F.when(at(s).cast("string") != "", at(s)) for s in p["sources"]]),
        "dateFormat": lambda p: V.date_text(_text(p["source"]), p["mode"]),
        "extractBetween": lambda p: V.between(_text(p["source"]), p["prefix"], p["suffix"]),
        "regexExtract": lambda p: F.regexp_extract(_text(p["source"]), p["pattern"], p.get("group", 0)),
        "template": template,
        "concat": concat,
        "splitPart": lambda p: F.coalesce(F.get(V.split_at(_text(p["source"]), p["separator"]), F.lit(p["index"])), F.lit("")),
        "stringSplit": split,
        "arrayStringTransform": array_strings,
        "valueMap": value_map,
        "arrayMap": lambda p: F.transform(_where(at(p["source"]), p.get("where")), lambda x: _picked(x, p.get("extract"))),
        "arrayProject": project,
        "arrayCount": lambda p: F.coalesce(F.size(_where(at(p["source"]), p.get("where"))), F.lit(0)),
        "arraySum": array_sum,
        "arrayIndex": index,
        "arrayJoin": join,
        "arrayFind": lambda p: _picked(F.get(_where(at(p["source"]), p["where"]), F.lit(0)), p.get("extract")),
        "arrayGroupBy": group,
        "templateConflict": lambda p: F.lit(f"[conflict {p.get('reason', 'template')}]"),
        "valueMapConflict": lambda p: F.lit("[conflict lookup]"),
    }


KINDS = _kinds()

#: Diagnostics of operators whose null result says why.
_REASONS = {"valueMap": "unseen-value", "dateFormat": "invalid-date", "quantityTransform": "invalid-quantity", "fallback": "all-fallbacks-empty", "coerce": "not-convertible", "numericTransform": "not-numeric", "numericBinary": "not-numeric", "numericFormula": "not-numeric"}


def compiled(op: Op) -> Column:
    """The value of an operator, null where its optional domain is absent."""
    if op.kind not in KINDS:
        raise ValueError(f"unknown operator {op.kind}")
    value = KINDS[op.kind](op.params)
    domain = op.params.get("domain")
    return F.when(at(domain).isNotNull(), value) if domain else value


def diagnostics(program: list[Op]) -> Column:
    """Array of code and path for every operator that could not do its work on the row."""
    found = []
    for op in program:
        shape = lambda code: F.struct(F.lit(code).alias("code"), F.lit(op.target).alias("path"))  # noqa: B023, E731
        value, domain = compiled(op), op.params.get("domain")
        inside = at(domain).isNotNull() if domain else F.lit(True)
        missing = reduce(lambda a, b: a | b, [at(s).isNull() for s in op.sources()], F.lit(False))
        if op.kind == "stringNormalize" and op.params["mode"] == "phone":
            found.append(F.when(inside & ~missing & value.isNull(), shape("invalid-phone")))
        elif op.kind == "stringNormalize" and op.params["mode"] == "dateNormalize":
            found.append(F.when(inside & ~missing & V.iso_date(_text(op.params["source"])).isNull(), shape("invalid-date")))
            found.append(F.when(inside & V.ambiguous_date(_text(op.params["source"])), shape("ambiguous-date")))
        elif op.kind == "regexExtract":
            found.append(F.when(inside & ~missing & (value == ""), shape("regex-no-match")))
        elif op.kind.endswith("Conflict"):
            found.append(shape("conflict"))
        elif op.kind in _REASONS:
            found.append(F.when(inside & value.isNull() & (F.lit(op.kind == "fallback") | ~missing), shape(_REASONS[op.kind])))
        if op.sources() and op.kind != "fallback":
            found.append(F.when(inside & missing, shape("missing-source")))
    if not found:
        return F.array().cast("array<struct<code:string,path:string>>")
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def run(df: DataFrame, program: list[Op], keep: tuple[str, ...] = (), explain: bool = False) -> DataFrame:
    """The program's output for every row, with the kept input columns before it.

    One projection: no shuffle, and only the columns the program names are read. Lookups kept as a
    table are joined before it.
    """
    made, literal = {}, []
    for i, op in enumerate(program):
        if op.kind == "valueMap" and "table" in op.params:
            df = lookup(df, op.params["source"], df.sparkSession.read.parquet(op.params["table"]), "source", "output", f"_lookup_{i}")
            made[op.target] = F.col(f"_lookup_{i}")
        else:
            made[op.target] = compiled(op)
            literal.append(op)
    columns = [F.col(c) for c in keep] + nested(made)
    if explain:
        columns.append(diagnostics(literal).alias("diagnostics"))
    return df.select(*columns)


def lookup(df: DataFrame, source: str, table: DataFrame, key: str, value: str, target: str) -> DataFrame:
    """A learned lookup too large for a literal map: a left join, broadcast where Spark finds the table small. Keys compare as texts."""
    t = table.select(F.col(key).cast("string").alias("_key"), F.col(value).alias(target)).dropDuplicates(["_key"])
    return df.join(t, at(source).cast("string") == F.col("_key"), "left").drop("_key")
