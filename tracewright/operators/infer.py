"""Rules from examples: propose operators from a few rows, test them all on every row in one pass.

Proposals come from at most ``EVIDENCE`` rows on the driver and are first tried on these rows; whether
one holds is decided by Spark over the whole batch, with the remaining candidates of all targets
counted together, so a rule means the same when it is learned and when it runs. Lookups are learned
from the whole batch, whatever their number of keys: a small one becomes a literal map, a larger one
stays a table that is joined.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import values as V
from tracewright.operators import generators
from tracewright.operators.matching import affinity
from tracewright.plans.program import Op, at, compiled, lookup, parse_path

#: Rows that proposals are read from, and of these the ones whose values suggest operators.
EVIDENCE, SUGGEST = 200, 8
#: A proposal that fewer evidence rows bear out is not counted over all rows.
HOPE = 0.6
#: A rule is supported if all rows agree, or 95 % of 8 or more; 80 % is a near fit.
SUPPORT, NEAR, LEAST = 0.95, 0.80, 8
#: A lookup with an entry for every second row or more has only memorised.
MEMORISED = 0.5
#: Registers (2 to this power) of a sketch of distinct values: its error is 1.6 %.
SKETCH = 12
#: Entries up to which a lookup is written as a literal map into its rule; it means the same as a table.
LITERAL = 500
#: Rare outputs of a target, up to this share of the evidence, have a row of their own in it.
RARE = 0.1
#: What an operator costs; the cheapest that fits is chosen.
COSTS = {
    "set": 1.05, "stringNormalize": 1.16, "arrayStringTransform": 1.18, "dateFormat": 1.22, "quantityTransform": 1.32, "stringCase": 1.35, "booleanNot": 1.35, "numericCompare": 1.38, "stringSplit": 1.4, "stringReplace": 1.42, "extractBetween": 1.42,
    "coerce": 1.45, "numericBinary": 1.45, "fallback": 1.52, "numericTransform": 1.55, "template": 1.58, "arrayIndex": 1.62, "arrayCount": 1.65, "concat": 1.65, "arraySum": 1.7, "numericFormula": 1.72, "regexExtract": 1.72, "arrayJoin": 1.82, "arrayMap": 1.85,
    "constant": 1.9, "splitPart": 1.9, "conditional": 2.0, "arrayProject": 2.15, "arrayFind": 2.18, "valueMap": 2.25, "arrayGroupBy": 2.3,
}
#: How far what is known of an operator may move its cost, and what its length adds at most.
MOST_SHIFT, MOST_LENGTH, LENGTH = 0.25, 0.04, 0.00025
#: Rules of rounding.
ROUNDINGS = ("half-up", "half-even", "floor", "ceil", "trunc", "half-away", "none")
#: Separators that are tried.
SEPARATORS = (" ", ",", "-", "_", "|", "/", ".")


@dataclass
class Rule:
    """What was learned for a target."""

    target: str
    op: Op | None
    status: str  # exact, dominant, near, memorised, none
    matches: int = 0
    rows: int = 0
    table: DataFrame | None = None  # of a lookup beyond LITERAL entries: source, output

    @property
    def cost(self) -> float:
        return weight(self.op) if self.op else 9.0


def weight(op: Op) -> float:
    """The operator's cost, moved a little by its form: filters, several sources, steps and unlike names cost more."""
    p, sources = op.params, op.sources()
    shift = 0.18 * ("+" in str(p.get("mode", ""))) + 0.25 * bool(p.get("where")) + 0.12 * (op.kind == "arrayJoin" and "extract" in p)
    shift += 0.2 * (op.kind == "numericTransform" and p.get("mode") in ("multiply", "divide")) + 0.04 * (p["index"] if op.kind == "splitPart" else 0)
    if op.kind == "template":
        shift += 0.06 * sum("source" in x for x in p["parts"]) + 0.02 * sum("literal" in x for x in p["parts"]) + 0.05 * sum("transform" in x for x in p["parts"])
    if sources:
        shift -= 0.2 * max(affinity(s, op.target) for s in sources)
    length = len(json.dumps(op.to_dict(), sort_keys=True, default=str)) if op.kind != "valueMap" else 160
    return COSTS.get(op.kind, 2.5) + max(-MOST_SHIFT, min(MOST_SHIFT, shift)) + min(MOST_LENGTH, LENGTH * length)


def _like(a, b) -> bool:
    return isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool)


def proposals(rows: list[dict], inputs: list[str], target: str) -> list[Op]:
    """Operators that could make ``target``, read from example rows with input fields and ``_out``."""
    out: list[Op] = []
    add = lambda kind, **p: out.append(Op(kind, target, p))
    rows = [r for r in rows if r["_out"] is not None]
    if not rows:
        return out
    values = [r["_out"] for r in rows]
    common = max(values, key=values.count)
    if values.count(common) >= NEAR * len(values):
        add("constant", value=common)
    # a corrupt row must not decide alone: several rows, evenly spread, make suggestions
    some = lambda xs: xs[:: max(1, len(xs) // SUGGEST)][:SUGGEST]
    for s, x, y in ((s, x, y) for s in inputs for x, y in some([(r[s], r["_out"]) for r in rows if r[s] is not None])):
        add("set", source=s)
        if isinstance(y, bool):
            if isinstance(x, bool):
                add("booleanNot", source=s)
            if _like(x, 0):
                add("numericCompare", source=s, comparison="lessThan", value=0)
                add("numericCompare", source=s, comparison="greaterThan", value=0)
        if isinstance(x, str) and (_like(y, 0) or isinstance(y, bool)):
            add("coerce", source=s, to="boolean" if isinstance(y, bool) else "number")
        if isinstance(y, str) and not isinstance(x, (str, date, datetime)):
            add("coerce", source=s, to="string")
        if _like(x, y):
            steps = {("add", y - x)} | ({("multiply", y / x), ("divide", x / y)} if x and y else set())
            for mode, v in steps:
                if v not in (0, 1) and abs(v - round(v, 6)) < 1e-9:
                    add("numericTransform", source=s, mode=mode, value=round(v, 6))
            add("numericTransform", source=s, mode="absolute", value=1)
        if isinstance(x, str) and isinstance(y, str):
            for mode in ("upper", "lower", "title", "trim", "trim+upper", "trim+lower", "trim+title"):
                add("stringCase", source=s, mode=mode)
            add("stringNormalize", source=s, mode="collapseWhitespace")
            add("stringNormalize", source=s, mode="dateNormalize")
            for mode in V.DATE_FORMATS:
                add("dateFormat", source=s, mode=mode)
            for sep in SEPARATORS:
                parts = x.split(sep)
                if len(parts) > 1 and y in parts[:6]:
                    add("splitPart", source=s, separator=sep, index=parts.index(y))
                if sep in x and len(x) == len(y):
                    glue = {b for a, b in zip(x, y, strict=True) if a == sep}
                    if len(glue) == 1:
                        add("stringReplace", source=s, search=sep, replacement=glue.pop())
            if y and y in x and y != x:
                at = x.index(y)
                pre, post = x[max(0, at - 2) : at], x[at + len(y) : at + len(y) + 1]
                if pre and post:
                    add("extractBetween", source=s, prefix=pre, suffix=post)
            if y.isdigit() and x != y:
                add("regexExtract", source=s, pattern="[0-9]+")
    for x in some(rows):
        texts = [s for s in inputs if isinstance(x[s], str) and x[s]] if isinstance(x["_out"], str) else []
        for a in texts:
            for b in texts:
                if a != b and x["_out"].startswith(x[a]) and x["_out"].endswith(x[b]) and len(x["_out"]) >= len(x[a]) + len(x[b]):
                    add("concat", sources=[a, b], separators=[x["_out"][len(x[a]) : len(x["_out"]) - len(x[b])]])
    numbers = [s for s in inputs if any(_like(r[s], 0) for r in rows)]
    if any(_like(v, 0) for v in values):
        for i, a in enumerate(numbers):
            for j, b in enumerate(numbers):
                if i != j:
                    for mode in ("add", "subtract", "multiply") if i < j else ("subtract",):
                        add("numericBinary", left=a, right=b, mode=mode)
                    for divisor in (1, 100):
                        for direction in ("add", "subtract"):
                            add("numericFormula", base=a, rate=b, rateDivisor=divisor, direction=direction, rounding="half-up")
    out = [op for op in dict((repr(o), o) for o in [*out, *generators.suggestions(rows, inputs, target)]).values() if _plausible(op, rows)]
    return [v for op in out for v in (_variants(op) if op.kind == "numericFormula" else [op])]


def _variants(op: Op) -> list[Op]:
    """A formula that comes near, with each rule of rounding in either order; the whole batch decides."""
    turns = [(r, o) for o in ("factor", "sum") for r in ROUNDINGS]
    return [Op(op.kind, op.target, {**op.params, "rounding": r, **({"evaluationOrder": o} if o != "factor" else {})}) for r, o in turns]


def _plausible(op: Op, rows: list[dict]) -> bool:
    """A cheap look at the evidence: whether the operator may bear out ``HOPE`` of the rows. It never refuses one that does."""
    p = op.params
    if op.kind in ("numericBinary", "numericFormula"):
        near = 0
        for r in rows:
            a, b = (r[p["left"]], r[p["right"]]) if op.kind == "numericBinary" else (r[p["base"]], r[p["rate"]])
            if not (_like(a, b) and _like(r["_out"], 0)):
                continue
            a, b = float(a), float(b)
            got = {"add": a + b, "subtract": a - b, "multiply": a * b}[p["mode"]] if op.kind == "numericBinary" else a * (1 + (1 if p["direction"] == "add" else -1) * b / p["rateDivisor"])
            near += abs(got - float(r["_out"])) <= 0.011 + 1e-9 * abs(got)
        return near >= HOPE * len(rows)
    may = _MAY.get(op.kind)
    return not may or sum(may(p, r[p["source"]], r["_out"]) for r in rows) >= HOPE * len(rows)


def _float(v) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _alike(a, b) -> bool:
    """Whether two values may be one: as texts without case and blanks, or as numbers; of other types, perhaps."""
    if isinstance(a, str) and isinstance(b, str):
        return "".join(a.split()).casefold() == "".join(b.split()).casefold()
    if isinstance(a, (list, dict)) or isinstance(b, (list, dict)):
        return type(a) is type(b)
    x, y = _float(a), _float(b)
    return abs(x - y) <= 1e-6 * max(1, abs(x)) if x is not None and y is not None else type(a) is not type(b) or a == b


def _scaled(p: dict, x, y) -> bool:
    x, y, v = _float(x), _float(y), p["value"]
    if x is None or y is None:
        return False
    got = {"add": x + v, "multiply": x * v, "divide": x / v if v else None, "absolute": abs(x) / (v or 1)}[p["mode"]]
    return got is not None and abs(got - y) <= 1e-6 * max(1, abs(got))


_digits = lambda t: sorted(c for c in t if c.isdigit())
_dated = lambda p, x, y: isinstance(x, str) and isinstance(y, str) and len(_digits(x)) >= 8 and not set(_digits(y)) - set(_digits(x)) and len(_digits(y)) in (4, 6, 8)
_MAY = {
    "set": lambda p, x, y: _alike(x, y),
    "coerce": lambda p, x, y: _alike(x, y),
    "stringCase": lambda p, x, y: _alike(x, y),
    "stringNormalize": lambda p, x, y: _dated(p, x, y) or x == y if p["mode"] == "dateNormalize" else _alike(x, y) if p["mode"] == "collapseWhitespace" else True,
    "dateFormat": _dated,
    "stringReplace": lambda p, x, y: isinstance(x, str) and isinstance(y, str) and x.replace(p["search"], p["replacement"]) == y,
    "extractBetween": lambda p, x, y: isinstance(x, str) and isinstance(y, str) and y in x,
    "splitPart": lambda p, x, y: isinstance(x, str) and isinstance(y, str) and y in x,
    "regexExtract": lambda p, x, y: isinstance(x, str) and isinstance(y, str) and y in x,
    "numericTransform": _scaled,
}


def interpreted(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """A few rows of ``df``'s schema, in a session that interprets expressions: hundreds of rules are tried once, not compiled."""
    session = df.sparkSession.newSession()
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    session.conf.set("spark.sql.session.timeZone", df.sparkSession.conf.get("spark.sql.session.timeZone"))
    return session.createDataFrame(rows, df.schema).coalesce(1)


def supports(pairs: DataFrame, tests: list[tuple[str, Op]], most: int = 24) -> list[tuple[int, int]]:
    """Matches and rows of each (output column, operator), ``most`` in an aggregate, so that it still compiles."""
    out: list[tuple[int, int]] = []
    for at in range(0, len(tests), most):
        part = tests[at : at + most]
        row = pairs.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(agrees(c, op, pairs)).alias(f"m{i}") for i, (c, op) in enumerate(part)]).first()
        out += [(row[f"m{i}"], row["n"]) for i in range(len(part))]
    return out


def agrees(column: str, op: Op, df: DataFrame | None = None):
    """Whether an operator makes the value of a column: numbers by value, arrays, records and maps by their JSON."""
    return same(compiled(op), column, df)


def same(value, column: str, df: DataFrame | None = None):
    kind = df.schema[column].dataType.typeName() if df is not None and column in df.columns else ""
    wanted = F.col(f"`{column}`")
    if kind in ("array", "struct", "map"):
        equal = F.coalesce(_json(value) == _json(wanted), value.isNull() & wanted.isNull())
        # equal values of one type have equal JSON: only the others are written as JSON
        alike = _alike_as_they_are(value, column, df)
        return equal if alike is None else F.when(alike, F.lit(True)).otherwise(equal)
    return F.coalesce(value.try_cast("string") == wanted.cast("string"), value.isNull() & wanted.isNull()) | F.coalesce((value.try_cast("double") == wanted.try_cast("double")), F.lit(False))


def _alike_as_they_are(value, column: str, df: DataFrame):
    """Whether a value equals a column of just its type, maps by their entries in order; none if the type cannot be compared."""
    kind, wanted = df.schema[column].dataType.simpleString(), F.col(f"`{column}`")
    whole = kind.startswith("map<")
    if any(t in kind[4 * whole :] for t in ("map<", "variant")) or df.select(value.alias("v")).schema["v"].dataType.simpleString() != kind:
        return None
    if whole:
        value, wanted = (F.array_sort(F.map_entries(m)) for m in (value, wanted))
    return value.eqNullSafe(wanted)


def _json(value):
    """JSON with keys in order, whole numbers alike whatever their type; null for null."""
    return F.when(value.isNotNull(), F.to_json(F.try_parse_json(F.to_json(F.struct(value.alias("v"))))))


def matches_rule(df: DataFrame, rule: Rule, column: str) -> DataFrame:
    """``df`` with ``_same``: whether the rule makes the column's value. A large lookup is joined."""
    if rule.table is None:
        return df.withColumn("_same", agrees(column, rule.op, df))
    joined = lookup(df, rule.op.params["source"], rule.table, "source", "output", "_found")
    return joined.withColumn("_same", same(F.col("_found"), column)).drop("_found")


def lookup_counts(pairs: DataFrame, source: str, column: str) -> DataFrame:
    """source, the commonest output, rows of the source, rows that agree; sources with a tie are left out."""
    counts = pairs.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source"), F.col(column).alias("output")).agg(F.count(F.lit(1)).alias("agree"))
    by = Window.partitionBy("source")
    ranked = counts.withColumn("rows", F.sum("agree").over(by)).withColumn("_rank", F.rank().over(by.orderBy(F.desc("agree")))).where("_rank = 1")
    return ranked.withColumn("_tied", F.count(F.lit(1)).over(by)).where("_tied = 1").select("source", "output", "rows", "agree")


def roots(df: DataFrame, paths: list[str]) -> list[str]:
    """The columns of ``df`` that paths begin with; a column's own name is a path."""
    return list(dict.fromkeys(p if p in df.columns else str(parse_path(p)[0]) for p in paths))


def leaf(df: DataFrame, path: str):
    return F.col(f"`{path}`") if path in df.columns else at(path)


def picked(row: dict, path: str):
    """The value at a path of a row that has been read."""
    if path in row:
        return row[path]
    for part in parse_path(path):
        row = row[part] if isinstance(row, list) and isinstance(part, int) and part < len(row) else row.get(part) if isinstance(row, dict) else None
    return row


def examples(rows: list, inputs: list[str], column: str) -> list[dict]:
    """What proposals are read from: each row's values by input path, and ``_out``."""
    found = [r.asDict(recursive=True) for r in rows]
    return [{**{p: picked(r, p) for p in inputs}, "_out": r[column]} for r in found]


def guarded(ops: list[Op], rows: list[dict], inputs: list[str], most: int = 2) -> list[Op]:
    """The operators with a guard: an input that is there on just those rows that have an output."""
    absent = [r for r in rows if r["_out"] is None]
    if not absent or len(rows) - len(absent) < LEAST:
        return []
    guards = [s for s in inputs if all((r[s] is None) == (r["_out"] is None) for r in rows)][:most]
    return [Op(op.kind, op.target, {**op.params, "domain": g}) for g in guards for op in ops if g not in op.sources()]


def evidence(pairs: DataFrame, columns: list[str], targets: list[str], most: int = EVIDENCE) -> list:
    """At most ``most`` distinct rows, by hash, among them one for each output of targets that have few.

    Equal rows hash alike and come together: where the first ones repeat, the lowest distinct hashes are
    looked up, so that copies of a row do not crowd out others.
    """
    slim = pairs.select(*[F.col(f"`{c}`") for c in columns])
    plain = [c for c in columns if slim.schema[c].dataType.typeName() not in ("map", "variant")]
    draw = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    head = slim.withColumn("_h", draw).orderBy("_h").limit(most).select("_h", row.alias("_r")).collect()
    rows, full = {repr(r["_r"]): r["_r"] for r in head}, len(head) == most
    if full and len(rows) < most and len(plain) == len(columns):
        lowest = [r["_h"] for r in slim.select(draw.alias("_h")).distinct().orderBy("_h").limit(most).collect()]
        rows = {repr(r): r for r in _one_each(slim, draw, draw <= F.lit(lowest[-1]))}
    few = [t for t in targets if slim.schema[t].dataType.typeName() not in ("array", "struct", "map", "variant")]
    if full and few:
        # the outputs seen so far are known: only targets with few of them can have rare ones
        few = [t for t in few if len({r[t] for r in rows.values()}) <= RARE * most]
    if full and few:
        # the hash is made before the outputs are exploded: else each of them hashes the whole row again
        each = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"`{t}`").cast("string").alias("v")) for t in few])
        drawn = slim.select(draw.alias("_h"), each.alias("_x")).select("_h", F.explode("_x").alias("x"))
        lowest = drawn.groupBy("x.t", "x.v").agg(F.min("_h").alias("_h")).persist()
        try:
            rare = [r["t"] for r in lowest.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= int(RARE * most)).collect()]
            of = {t: [r["_h"] for r in lowest.where(F.col("t") == t).collect()] for t in sorted(rare, key=few.index)}
        finally:
            lowest.unpersist()
        found = {r["_h"]: r["_r"] for r in head}  # an output that the lowest hashes have has its own lowest one there
        hashes = sorted({h for hs in of.values() for h in hs} - found.keys())
        if hashes:
            found |= {r["_h"]: r["_r"] for r in _by_hash(slim, draw, draw.isin(hashes)).collect()}
        for hs in of.values():
            extra = {repr(found[h]): found[h] for h in hs}
            rows = extra | dict(list({k: v for k, v in rows.items() if k not in extra}.items())[: most - len(extra)])
    return list(rows.values())


def _by_hash(slim: DataFrame, draw, which) -> DataFrame:
    """One row of each hash among those wanted."""
    row = F.struct(*[F.col(f"`{c}`") for c in slim.columns])
    return slim.where(which).groupBy(draw.alias("_h")).agg(F.first(row).alias("_r"))


def _one_each(slim: DataFrame, draw, which) -> list:
    return [r["_r"] for r in _by_hash(slim, draw, which).orderBy("_h").collect()]


def infer(pairs: DataFrame, inputs: list[str], outputs: dict[str, str]) -> list[Rule]:
    """A rule for each target of ``outputs`` (target path -> column of ``pairs``).

    Of rules that hold as well the cheapest is chosen (``weight``). The cheapest one that all evidence
    bears out is counted first: if it is exact, no other can be chosen, as a cheaper one already fails on some
    row. Only the targets left count all their candidates. Where no operator holds on almost
    all rows, lookups by every source that repeats are counted over the whole batch, and the best taken.
    """
    slim, tests = _hopeful(pairs, inputs, outputs)
    first = {}
    for column, op, sure in tests:
        if sure:
            first.setdefault(op.target, []).append((weight(op), repr(op), column, op))
    first = {target: min(ops, key=lambda o: o[:2])[2:] for target, ops in first.items()}
    exact = {op.target: Rule(op.target, op, "exact", m, n) for (_, op), (m, n) in zip(first.values(), supports(slim, list(first.values())), strict=True) if n and m == n}
    rest = {t: c for t, c in outputs.items() if t not in exact}
    others = _counted(slim, inputs, rest, [(c, op) for c, op, _ in tests if op.target in rest])
    return [exact.get(t) or (others[t][0] if others[t] else Rule(t, None, "none")) for t in outputs]


def candidates(pairs: DataFrame, inputs: list[str], outputs: dict[str, str]) -> dict[str, list[Rule]]:
    """All rules that hold on four of five rows, of each target, the best first."""
    slim, tests = _hopeful(pairs, inputs, outputs)
    return _counted(slim, inputs, outputs, [(c, op) for c, op, _ in tests])


def _hopeful(pairs: DataFrame, inputs: list[str], outputs: dict[str, str]) -> tuple[DataFrame, list[tuple[str, Op, bool]]]:
    """The columns that matter, and the proposals worth counting: (output column, operator, whether all evidence bears it out)."""
    columns = list(dict.fromkeys([*roots(pairs, inputs), *outputs.values()]))
    known = evidence(pairs, columns, list(outputs.values()))
    tests: list[tuple[str, Op]] = []
    for target, column in outputs.items():
        rows = examples(known, inputs, column)
        found = proposals(rows, inputs, target)
        tests += [(column, op) for op in found + guarded(found, rows, inputs)]
    slim = pairs.select(*[F.col(f"`{c}`") for c in columns])
    if not known:
        return slim, [(*t, False) for t in tests]
    sample = interpreted(slim, [tuple(r) for r in known])
    return slim, [(*t, m == n) for t, (m, n) in zip(tests, supports(sample, tests, 300), strict=True) if m >= HOPE * n]


def _counted(slim: DataFrame, inputs: list[str], outputs: dict[str, str], tests: list[tuple[str, Op]]) -> dict[str, list[Rule]]:
    """The rules of each target that hold on four of five rows of the whole batch, the best first."""
    results = list(zip(tests, supports(slim, tests), strict=True))
    out, sizes = {}, None
    for target, column in outputs.items():
        own = [Rule(target, op, _STATUS[_grade(m, n)], m, n) for (c, op), (m, n) in results if c == column and op.target == target and _grade(m, n)]
        own.sort(key=lambda r: (-_grade(r.matches, r.rows), r.cost, repr(r.op)))
        if not own or _grade(own[0].matches, own[0].rows) < 2:
            sizes = sizes or source_sizes(slim, inputs)
            mapped = best_lookup(slim, inputs, target, column, sizes)
            if mapped and _grade(mapped.matches, mapped.rows) >= 2:
                own.insert(0, mapped)
        out[target] = own
    return out


_STATUS = ("none", "near", "dominant", "exact")


def _grade(matches: int, rows: int) -> int:
    """3 exact, 2 dominant, 1 near, 0 none."""
    if rows and matches == rows:
        return 3
    if rows >= LEAST and matches >= SUPPORT * rows:
        return 2
    return int(rows >= LEAST and matches >= NEAR * rows)


_DEEP = ("array", "struct", "map", "variant")


def source_sizes(pairs: DataFrame, inputs: list[str]) -> dict[str, int]:
    """Estimated distinct values of each source that a lookup may go by, and the rows (``""``)."""
    kinds = pairs.select(*[leaf(pairs, s).alias(s) for s in inputs]).schema
    simple = [s for s in inputs if kinds[s].dataType.typeName() not in _DEEP]
    # a sketch is one value; approx_count_distinct at 2 % has some 400 columns for each source, whose code every task writes anew
    sketch = lambda s: F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(leaf(pairs, s).cast("string"), SKETCH)), F.lit(0))
    row = pairs.agg(F.count(F.lit(1)).alias("_n"), *[sketch(s).alias(f"_{i}") for i, s in enumerate(simple)]).first()
    return {"": row["_n"], **{s: row[f"_{i}"] for i, s in enumerate(simple)}}


def best_lookup(pairs: DataFrame, inputs: list[str], target: str, column: str, sizes: dict[str, int] | None = None) -> Rule | None:
    """The lookup that most rows follow, learned from the whole batch; of equal ones that with the fewest keys.

    One aggregate estimates how often each source repeats, one shuffle counts the pairs of value and
    output of those that may. A lookup with an entry for every second row or more has only memorised.
    """
    if pairs.schema[column].dataType.typeName() in _DEEP:
        return None
    sizes = sizes or source_sizes(pairs, inputs)
    n = sizes[""]
    slack = 1.2  # the estimate is within 5 % nearly always; the exact count decides below
    repeating = [s for s in inputs if s in sizes and 2 <= slack * sizes[s] and (sizes[s] <= slack * MEMORISED * n or n < LEAST)]
    if not repeating or not n:
        return None
    long = pairs.select(F.col(f"`{column}`").alias("output"), F.explode(F.array(*[F.struct(F.lit(s).alias("by"), leaf(pairs, s).cast("string").alias("source")) for s in repeating])).alias("x")).select("x.by", "x.source", "output")
    top = _dominant(long.where("source IS NOT NULL"), ["by", "source"])
    sums = top.groupBy("by").agg(F.count(F.lit(1)).alias("k"), F.sum("agree").alias("m")).where("k >= 2").collect()  # a row for each source
    sums = [r for r in sums if n < LEAST or r["k"] < MEMORISED * n]
    if not sums:
        return None
    best = min(sums, key=lambda r: (-r["m"], r["k"], -affinity(r["by"], target), r["by"]))
    table = top.where(F.col("by") == best["by"]).select("source", "output")
    grade = _STATUS[_grade(best["m"], n)]
    if best["k"] > LITERAL:
        return Rule(target, Op("valueMap", target, {"source": best["by"], "keys": best["k"]}), grade, best["m"], n, table)
    entries = {r["source"]: r["output"] for r in table.collect()}  # at most LITERAL
    return Rule(target, Op("valueMap", target, {"source": best["by"], "map": entries}), grade, best["m"], n)


def _dominant(long: DataFrame, by: list[str]) -> DataFrame:
    """by, the commonest output, rows, rows that agree; groups with a tie or without an output are left out."""
    counts = long.groupBy(*by, "output").agg(F.count(F.lit(1)).alias("agree"))
    window = Window.partitionBy(*by)
    ranked = counts.withColumn("rows", F.sum("agree").over(window)).withColumn("_rank", F.rank().over(window.orderBy(F.desc("agree")))).where("_rank = 1")
    return ranked.withColumn("_tied", F.count(F.lit(1)).over(window)).where("_tied = 1 AND output IS NOT NULL").select(*by, "output", "rows", "agree")


def saved(rule: Rule, path: str) -> Op:
    """The rule's operator; a large lookup's table is written to ``path``, which the operator then names."""
    if rule.table is None:
        return rule.op
    rule.table.write.mode("overwrite").parquet(path)
    return Op("valueMap", rule.target, {"source": rule.op.params["source"], "table": path})


def conflicts(df: DataFrame, inputs: list[str], output: str) -> DataFrame:
    """Inputs that come with more than one output."""
    distinct = df.select(*inputs, F.col(output).alias("_o")).distinct()
    return distinct.groupBy(*inputs).agg(F.count(F.lit(1)).alias("outputs")).where("outputs > 1")


def memorisation(df: DataFrame, sources: list[str]) -> DataFrame:
    """source, distinct, rows, memorised: whether a lookup by it would only memorise."""
    long = df.select(*[F.col(s).cast("string").alias(s) for s in sources]).unpivot([], sources, "source", "value").where("value is not null")
    g = long.groupBy("source", "value").agg(F.count(F.lit(1)).alias("_n")).groupBy("source").agg(F.count(F.lit(1)).alias("distinct"), F.sum("_n").alias("rows"))
    return g.select("source", "distinct", "rows", ((F.col("rows") >= LEAST) & (F.col("distinct") >= MEMORISED * F.col("rows"))).alias("memorised"))


def domain_guards(df: DataFrame, inputs: list[str], output: str) -> DataFrame:
    """Inputs whose presence always goes with the output's (8 or more rows present)."""
    n = df.agg(*[F.min((F.col(i).isNotNull() == F.col(output).isNotNull()).cast("int")).alias(i) for i in inputs], F.count(output).alias("_present"))
    return n.unpivot(["_present"], inputs, "guard", "_same").where((F.col("_same") == 1) & (F.col("_present") >= LEAST)).select("guard", F.col("_present").alias("rows"))


def drift(before: DataFrame, after: DataFrame, used: list[str]) -> DataFrame:
    """path, drift: blocking if a used field changed or went, else advisory."""
    spark = before.sparkSession
    shape = lambda d, n: spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in d.schema.fields], f"path string, {n} string")
    both = shape(before, "was").join(shape(after, "now"), "path", "full").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("path", "was", "now", F.when(F.col("path").isin(used) & F.col("was").isNotNull(), "blocking").otherwise("advisory").alias("drift"))
