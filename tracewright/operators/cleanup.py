"""What inputs should be cleaned of before rules are learned, and what a program changes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import values as V
from tracewright.operators.matching import words
from tracewright.plans.program import Op, at, compiled, nested

#: Names of measures, of codes that stay texts, of lists, and of what is no list.
MEASURES = frozenset("age amount balance count height latitude length lng longitude percent percentage price quantity qty rate score total weight width".split())
CODES = frozenset("id ids uuid guid sku zip zipcode postal postcode phone tel mobile fax account acct iban isbn ssn tax vat ein routing barcode serial code hash number".split())
LISTS = frozenset("categories emails features interests items keywords labels roles skills tags topics urls values".split())
NO_LISTS = frozenset("address city country description location name status title".split())

_DATE = r"^\d{4}-\d{2}-\d{2}([T\s]\d{2}:\d{2})?|^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"


@dataclass
class Suggestion:
    """A text field whose every value could be a number, a boolean or a list."""

    kind: str  # coerce-number, coerce-boolean, split-array
    path: str
    values: int
    separator: str | None = None


def suggestions(df: DataFrame) -> list[Suggestion]:
    """Suggestions for text fields, nested ones too: one aggregate over all rows; a single value that does not fit is enough against one."""
    from tracewright.operators.verify import leaves

    paths = [p for p in leaves(df.schema) if df.select(at(p).alias("v")).schema["v"].dataType.typeName() == "string"]
    if not paths:
        return []
    shown = df.select(*[V.trimmed(at(p)).alias(f"_{i}") for i, p in enumerate(paths)])
    tests = []
    for i in range(len(paths)):
        c = F.col(f"_{i}")
        filled = c != ""
        number = c.rlike(r"^-?\d+(\.\d+)?$") & ~c.rlike(r"^-?0\d") & ~c.rlike(r"^-?\d{16,}$")
        tests += [F.count_if(filled).alias(f"n{i}"), F.count_if(filled & number).alias(f"d{i}"), F.count_if(F.lower(c).isin("true", "false")).alias(f"b{i}")]
        for name, sep in (("s", ";"), ("c", ",")):
            parts = F.filter(V.split_at(c, sep), lambda x: V.trimmed(x) != "")
            listed = c.contains(sep) & (F.size(parts) >= 2) & ~c.contains("\n") & ~c.rlike(_DATE)
            tests += [F.count_if(filled & listed).alias(f"{name}{i}"), F.min(F.when(filled, F.size(parts))).alias(f"{name}m{i}")]
    row = shown.agg(*tests).first()
    out = []
    for i, p in enumerate(paths):
        n, names = row[f"n{i}"], words(p)
        last = names[-1] if names else ""
        if not n:
            continue
        if row[f"d{i}"] == n and (MEASURES & set(names) or not (CODES & set(names) or re.search(r"id$", last))):
            out.append(Suggestion("coerce-number", p, n))
        elif row[f"b{i}"] == n:
            out.append(Suggestion("coerce-boolean", p, n))
        else:
            for name, sep in (("s", ";"), ("c", ",")):
                listed = bool(LISTS & set(names)) or (not NO_LISTS & set(names) and (row[f"{name}m{i}"] >= 3 or (last.endswith("s") and len(last) > 3)))
                if row[f"{name}{i}"] == n and listed:
                    out.append(Suggestion("split-array", p, n, sep))
                    break
    return out


def cleaned(df: DataFrame, found: list[Suggestion]) -> DataFrame:
    """``df`` with the suggested fields converted; empty texts of numbers and booleans become null. One projection."""
    from tracewright.operators.verify import leaves

    by_path = {s.path: s for s in found}

    def value(path: str) -> Column:
        c = at(path)
        s = by_path.get(path)
        if s is None:
            return c
        if s.kind == "coerce-number":
            return V.number(c)
        if s.kind == "coerce-boolean":
            return V.boolean(F.lower(V.trimmed(c)))
        return F.filter(F.transform(V.split_at(c, s.separator), V.trimmed), lambda x: x != "")

    return df.select(*nested({p: value(p) for p in leaves(df.schema)}))


def ledger(df: DataFrame, program: list[Op], key: str) -> DataFrame:
    """target, op, effect, rows, changed, empty, example_key, before, after: what each operator does to all rows.

    The effect is moved (no value differs from the source), changed, computed (several sources) or new
    (none). ``changed`` counts rows whose value differs from the first source's, ``empty`` rows without a
    value; the example is the smallest key that changed.
    """
    text = lambda c, df=df: F.to_json(F.struct(c.alias("v")))
    shown = df.select(F.col(f"`{key}`").alias("_k"), *[x for i, op in enumerate(program) for x in (text(compiled(op)).alias(f"a{i}"), (text(at(op.sources()[0])) if op.sources() else F.lit(None).cast("string")).alias(f"b{i}"), compiled(op).isNull().alias(f"e{i}"))])
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, op in enumerate(program):
        differs = ~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))
        aggs += [F.count_if(differs).alias(f"c{i}"), F.count_if(F.col(f"e{i}")).alias(f"e{i}"), F.min(F.when(differs, F.struct("_k", f"b{i}", f"a{i}"))).alias(f"x{i}")]
    row = shown.agg(*aggs).first()
    rows = []
    for i, op in enumerate(program):
        n = len(op.sources())
        effect = "new" if not n else "computed" if n > 1 else "moved" if not row[f"c{i}"] else "changed"
        x = row[f"x{i}"]
        rows.append((op.target, op.kind, effect, row["n"], row[f"c{i}"], row[f"e{i}"], None if x is None else str(x["_k"]), None if x is None or x[1] is None else _value(x[1]), None if x is None else _value(x[2])))
    return df.sparkSession.createDataFrame(rows, "target string, op string, effect string, rows long, changed long, empty long, example_key string, before string, after string")


def _value(shown: str | None) -> str | None:
    """The value inside ``{"v":...}``; null where it is left out."""
    return None if shown in (None, "{}") else shown.removeprefix('{"v":').removesuffix("}")
