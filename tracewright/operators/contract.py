"""Transformation contracts: schema, invariants, run and check, mutations, lifecycle."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.values import iso_date
from tracewright.operators.compare import rows_keyed
from tracewright.operators.documents import Shape, nodes, shape_of_rows, violations
from tracewright.operators.infer import Rule, infer
from tracewright.plans.program import Op, at, compiled, diagnostics, nested, parse_path

#: Verdicts in ascending severity.
VERDICTS = ("pass", "warn", "quarantine", "block", "invalid_contract")


@dataclass
class Contract:
    """A program with what its input and output must be."""

    program: list[Op]
    required: dict[str, str] = field(default_factory=dict)  # input field -> Spark type
    invariants: list[dict[str, Any]] = field(default_factory=list)
    policy: str = "quarantine"  # what a blocking diagnostic does to a row: quarantine, block, warn
    warnings_allowed: int = 0
    key: list[str] = field(default_factory=list)
    status: str = "draft"  # draft, review_required, approved, superseded, revoked
    approved: str | None = None
    input: Shape | None = None  # what learned inputs looked like; unknown fields are allowed
    output: Shape | None = None  # what outputs must look like; unknown fields are refused

    def to_json(self) -> str:
        d = {"program": [op.to_dict() for op in self.program], "required": self.required, "invariants": self.invariants, "policy": self.policy, "warnings_allowed": self.warnings_allowed, "key": self.key, "status": self.status, "approved": self.approved}
        return json.dumps({**d, "input": self.input and self.input.to_dict(), "output": self.output and self.output.to_dict()}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Contract:
        d = json.loads(text)
        program = [Op(o.pop("op"), o.pop("target"), o) for o in d.pop("program")]
        return cls(program, input=Shape.from_dict(d.pop("input", None)), output=Shape.from_dict(d.pop("output", None)), **d)

    def fingerprint(self) -> str:
        """Of what the contract does; its approval is not part of it."""
        core = {"program": [op.to_dict() for op in self.program], "required": self.required, "invariants": self.invariants, "policy": self.policy, "key": self.key, "warnings": self.warnings_allowed}
        return hashlib.sha256(("contract\0" + json.dumps(core, sort_keys=True)).encode()).hexdigest()[:16]

    def approve(self, fingerprint: str) -> Contract:
        """Approval names the exact fingerprint it is given for."""
        if fingerprint != self.fingerprint():
            raise ValueError("the contract is not the one acknowledged")
        self.status, self.approved = "approved", fingerprint
        return self

    def revoke(self) -> Contract:
        self.status = "revoked"
        return self

    def problems(self) -> list[str]:
        """Why it cannot run; empty if it can."""
        out = [] if self.program else ["no program"]
        out += [f"unknown invariant {i['kind']}" for i in self.invariants if i["kind"] not in (*RECORD, *BATCH, *SHAPE)]
        declared = [set(i["fields"]) for i in self.invariants if i["kind"] in SHAPE and "fields" in i]
        out += [f"unknown output field {t}" for d in declared for t in sorted({op.target.split(".")[0].split("[")[0] for op in self.program} - d)]
        out += [f"policy {self.policy}"] if self.policy not in ("quarantine", "block", "warn") else []
        if self.status in ("superseded", "revoked"):
            out.append(f"is {self.status}")
        if self.status == "approved" and self.approved != self.fingerprint():
            out.append("changed after approval")
        return out


#: Record invariants: a Column that holds for good rows. Input is ``i``, output ``o``.
RECORD = {
    "required_path": lambda p: at(p["path"]).isNotNull(),
    "output_path_present": lambda p: F.col(f"_o.{p['path']}").isNotNull(),
    "output_path_absent": lambda p: F.col(f"_o.{p['path']}").isNull(),
    "source_path_preserved": lambda p: F.col(f"_o.{p['target']}").eqNullSafe(at(p["source"])),
    "output_equals_source": lambda p: F.col(f"_o.{p['target']}").cast("string").eqNullSafe(at(p["source"]).cast("string")),
    "allowed_values": lambda p: F.coalesce(F.col(f"_o.{p['path']}").isin(p["values"]), F.lit(False)),
    "string_pattern": lambda p: F.coalesce(F.col(f"_o.{p['path']}").rlike(p["pattern"]), F.lit(False)),
    "path_type": lambda p: F.col(f"_o.{p['path']}").isNull() | F.col(f"_o.{p['path']}").cast("string").try_cast(p["type"]).isNotNull(),
    "no_unresolved_values": lambda p: F.coalesce(~F.col(f"_o.{p['path']}").cast("string").rlike(r"^\[(missing|unresolved|invalid|conflict)"), F.lit(True)),
}
#: Invariants of the output's shape, of the whole batch, and the record ones above.
SHAPE = ("no_unknown_output_fields",)
BATCH = ("row_count_preserved", "key_set_preserved", "key_unique", "no_duplicate_output_keys", "maximum_failed_records", "maximum_failed_percent")


def infer_required(df: DataFrame) -> dict[str, str]:
    """Fields that every row has, with their types: one aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return {f.name: f.dataType.simpleString() for f in df.schema.fields if row["_n"] and row[f.name] == row["_n"]}


@dataclass
class Learned:
    """A learned contract, the rules it is made of, and the targets that have none."""

    contract: Contract
    rules: list[Rule]
    unexplained: list[str]


def learn(original: DataFrame, transformed: DataFrame, on: list[str], policy: str = "quarantine") -> Learned:
    """A contract from aligned examples: its program, what it needs of its input, schemas and invariants.

    Rules are learned for every leaf of the output, nested ones and arrays too. The input needs the
    paths that the rules read and that no example lacks. Schemas are unions over all examples; texts of
    few values are listed. Invariants are those of the output that every example meets. A target
    without a rule, one that holds on almost all rows only, or a lookup too large to be written into
    the program, makes the contract one for review.
    """
    from tracewright.operators.verify import aligned_paths  # verification itself runs contracts' rules

    pairs, inputs, outputs = aligned_paths(original, transformed, on)
    pairs = pairs.persist()
    try:
        rules = infer(pairs, inputs, outputs)
        good = [r for r in rules if r.op and r.status in ("exact", "dominant") and r.table is None]
        program = [r.op for r in good]
        used = sorted({s for op in program for s in op.sources()})
        shown = pairs.select(*[at(p).alias(f"_{i}") for i, p in enumerate(used)])
        row = shown.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"_{i}").alias(f"c{i}") for i in range(len(used))]).first()
        required = {p: shown.schema[f"_{i}"].dataType.simpleString() for i, p in enumerate(used) if row[f"c{i}"] == row["n"]}
        whole = lambda df, **more: shape_of_rows(df, [c for c in df.columns if c not in on], **more)
        contract = Contract(program, required, key=list(on), policy=policy, input=whole(original), output=whole(transformed, values=True))
        contract.invariants = suggested(contract, original) + [{"kind": "row_count_preserved"}, {"kind": "key_set_preserved"}, {"kind": "key_unique"}] if program else []
        unexplained = [r.target for r in rules if r not in good]
        if unexplained or any(r.status != "exact" for r in good):
            contract.status = "review_required"
        return Learned(contract, rules, unexplained)
    finally:
        pairs.unpersist()


def schema_violations(contract: Contract, df: DataFrame, side: str = "input") -> DataFrame:
    """The key, ``at``, ``problem`` of each place where rows differ from the learned schema."""
    key = [F.col(f"`{c}`") for c in contract.key]
    docs = df.select(*key, F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in contract.key]).alias("_doc"))
    return violations(nodes(docs, contract.key, "_doc"), contract.key, getattr(contract, side) or Shape(), closed=side == "output")


def _failed(contract: Contract, missing: list[str]) -> Column:
    checks = [F.when(at(c).isNull(), F.lit(f"required:{c}")) for c in contract.required if c not in missing]
    checks += [F.lit(f"required:{c}") for c in missing]
    checks += [F.when(~RECORD[i["kind"]](i), F.lit(f"{i['kind']}:{i.get('path', i.get('target', ''))}")) for i in contract.invariants if i["kind"] in RECORD]
    if not checks:
        return F.array().cast("array<string>")
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def run(contract: Contract, df: DataFrame) -> DataFrame:
    """The key, ``output``, ``failed``, ``advice`` and ``status`` (passed, warned, quarantined, blocked) of every row.

    One projection without a shuffle, so it works on streams too. A contract with problems is
    refused before data is read.
    """
    if contract.problems():
        raise ValueError("invalid_contract: " + "; ".join(contract.problems()))
    missing = [c for c in contract.required if str(parse_path(c)[0]) not in df.columns]
    x = df.withColumn("_o", F.struct(*nested({op.target: compiled(op) for op in contract.program})))
    x = x.withColumn("_f", _failed(contract, missing)).withColumn("_d", diagnostics(contract.program))
    hard = {"block": "blocked", "warn": "warned", "quarantine": "quarantined"}[contract.policy]
    status = F.when(F.size("_f") > 0, hard).when(F.size("_d") > contract.warnings_allowed, "warned").otherwise("passed")
    return x.select(*contract.key, F.col("_o").alias("output"), F.col("_f").alias("failed"), F.transform("_d", lambda d: F.concat_ws(":", d["code"], d["path"])).alias("advice"), status.alias("status"))


def batch_report(contract: Contract, df: DataFrame, ran: DataFrame) -> DataFrame:
    """One row: input, passed, warned, quarantined, blocked, broken (batch invariants) and the verdict."""
    n = ran.agg(F.count(F.lit(1)).alias("input"), *[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "warned", "quarantined", "blocked")])
    dup = ran.groupBy(*contract.key).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("_dup")) if contract.key else None
    n = n.crossJoin(dup) if dup is not None else n.withColumn("_dup", F.lit(0))
    kinds = {i["kind"] for i in contract.invariants}
    n = n.crossJoin(df.agg(F.count(F.lit(1)).alias("_source"))) if "row_count_preserved" in kinds else n.withColumn("_source", F.col("input"))
    if "key_set_preserved" in kinds and contract.key:  # one full join of the keys' counts
        left, right = (d.groupBy(*contract.key).agg(F.count(F.lit(1)).alias(c)) for d, c in ((df, "_a"), (ran, "_b")))
        n = n.crossJoin(left.join(right, contract.key, "full").agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("_keys")))
    else:
        n = n.withColumn("_keys", F.lit(0))
    failed = F.col("quarantined") + F.col("blocked")
    rules = []
    for i in contract.invariants:
        test = {"maximum_failed_records": lambda: failed > i["value"], "maximum_failed_percent": lambda: failed * 100 > i["value"] * F.col("input"), "row_count_preserved": lambda: F.col("input") != F.col("_source"), "key_set_preserved": lambda: F.col("_keys") > 0, "key_unique": lambda: F.col("_dup") > 0, "no_duplicate_output_keys": lambda: F.col("_dup") > 0}.get(i["kind"])  # noqa: B023
        if test:
            rules.append(F.when(test(), F.lit(i["kind"])))
    broken = F.filter(F.array(*rules), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    verdict = F.when((F.col("blocked") > 0) | (F.size("broken") > 0), "block").when(F.col("quarantined") > 0, "quarantine").when(F.col("warned") > 0, "warn").otherwise("pass")
    return n.withColumn("broken", broken).withColumn("verdict", verdict).withColumn("broken", F.array_join("broken", ",")).drop("_dup", "_source", "_keys")


def check_paths(contract: Contract, df: DataFrame, actual: DataFrame) -> DataFrame:
    """The key, ``path``, ``expected``, ``found`` of each leaf where actual rows differ from the program's output.

    A row that only one side has is one difference at ``$``. Records are gone into; arrays are compared
    whole, as JSON.
    """
    from tracewright.operators.verify import leaves

    expected = run(contract, df).select(*contract.key, "output")
    fields = [c for c in actual.columns if c not in contract.key]
    found = actual.select(*[F.col(f"`{k}`") for k in contract.key], F.struct(*[F.col(f"`{c}`") for c in fields]).alias("_actual"))
    both = expected.join(found, contract.key, "full")
    sides = [(leaves(both.schema[c].dataType), c) for c in ("output", "_actual")]
    paths = list(dict.fromkeys([*sides[0][0], *sides[1][0]]))
    show = lambda side, p: _text(at(p, F.col(side[1])), both) if p in side[0] else F.lit(None).cast("string")
    row = lambda path, a, b: F.struct(F.lit(path).alias("path"), a.alias("expected"), b.alias("found"))
    there, here = F.col("output").isNotNull(), F.col("_actual").isNotNull()
    diffs = [F.when(there & here & ~show(sides[0], p).eqNullSafe(show(sides[1], p)), row(p, show(sides[0], p), show(sides[1], p))) for p in paths]
    one = F.when(~(there & here), row("$", F.when(there, "row"), F.when(here, "row")))
    each = F.explode(F.filter(F.array(one, *diffs), lambda d: d.isNotNull())).alias("_d")
    return both.select(*contract.key, each).select(*contract.key, "_d.path", "_d.expected", "_d.found")


def _text(value: Column, df: DataFrame) -> Column:
    """A value as text: numbers without trailing zeros, arrays and maps as JSON."""
    deep = df.select(value.alias("v")).schema["v"].dataType.typeName() in ("array", "map")
    return F.to_json(value) if deep else F.regexp_replace(value.cast("string"), r"\.0+$", "")


def check(contract: Contract, df: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected against actual by key: status and differing fields of each row."""
    expected = run(contract, df).select(*contract.key, "output.*")
    found = rows_keyed(expected, actual.select(*[c for c in expected.columns if c in actual.columns]), contract.key)
    more = [c for c in actual.columns if c not in expected.columns]
    if not more or not any(i["kind"] in SHAPE for i in contract.invariants):
        return found
    there = F.col("status").isin("unchanged", "changed")
    fields = F.when(there, F.concat_ws(",", F.when(F.col("fields") != "", F.col("fields")), *[F.lit(f"unknown:{c}") for c in more])).otherwise(F.col("fields"))
    return found.withColumn("fields", fields).withColumn("status", F.when(there, "changed").otherwise(F.col("status")))


def row_ids(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``row_id``: the key, with a number from the second of equal keys on."""
    by = Window.partitionBy(*key)
    n = F.row_number().over(by.orderBy(*order))
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    return df.withColumn("row_id", F.when(n > 1, F.concat(text, F.lit("#"), n.cast("string"))).otherwise(text))


def suggested(contract: Contract, sample: DataFrame, most: int = 12) -> list[dict[str, Any]]:
    """Invariants that the sample's output meets: presence, allowed values of small domains."""
    ran = run(contract, sample).select("output.*")
    ran = ran.select(*[c for c, t in ran.dtypes if not t.startswith(("array", "struct", "map"))])
    if not ran.columns:
        return []
    n = ran.count()
    stats = ran.agg(*[F.struct(F.count(c).alias("n"), F.approx_count_distinct(c).alias("d")).alias(c) for c in ran.columns]).first()
    out = []
    for c in ran.columns:
        if stats[c]["n"] == n and n:
            out.append({"kind": "output_path_present", "path": c})
        if dict(ran.dtypes)[c] == "string" and stats[c]["d"] <= most:
            out.append({"kind": "allowed_values", "path": c, "values": sorted(r[0] for r in ran.where(F.col(c).isNotNull()).select(c).distinct().collect())})
    return out


def mutations(contract: Contract, df: DataFrame) -> DataFrame:
    """mutation, target, rows, changed, detected: what is changed on purpose, and where the invariants notice.

    Each target is removed, changed in case, scaled or retyped in every row, a date written in another order,
    an array turned around, and two targets of one type are swapped; a changed row is detected if a record invariant fails that held before. The
    batch loses a row and repeats one; that is detected if a batch invariant breaks. Mutations that
    no invariant notices stay in the result with ``detected`` 0.
    """
    missing = [c for c in contract.required if str(parse_path(c)[0]) not in df.columns]
    x = df.withColumn("_o", F.struct(*nested({op.target: compiled(op) for op in contract.program})))
    x = x.withColumn("_before", _failed(contract, missing))
    fields = x.schema["_o"].dataType.fields
    kinds = {f.name: f.dataType.simpleString() for f in fields}
    whole = lambda **new: F.struct(*[new.get(f.name, F.col(f"_o.{f.name}")).alias(f.name) for f in fields])
    made = []
    for t, kind in kinds.items():
        v = F.col(f"_o.{t}")
        made.append(("remove", t, whole(**{t: F.lit(None).cast(kind)})))
        if kind == "string":
            made.append(("case", t, whole(**{t: F.when(F.upper(v) != v, F.upper(v)).otherwise(F.lower(v))})))
            made.append(("retype", t, whole(**{t: F.xxhash64(v).cast("string")})))
        if kind in ("double", "bigint", "int"):
            made.append(("unit", t, whole(**{t: (v * 100).cast(kind)})))
        if kind == "string" and any(op.target == t and (op.kind == "dateFormat" or op.params.get("mode") == "dateNormalize") for op in contract.program):
            made.append(("date_format", t, whole(**{t: F.coalesce(F.date_format(iso_date(v), "dd/MM/yyyy"), v)})))
        if kind.startswith("array"):
            made.append(("array_order", t, whole(**{t: F.reverse(v)})))
    for a, b in ((a, b) for a in kinds for b in kinds if a < b and kinds[a] == kinds[b]):
        made.append(("swap", f"{a},{b}", whole(**{a: F.col(f"_o.{b}"), b: F.col(f"_o.{a}")})))
    each = F.array(*[F.struct(F.lit(m).alias("mutation"), F.lit(t).alias("target"), o.alias("o"), (~o.eqNullSafe(F.col("_o"))).alias("changed")) for m, t, o in made])
    wide = x.withColumn("_m", F.explode(each)).withColumn("_o", F.col("_m.o"))
    wide = wide.withColumn("_new", F.size(F.array_except(_failed(contract, missing), "_before")) > 0)
    rows = wide.groupBy(F.col("_m.mutation").alias("mutation"), F.col("_m.target").alias("target")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("_m.changed").alias("changed"), F.count_if(F.col("_m.changed") & F.col("_new")).alias("detected"))
    ran = run(contract, df)
    held = batch_report(contract, df, ran).select(F.col("broken").alias("_held"))
    for name, other in (("drop_row", _without_one(ran, contract.key)), ("duplicate_key", ran.unionByName(ran.limit(1)))):
        seen = batch_report(contract, df, other).crossJoin(held).select(F.lit(name).alias("mutation"), F.lit("").alias("target"), F.lit(1).cast("long").alias("rows"), F.lit(1).cast("long").alias("changed"), (F.col("broken") != F.col("_held")).cast("long").alias("detected"))
        rows = rows.unionByName(seen)
    return rows


def _without_one(ran: DataFrame, key: list[str]) -> DataFrame:
    """All rows but one of the smallest key."""
    first = ran.agg(F.min(F.struct(*key)).alias("_first"))
    marked = ran.crossJoin(first).withColumn("_is", F.struct(*key).eqNullSafe(F.col("_first"))).drop("_first")
    again = marked.where("_is").withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("status"))).where("_n > 1").drop("_n")
    return marked.where("NOT _is").unionByName(again).drop("_is")


def differences(old: Contract, new: Contract) -> list[dict[str, str]]:
    """What changed between two contracts, and whether it breaks users."""
    out = []
    a, b = {o.target: o.to_dict() for o in old.program}, {o.target: o.to_dict() for o in new.program}
    for t in sorted(a.keys() | b.keys()):
        if a.get(t) != b.get(t):
            out.append({"part": f"program:{t}", "change": "added" if t not in a else "removed" if t not in b else "changed", "effect": "reapproval" if t not in a else "breaking"})
    for c in sorted(old.required.keys() | new.required.keys()):
        if old.required.get(c) != new.required.get(c):
            out.append({"part": f"input:{c}", "change": "changed", "effect": "breaking" if c in new.required else "compatible"})
    if old.invariants != new.invariants:
        out.append({"part": "invariants", "change": "changed", "effect": "reapproval"})
    if old.policy != new.policy:
        out.append({"part": "policy", "change": "changed", "effect": "reapproval"})
    return out
