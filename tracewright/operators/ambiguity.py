"""Several rules fit the examples: whether it matters, and the row that would tell them apart.

Every rule's outputs over all rows at hand, seen and unseen, give a signature (an exclusive or and a sum
of hashes of key and output) in one aggregate. Rules with one signature are one class: they do the same
here. For the others the same job finds the smallest key on which they differ from the selected rule:
the witness, which an answer for that single row would decide.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.infer import Rule, candidates
from tracewright.plans.program import at, compiled

#: Alternatives within this cost of the selected rule are looked at; from this gap on they are weak.
CLOSE, WEAK = 0.4, 0.25


@dataclass
class Alternative:
    """A rule that fits as well as the selected one."""

    rule: Rule
    strength: str  # equivalent, resolved-by-new-input, weak, meaningful
    differs: int  # rows with another output
    witness: object = None  # the smallest key among them


@dataclass
class Triage:
    """The selected rule of a target, what else would do, and what follows.

    ``status``: safe, ambiguous, unverified (none or a memorised one), unsafe (the rule fails on rows at
    hand) or insufficient (a single example).
    """

    target: str
    selected: Rule | None
    alternatives: list[Alternative] = field(default_factory=list)
    failing: int = 0  # rows at hand that get no output
    examples: int = 0

    @property
    def status(self) -> str:
        if not self.selected or not self.selected.op or self.selected.status in ("none", "near"):
            return "unverified"
        if self.failing:
            return "unsafe"
        if any(a.strength == "meaningful" for a in self.alternatives):
            return "ambiguous"
        return "insufficient" if self.examples < 2 else "safe"


def _output(rule: Rule) -> Column:
    value = compiled(rule.op)
    number = value.try_cast("double")
    return F.when(number.isNotNull(), number.cast("string")).otherwise(value.cast("string"))


def triage(examples: DataFrame, fresh: DataFrame, key: str, inputs: list[str], outputs: dict[str, str]) -> dict[str, Triage]:
    """For each target the selected rule and its alternatives, judged on the rows of ``fresh``.

    ``examples`` has inputs and outputs; ``fresh`` has the key and the inputs, of all rows the rule is to
    run on. Rules hold on the examples alike (both on all rows, or both on almost all). Lookups too
    large for a literal map are not compared.
    """
    out = {}
    for target, rules in candidates(examples, inputs, outputs).items():
        good = [r for r in rules if r.status in ("exact", "dominant") and r.table is None]
        if not good:
            out[target] = Triage(target, rules[0] if rules else None, examples=rules[0].rows if rules else 0)
            continue
        selected = good[0]
        others = [r for r in good[1:] if r.status == selected.status and r.cost - selected.cost <= CLOSE]
        out[target] = _judged(fresh, key, selected, others)
    return out


def _judged(fresh: DataFrame, key: str, selected: Rule, others: list[Rule]) -> Triage:
    rules = [selected, *others]
    shown = fresh.select(F.col(f"`{key}`").alias("_key"), *[_output(r).alias(f"_v{i}") for i, r in enumerate(rules)])
    aggs = []
    for i in range(len(rules)):
        v, differs = F.col(f"_v{i}"), ~F.col(f"_v{i}").eqNullSafe(F.col("_v0"))
        h = F.xxhash64("_key", v)
        aggs += [F.bit_xor(h).alias(f"x{i}"), F.sum(F.shiftright(h, 20)).alias(f"t{i}"), F.count_if(differs).alias(f"d{i}"), F.min(F.when(differs, F.col("_key"))).alias(f"w{i}"), F.count_if(v.isNull()).alias(f"f{i}")]
    row = shown.agg(*aggs).first()
    found = Triage(selected.target, selected, failing=row["f0"], examples=selected.rows)
    for i, rule in enumerate(others, 1):
        if (row[f"x{i}"], row[f"t{i}"]) == (row["x0"], row["t0"]):
            strength = "equivalent"
        elif row[f"f{i}"] and not row["f0"]:
            strength = "resolved-by-new-input"
        else:
            strength = "weak" if rule.cost - selected.cost >= WEAK else "meaningful"
        found.alternatives.append(Alternative(rule, strength, row[f"d{i}"], row[f"w{i}"]))
    return found


#: The checks of confidence, in order, and the label of each number of failures that matter.
CHECKS = ("examples reproduce exactly", "no blocking guardrails", "all output paths explained", "no meaningful ambiguity", "at least two examples", "all target fields have sufficient reusable evidence")


def confidence(found: dict[str, Triage], blocking_drift: int = 0) -> dict:
    """``label``, ``passed``, ``total`` and ``failed`` checks of a program made of the selected rules."""
    all_ = list(found.values())
    passed = {
        CHECKS[0]: all(t.selected is not None and t.selected.status == "exact" for t in all_ if t.selected),
        CHECKS[1]: not blocking_drift and not any(t.failing for t in all_),
        CHECKS[2]: all(t.selected is not None and t.selected.op is not None for t in all_),
        CHECKS[3]: not any(a.strength == "meaningful" for t in all_ for a in t.alternatives),
        CHECKS[4]: all(t.examples >= 2 for t in all_),
        CHECKS[5]: not any(t.status == "unverified" for t in all_),
    }
    label = "proven"
    if not passed[CHECKS[0]]:
        label = "blocked"
    elif not passed[CHECKS[1]]:
        label = "unsafe"
    elif not passed[CHECKS[5]]:
        label = "unverified"
    elif not (passed[CHECKS[2]] and passed[CHECKS[3]] and passed[CHECKS[4]]):
        label = "needs-proof"
    return {"label": label, "passed": sum(passed.values()), "total": len(CHECKS), "failed": [c for c, ok in passed.items() if not ok]}


def preconditions(df: DataFrame, rules: list[Rule]) -> list[dict]:
    """path, types, required: what the rules need of their input; a path is required if no row lacks it."""
    paths = sorted({s for r in rules if r.op for s in r.op.sources()})
    if not paths:
        return []
    shown = df.select(*[at(p).alias(f"_{i}") for i, p in enumerate(paths)])
    row = shown.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"_{i}").alias(f"c{i}") for i in range(len(paths))]).first()
    return [{"path": p, "type": shown.schema[f"_{i}"].dataType.simpleString(), "required": row[f"c{i}"] == row["n"], "present": row[f"c{i}"], "rows": row["n"]} for i, p in enumerate(paths)]


def table(spark, found: dict[str, Triage]) -> DataFrame:
    """target, status, selected, alternative, strength, differs, witness: one row for each alternative, or for a target without."""
    rows = []
    for t in found.values():
        name = lambda r: f"{r.op.kind}({', '.join(r.op.sources())})" if r and r.op else None
        rows += [(t.target, t.status, name(t.selected), name(a.rule), a.strength, a.differs, None if a.witness is None else str(a.witness)) for a in t.alternatives] or [(t.target, t.status, name(t.selected), None, None, 0, None)]
    return spark.createDataFrame(rows, "target string, status string, selected string, alternative string, strength string, differs long, witness string")
