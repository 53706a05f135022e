"""Verification: did every row of a transformed batch follow one reusable rule, and which did not."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.operators.consensus import Consensus, consensus
from tracewright.operators.infer import LEAST, Rule, agrees, infer, matches_rule, same
from tracewright.plans.program import at
from tracewright.sources.positions import POSITION, numbered


@dataclass
class Verdict:
    verdict: str  # consistent, inconsistent, unverifiable
    rules: list[Rule]
    flagged: DataFrame  # the key, and the targets that contradict
    clusters: dict[str, Consensus] = field(default_factory=dict)  # of targets that no single rule explains


def aligned(original: DataFrame, transformed: DataFrame, on: list[str]) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Pairs by key (an equi-join), the input fields, and target -> column."""
    outputs = {c: f"_t_{c}" for c in transformed.columns if c not in on}
    right = transformed.select(*[F.col(f"`{c}`") for c in on], *[F.col(f"`{c}`").alias(a) for c, a in outputs.items()])
    return original.join(right, on), [c for c in original.columns if c not in on], outputs


def leaves(schema: StructType, prefix: str = "") -> list[str]:
    """Paths of all leaves: records are gone into, arrays and maps are leaves."""
    out = []
    for f in schema.fields:
        path = (f"{prefix}." if prefix else "") + f.name if re.fullmatch(r"[A-Za-z_]\w*", f.name) else prefix + '["' + f.name.replace('"', '\\"') + '"]'
        out += leaves(f.dataType, path) if isinstance(f.dataType, StructType) else [path]
    return out


def aligned_paths(original: DataFrame, transformed: DataFrame, on: list[str]) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``aligned`` for records in records: the inputs are paths into the original, every target leaf is a column.

    ``program.run`` builds the nested output of the rules that are learned from it.
    """
    sources = [p for p in leaves(original.schema) if p not in on]
    targets = {p: f"_t_{p}" for p in leaves(transformed.schema) if p not in on}
    right = transformed.select(*[F.col(f"`{c}`") for c in on], *[at(p).alias(a) for p, a in targets.items()])
    return original.join(right, on), [*on, *sources], targets


def verify(original: DataFrame, transformed: DataFrame, on: list[str], search: bool = True) -> Verdict:
    """Learn the dominant rule of each target and flag the rows that contradict it.

    Both sides must have the same number of rows. Where no rule explains almost all rows of a target,
    a search for the rules of its majority follows (``search``): the rule of more than half of the rows
    is the batch's, and without one nobody is accused. A target without a rule, or with one that only
    memorises, is left out; if none is left the batch is unverifiable.
    """
    pairs, inputs, outputs = aligned(original, transformed, on)
    pairs = pairs.persist()
    try:
        n = pairs.count()
        if {original.count(), transformed.count()} != {n}:
            return Verdict("unverifiable", [], contradictions(pairs, on, [], outputs))
        rules, clusters = infer(pairs, [*on, *inputs], outputs), {}
        for i, rule in enumerate(rules):
            if search and rule.status in ("none", "near"):
                found = consensus(pairs, on, [*on, *inputs], rule.target, outputs[rule.target])
                clusters[rule.target] = found
                if found.verdict == "inconsistent":
                    rules[i] = found.main.rule
        known = [r for r in rules if r.op and r.status in ("exact", "dominant", "majority")]
        flagged = contradictions(pairs, on, known, outputs)
        wrong = [r for r in known if r.status != "exact"]
        if not known:
            return Verdict("unverifiable", rules, flagged, clusters)
        if any(permutation(pairs, r, outputs[r.target]) for r in wrong):
            return Verdict("unverifiable", rules, contradictions(pairs, on, [], outputs), clusters)
        return Verdict("inconsistent" if wrong else "consistent", rules, flagged, clusters)
    finally:
        pairs.unpersist()


def verify_files(original: str, transformed: str, spark, search: bool = True) -> Verdict:
    """``verify`` of two parquet tables row by row: the k-th row of one belongs to the k-th of the other."""
    return verify(numbered(spark, original), numbered(spark, transformed), [POSITION], search)


def contradictions(pairs: DataFrame, on: list[str], rules: list[Rule], outputs: dict[str, str]) -> DataFrame:
    """The key of each row that breaks a rule, and the targets it breaks."""
    key = [F.col(f"`{c}`") for c in on]
    if not rules:
        return pairs.select(*key, F.lit("").alias("targets")).limit(0)
    marks = []
    for i, r in enumerate(rules):
        if r.table is None:
            marks.append(F.when(~agrees(outputs[r.target], r.op, pairs), F.lit(r.target)))
        else:
            pairs = matches_rule(pairs, r, outputs[r.target]).withColumnRenamed("_same", f"_same_{i}")
            marks.append(F.when(~F.col(f"_same_{i}"), F.lit(r.target)))
    broken = F.filter(F.array(*marks), lambda x: x.isNotNull())
    return pairs.select(*key, broken.alias("_b")).where(F.size("_b") > 0).select(*key, F.array_join("_b", ",").alias("targets"))


def permutation(pairs: DataFrame, rule: Rule, column: str) -> bool:
    """Whether the contradicting rows only exchange values among themselves: then the pairing is in doubt."""
    from tracewright.plans.program import compiled, lookup

    if rule.table is None:
        made = pairs.withColumn("_made", compiled(rule.op))
    else:
        made = lookup(pairs, rule.op.params["source"], rule.table, "source", "output", "_made")
    off = made.where(~same(F.col("_made"), column, made)).select(F.col("_made").cast("string").alias("v"), F.col(f"`{column}`").cast("string").alias("w"))
    left = off.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    right = off.groupBy(F.col("w").alias("v")).agg(F.count(F.lit(1)).alias("m"))
    uneven = left.join(right, "v", "full").where(~F.col("n").eqNullSafe(F.col("m"))).limit(1).count()
    return off.limit(2).count() > 1 and not uneven


def dominant_inputs(df: DataFrame, inputs: list[str], output: str) -> DataFrame:
    """The majority output of each repeated input, and whether another has as many rows."""
    counts = df.groupBy(*inputs, F.col(output).alias("output")).agg(F.count(F.lit(1)).alias("rows"))
    by = Window.partitionBy(*inputs)
    top = counts.withColumn("_r", F.rank().over(by.orderBy(F.desc("rows")))).where("_r = 1").withColumn("_n", F.count(F.lit(1)).over(by))
    return top.groupBy(*inputs).agg(F.min("output").alias("output"), F.max("rows").alias("rows"), (F.max("_n") > 1).alias("tied"))


def clusters(pairs: DataFrame, target: str, column: str, inputs: list[str], most: int = 3) -> list[dict]:
    """Up to three rules that together explain a target, each learned on what the ones before left over."""
    rest, out, total = pairs, [], pairs.count()
    for _ in range(most):
        rule = infer(rest, inputs, {target: column})[0]
        if not rule.op or rule.matches < min(LEAST, total):
            break
        out.append({"op": rule.op.to_dict(), "rows": rule.matches, "share": rule.matches / total})
        rest = rest.where(~agrees(column, rule.op))
    return out


def unsafe_integers(df: DataFrame, text: str, key: str) -> DataFrame:
    """Integer literals of JSON texts beyond 2**53, which doubles cannot hold."""
    digits = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?<![\w.\"])(-?\d{16,})(?![\w.\"])"), 1)).alias("literal")
    return df.select(key, digits).where(F.abs(F.col("literal").try_cast("decimal(38,0)")) > 2**53)


def render_hazards(df: DataFrame, text: str, key: str) -> DataFrame:
    """Texts with bidirectional controls or invisible characters."""
    c = F.col(text)
    kind = F.array_compact(F.array(F.when(c.rlike(r"[‪-‮⁦-⁩]"), F.lit("bidi")), F.when(c.rlike(r"[​-‏⁠﻿­]"), F.lit("invisible"))))
    return df.select(key, kind.alias("_k")).where(F.size("_k") > 0).select(key, F.array_join("_k", ",").alias("hazards"))
