"""Consensus search: which rules explain a target that no single rule explains on almost all rows.

Small random samples suggest rules (most samples of a few rows hold no bad row), and every suggestion
of every sample is counted over the whole batch together. The best one is fitted again on rows that
conform to it. What the winner leaves over is searched the same way, up to three rules.

Samples are the rows with the smallest hash of a seed and the row's key: they do not depend on
partitions or order, and one pass finds those of all seeds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.infer import LEAST, NEAR, Rule, agrees, best_lookup, examples, interpreted, matches_rule, proposals, roots, supports

#: Rows of a sample, samples, fits on conforming rows, rules of a target.
SEED_SIZE, RESTARTS, REFITS, MOST_CLUSTERS = 6, 12, 2, 3
#: Rules that follow how often values come, and so hold on a majority of any skewed column: they need ``NEAR`` of the rows.
BY_CHANCE = ("constant", "valueMap", "conditional")
#: Conforming rows that a refit reads, and first rows that suggest rules too.
REFIT_ROWS, PREFIX = 200, 5


@dataclass
class Cluster:
    """A rule, the rows that follow it, and their share of the batch."""

    rule: Rule
    support: int
    share: float

    def signature(self) -> str:
        return f"{' + '.join(self.rule.op.sources())} → {self.rule.target}" if self.rule.op else self.rule.target


@dataclass
class Consensus:
    """What a search found for a target: ``verdict`` is consistent, inconsistent or unverifiable."""

    target: str
    rows: int
    verdict: str
    clusters: list[Cluster] = field(default_factory=list)
    unexplained: int = 0

    @property
    def main(self) -> Cluster | None:
        return self.clusters[0] if self.clusters else None


def reservoirs(df: DataFrame, key: list[str], seeds: int = RESTARTS, size: int = SEED_SIZE, rows: int | None = None) -> DataFrame:
    """``seed``, ``place`` and all columns of ``df``: for each seed the ``size`` rows of smallest hash.

    A row's hash is of the seed and its key, so rows with one key are taken together or in any order.
    Only rows below a bound that leaves about ``8 * size`` rows a seed are ranked; where fewer are
    left than must be, the bound is doubled.
    """
    n = df.count() if rows is None else rows
    want, share = min(size, n), min(1.0, 8 * size / max(n, 1))
    while True:
        draw = lambda s: F.shiftrightunsigned(F.xxhash64(F.lit(s), *[F.col(f"`{k}`") for k in key]), 11) / float(1 << 53)  # noqa: B023, E731
        drawn = F.filter(F.array(*[F.struct(F.lit(s).alias("seed"), draw(s).alias("draw")) for s in range(seeds)]), lambda x: x["draw"] < share)  # noqa: B023
        below = df.withColumn("_drawn", drawn).where(F.size("_drawn") > 0).select(F.explode("_drawn").alias("_d"), *df.columns)
        place = F.row_number().over(Window.partitionBy("_d.seed").orderBy("_d.draw", *[F.col(f"`{k}`") for k in key]))
        out = below.withColumn("place", place).where(F.col("place") <= size).select(F.col("_d.seed").alias("seed"), "place", *df.columns)
        if share >= 1:
            return out
        fewest = out.groupBy("seed").count().agg(F.min("count"), F.count(F.lit(1))).first()
        if fewest[1] == seeds and fewest[0] >= want:
            return out
        share = min(1.0, 2 * share)


def search(pairs: DataFrame, key: list[str], inputs: list[str], target: str, column: str) -> Rule | None:
    """The rule that most rows of ``pairs`` follow, whatever their share; constants and lookups only from four of five rows on."""
    columns = list(dict.fromkeys([*key, *roots(pairs, inputs), column]))
    slim = pairs.select(*[F.col(f"`{c}`") for c in columns])
    n = slim.count()
    if n < 2:
        return None
    size = min(SEED_SIZE, max(2, -(-n // 2)))
    by_seed: dict[int, list] = {}
    for r in reservoirs(slim, key, size=size, rows=n).collect():  # RESTARTS * SEED_SIZE rows
        by_seed.setdefault(r["seed"], []).append(r)
    by_seed[-1] = slim.orderBy(*[F.col(f"`{k}`") for k in key]).limit(min(PREFIX, max(2, -(-n // 2)))).collect()
    tests: dict[str, tuple] = {}
    for rows in by_seed.values():
        for op in proposals(examples(rows, inputs, column), inputs, target):
            tests.setdefault(repr(op), (column, op))
    drawn = [tuple(r[c] for c in columns) for rows in by_seed.values() for r in rows]
    sample = interpreted(slim, drawn)
    # a rule that explains a third of the batch holds on some sample rows
    found = [t for t, (m, _) in zip(tests.values(), supports(sample, list(tests.values()), 300), strict=True) if m >= 2]
    ranked = _counted(slim, found, target)
    for _ in range(REFITS - 1):
        more = _refitted(slim, ranked[:2], key, inputs, target, column, {repr(r.op) for r in ranked})
        ranked = sorted(ranked + _counted(slim, more, target), key=_order)
    mapped = best_lookup(slim, inputs, target, column)
    every = sorted([*ranked, *([mapped] if mapped else [])], key=_order)
    return next((r for r in every if r.matches and (r.op.kind not in BY_CHANCE or r.matches >= NEAR * n)), None)


def _order(rule: Rule):
    return -rule.matches, rule.cost, repr(rule.op)


def _counted(df: DataFrame, tests: list[tuple], target: str) -> list[Rule]:
    counts = supports(df, tests)
    return sorted((Rule(target, op, "majority", m, n) for (_, op), (m, n) in zip(tests, counts, strict=True)), key=_order)


def _refitted(df: DataFrame, best: list[Rule], key: list[str], inputs: list[str], target: str, column: str, known: set[str]) -> list[tuple]:
    """Suggestions of rows that conform to the best rules."""
    out: dict[str, tuple] = {}
    for rule in best:
        conforming = df.where(agrees(column, rule.op, df))
        rows = conforming.orderBy(F.xxhash64(*[F.col(f"`{k}`") for k in key])).limit(REFIT_ROWS).collect()
        for op in proposals(examples(rows, inputs, column), inputs, target):
            if repr(op) not in known:
                out.setdefault(repr(op), (column, op))
    return list(out.values())


def consensus(pairs: DataFrame, key: list[str], inputs: list[str], target: str, column: str) -> Consensus:
    """Up to three rules that together explain a target, and the verdict of the majority.

    The rule that more than half of the rows follow is the batch's: the others contradict it. If several
    rules are found and none has the majority, the batch is unverifiable and nobody is accused; a
    tie has no majority. ``pairs`` is read several times: it should be kept or cached.
    """
    total = pairs.count()
    out, rest, left = Consensus(target, total, "unverifiable"), pairs, total
    while left >= 2 and len(out.clusters) < MOST_CLUSTERS:
        rule = search(rest, key, inputs, target, column)
        if not rule or rule.matches < min(LEAST, total):
            break
        out.clusters.append(Cluster(rule, rule.matches, round(rule.matches / total, 4)))
        rest = matches_rule(rest, rule, column).where("NOT _same").drop("_same")
        left -= rule.matches
    out.clusters.sort(key=lambda c: -c.support)
    out.unexplained = left
    if out.main and 2 * out.main.support > total:
        out.verdict = "consistent" if out.main.support == total else "inconsistent"
    return out


def table(spark, found: list[Consensus]) -> DataFrame:
    """A row for each rule found: target, verdict, rank, op, signature, support, share, unexplained."""
    rows = [(c.target, c.verdict, i + 1, k.rule.op.kind, k.signature(), k.support, k.share, c.unexplained) for c in found for i, k in enumerate(c.clusters)]
    return spark.createDataFrame(rows, "target string, verdict string, rank int, op string, signature string, support long, share double, unexplained long")
