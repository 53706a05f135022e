"""Which source may feed which target: shared values of all column pairs, and names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.plans.program import at


def words(path: str) -> list[str]:
    """The words of a path: at separators, case changes and digits, lower case."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", path)]


def trigrams(path: str) -> set[str]:
    text = f"  {' '.join(words(path))} "
    return {text[i : i + 3] for i in range(len(text) - 2)}


def affinity(source: str, target: str) -> float:
    """0 to 1: how alike two names are, by their words (order left out) and trigrams of characters."""
    a, b = set(words(source)), set(words(target))
    if not a or not b:
        return 0.0
    by_word = len(a & b) / len(a | b)
    x, y = trigrams(source), trigrams(target)
    return max(by_word, len(x & y) / len(x | y))


def overlaps(original: DataFrame, transformed: DataFrame, sources: list[str], targets: list[str]) -> DataFrame:
    """source, target, shared, source_values, target_values: distinct values of columns, and how many two share.

    Both sides need not be aligned. Rows move as distinct values of one type, each with a bit for every column
    that holds it; only these become texts. Values with the same bits are then one row, so the pairs of columns
    are made from the few combinations there are. Values are compared as texts, numbers by value; nulls, arrays
    and records are left out.
    """
    names = [*sources, *targets]
    held = _held(((original, sources), (transformed, targets)))
    alike = held.groupBy(*_bits(len(names))).agg(F.count(F.lit(1)).alias("n"))
    of = lambda first, columns: F.array_compact(F.array(*[F.when(F.col(f"_m{i // BITS}").bitwiseAND(F.lit(1 << i % BITS)) != 0, F.lit(c)) for i, c in enumerate(columns, first)]))
    pair = lambda a, b: F.struct(a.cast("string").alias("source"), b.cast("string").alias("target"))
    none = F.lit(None)
    both = F.flatten(F.transform("s", lambda a: F.transform(F.col("t"), lambda b: pair(a, b))))
    sizes = [F.transform("s", lambda a: pair(a, none)), F.transform("t", lambda b: pair(none, b))]
    each = alike.select("n", of(0, sources).alias("s"), of(len(sources), targets).alias("t")).select("n", F.explode(F.concat(both, *sizes)).alias("p"))
    counts = each.groupBy("p.source", "p.target").agg(F.sum("n").alias("shared"))
    size = lambda x, other: F.max(F.when(F.col(other).isNull(), F.col("shared"))).over(Window.partitionBy(x)).alias(f"{x}_values")
    return counts.select("source", "target", "shared", size("source", "target"), size("target", "source")).where("source IS NOT NULL AND target IS NOT NULL")


#: Columns that one whole number has a bit for.
BITS = 62


def _bits(n: int) -> list[str]:
    return [f"_m{j}" for j in range(-(-n // BITS))]


def _held(sides) -> DataFrame:
    """value (a text), and a bit for each column that holds it, counted over the ``sides`` (rows, columns)."""
    bits = _bits(sum(len(columns) for _, columns in sides))
    cells: dict[str, list[DataFrame]] = {}
    first = 0
    for df, columns in sides:
        kinds: dict[str, list] = {}
        for i, c in enumerate(columns, first):
            kind = {"tinyint": "long", "smallint": "long", "int": "long", "bigint": "long", "double": "double"}.get(df.select(at(c)).dtypes[0][1], "string")
            mask = [F.lit(1 << i % BITS if j == i // BITS else 0).cast("long").alias(b) for j, b in enumerate(bits)]
            kinds.setdefault(kind, []).append(F.struct(at(c).cast(kind).alias("v"), *mask))
        first += len(columns)
        for kind, own in kinds.items():
            cells.setdefault(kind, []).append(df.select(F.inline(F.array(*own))).where("v IS NOT NULL"))
    joined = [F.bit_or(b).alias(b) for b in bits]
    texts = []
    for kind, rows in cells.items():
        # a group takes -0.0 for 0.0, whose texts differ
        zero = F.when(F.col("v") == 0, F.col("v").cast("string")) if kind == "double" else F.lit(None).cast("string")
        found = reduce(DataFrame.unionByName, rows).groupBy("v", zero.alias("z")).agg(*joined)
        text = F.coalesce("z", F.col("v").cast("string"))
        texts.append(found.select((text if kind == "long" else F.regexp_replace(text, r"\.0+$", "")).alias("value"), *bits))
    return reduce(DataFrame.unionByName, texts).groupBy("value").agg(*joined)


def matches(original: DataFrame, transformed: DataFrame, sources: list[str], targets: list[str], most: int = 1) -> DataFrame:
    """source, target, shared, coverage, affinity, rank: the best sources of each target.

    First by the share of the target's values that the source has too, then by how alike the names are.
    """
    found = overlaps(original, transformed, sources, targets)
    names = original.sparkSession.createDataFrame([(s, t, affinity(s, t)) for s in sources for t in targets], "source string, target string, affinity double")
    both = found.join(names, ["source", "target"]).withColumn("coverage", F.round(F.col("shared") / F.col("target_values"), 4))
    rank = F.expr("row_number() OVER (PARTITION BY target ORDER BY coverage DESC, affinity DESC, source)")
    return both.withColumn("rank", rank).where(F.col("rank") <= most).select("source", "target", "shared", "coverage", F.round("affinity", 4).alias("affinity"), "rank")
