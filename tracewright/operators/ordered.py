"""Exact order statistics without a task that holds a whole column.

Values are counted per key, dealt into ranges by approximate cut points, and summed up inside the
ranges; the ranges' own totals are summed up separately. Approximate cuts only steer the dealing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def cumulative(counts: DataFrame, keys: list[str], value: str, sums: list[str], ranges: int = RANGES) -> DataFrame:
    """``counts`` (one row for each key and value) with ``cum_<s>``, the running sum by value of each of ``sums``.

    Every key has its own cuts, so keys whose values are of other sizes do not meet in one range.
    """
    at = [i / ranges for i in range(1, ranges)]
    named = {k: f"_c_{k}" for k in keys}
    cuts = counts.groupBy(*[F.col(k).alias(named[k]) for k in keys]).agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), at, 1_000)).alias("_cuts"))
    dealt = _by_keys(counts, cuts, named).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col(value).cast("double")))).select(*counts.columns, "_range")
    totals = dealt.groupBy(*keys, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_t_{s}").over(ahead), F.lit(0)).alias(f"_b_{s}") for s in sums])
    on = F.col("_range") == F.col("_r")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.join(bases, on)
    return run.select(*counts.columns, *[(F.col(f"_b_{s}") + F.sum(s).over(inside)).alias(f"cum_{s}") for s in sums])


def _by_keys(df: DataFrame, other: DataFrame, named: dict[str, str]) -> DataFrame:
    """Join by keys that the other side has under other names, nulls equal; without keys its only row goes to all."""
    if not named:
        return df.crossJoin(F.broadcast(other))
    return df.join(other, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()])


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of the non-null values of each key, exact."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return quantiles_of_counts(counts, keys, value, probabilities)


def quantiles_of_counts(counts: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """``quantiles`` of values that are counted already: one row for each key and value, and ``n``."""
    run = cumulative(counts, keys, value, ["n"])
    total = counts.groupBy(*[F.col(k).alias(f"_j_{k}") for k in keys]).agg(F.sum("n").alias("_total"))
    run = _by_keys(run, total, {k: f"_j_{k}" for k in keys})
    out = []
    for name, p in probabilities.items():
        place = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        out += [F.min(F.when(F.col("cum_n") > low, F.col(value))).alias(f"_lo_{name}"), F.min(F.when(F.col("cum_n") > high, F.col(value))).alias(f"_hi_{name}"), F.max(place - low).alias(f"_f_{name}")]
    g = run.groupBy(*keys).agg(*out)
    return g.select(*keys, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).cast("double").alias(n) for n in probabilities])
