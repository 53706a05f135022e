"""Comparison of two datasets: distributions, fields, rows by key or place, nested values."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators import profile as P
from tracewright.operators.ordered import cumulative
from tracewright.operators.profile import r4

LEAST_KS = 30


def _tagged(a: DataFrame, b: DataFrame, field: str, kind: str) -> DataFrame:
    one = lambda d, n: d.select(F.col(field).cast(kind).alias("v"), F.lit(1 if n == "a" else 0).alias("a"), F.lit(1 if n == "b" else 0).alias("b")).where("v is not null")
    return one(a, "a").unionByName(one(b, "b")).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def ks(a: DataFrame, b: DataFrame, field: str) -> DataFrame:
    """n_a, n_b and the two-sample Kolmogorov-Smirnov statistic (null under 30 values on a side)."""
    counts = _tagged(a, b, field, "double")
    run = cumulative(counts, [], "v", ["a", "b"])
    n = counts.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    gap = F.max(F.abs(F.col("cum_a") / F.col("n_a") - F.col("cum_b") / F.col("n_b")))
    g = run.crossJoin(F.broadcast(n)).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), gap.alias("ks"))
    return g.select("n_a", "n_b", F.when((F.col("n_a") >= LEAST_KS) & (F.col("n_b") >= LEAST_KS), r4(F.col("ks"))).alias("ks"))


def jsd(a: DataFrame, b: DataFrame, field: str, top: int | None = None) -> DataFrame:
    """Base-2 Jensen-Shannon divergence of two categorical columns, over all values or each side's top ones."""
    counts = _tagged(a, b, field, "string")
    if top:
        best = lambda c: counts.where(F.col(c) > 0).orderBy(F.desc(c), "v").limit(top).select("v", F.col(c))
        counts = best("a").join(best("b"), "v", "full").select("v", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    n = counts.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    p, q = F.col("a") / F.col("n_a"), F.col("b") / F.col("n_b")
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) / 2
    return counts.crossJoin(F.broadcast(n)).agg(r4(F.sum(term(p) + term(q))).alias("jsd"))


def fields(a: DataFrame, b: DataFrame) -> DataFrame:
    """field, status: added, removed, type-changed, role-changed, presence-changed (1 point) or same."""

    def side(d, tag):
        names = [f.name for f in d.schema.fields]
        kinds = F.create_map(*[x for f in d.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
        c = P.completeness(d, names).select("field", "present_rate")
        return c.join(P.roles(d).select("field", "role"), "field", "left").select("field", F.element_at(kinds, F.col("field")).alias(f"type_{tag}"), F.col("role").alias(f"role_{tag}"), F.col("present_rate").alias(f"present_{tag}"))

    both = side(a, "a").join(side(b, "b"), "field", "full")
    status = (
        F.when(F.col("type_a").isNull(), "added").when(F.col("type_b").isNull(), "removed").when(F.col("type_a") != F.col("type_b"), "type-changed")
        .when(~F.col("role_a").eqNullSafe(F.col("role_b")), "role-changed").when(F.abs(F.col("present_a") - F.col("present_b")) >= 0.01, "presence-changed").otherwise("same")
    )
    return both.select("field", status.alias("status"), "type_a", "type_b", "present_a", "present_b")


#: A distribution has shifted from this KS statistic, or this divergence, on.
SHIFTED_KS, SHIFTED_JSD = 0.2, 0.1


def shifts(a: DataFrame, b: DataFrame, numeric: list[str] = (), categorical: list[str] = ()) -> DataFrame:
    """field, kind, before, after, delta, distance, new, lost, shifted: how the values of shared fields moved.

    For numbers: means and the KS statistic; for categories: distinct values and the Jensen-Shannon
    divergence, with how many values are new and how many are lost. The distance of numbers is null under 30 values on a side.
    """
    parts = []
    for f in numeric:
        mean = lambda d, n: d.agg(F.avg(F.col(f"`{f}`").cast("double")).alias(n))  # noqa: B023, E731
        one = mean(a, "x").crossJoin(mean(b, "y")).crossJoin(ks(a, b, f).select("ks"))  # one row each
        parts.append(one.select(F.lit(f).alias("field"), F.lit("numeric").alias("kind"), r4(F.col("x")).alias("before"), r4(F.col("y")).alias("after"), r4(F.col("y") - F.col("x")).alias("delta"), F.col("ks").alias("distance"), F.lit(0).cast("long").alias("new"), F.lit(0).cast("long").alias("lost"), F.coalesce(F.col("ks") >= SHIFTED_KS, F.lit(False)).alias("shifted")))
    for f in categorical:
        counts = _tagged(a, b, f, "string").agg(F.count_if(F.col("a") > 0).alias("x"), F.count_if(F.col("b") > 0).alias("y"), F.count_if(F.col("a") == 0).alias("new"), F.count_if(F.col("b") == 0).alias("lost"))
        one = counts.crossJoin(jsd(a, b, f))
        parts.append(one.select(F.lit(f).alias("field"), F.lit("categorical").alias("kind"), F.col("x").cast("double").alias("before"), F.col("y").cast("double").alias("after"), (F.col("y") - F.col("x")).cast("double").alias("delta"), F.col("jsd").alias("distance"), "new", "lost", F.coalesce(F.col("jsd") >= SHIFTED_JSD, F.lit(False)).alias("shifted")))
    return reduce(DataFrame.unionByName, parts)


def same(a: Column, b: Column, absolute: float = 0.0, relative: float = 0.0, missing: tuple = (), ignore_order: bool = False, kind: str = "string") -> Column:
    """Equality within tolerance; values of ``missing`` count as null; arrays may ignore order."""
    if missing:
        gone = lambda x: F.when(~x.cast("string").isin(*[str(m) for m in missing]), x)
        a, b = gone(a), gone(b)
    if ignore_order:
        a, b = F.sort_array(a), F.sort_array(b)
    out = a.eqNullSafe(b)
    if kind in ("double", "float", "int", "bigint", "decimal") and (absolute or relative):
        x, y = a.cast("double"), b.cast("double")
        gap = F.abs(x - y)
        out = out | F.coalesce((gap <= absolute) | (gap / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) <= relative), F.lit(False))
    return out


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row and how many; comparison by key refuses these."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def rows_keyed(a: DataFrame, b: DataFrame, keys: list[str], absolute: float = 0.0, relative: float = 0.0, ignore: tuple = (), missing: tuple = ()) -> DataFrame:
    """keys, status (added, removed, changed, unchanged) and the changed fields: one full outer join on the key.

    Rows whose key repeats on a side have status ``duplicate-key``: they cannot be paired.
    """
    shared = [c for c in a.columns if c in b.columns and c not in keys and c not in ignore]
    kinds = {f.name: f.dataType.simpleString().split("(")[0] for f in a.schema.fields}

    def side(d, tag):
        n = F.count(F.lit(1)).alias(f"_n_{tag}")
        return d.groupBy(*keys).agg(n, F.first(F.struct(*[F.col(c) for c in shared]) if shared else F.lit(1)).alias(f"_{tag}"))

    both = side(a, "a").join(side(b, "b"), keys, "full")
    differ = F.filter(F.array(*[F.when(~same(F.col(f"_a.{c}"), F.col(f"_b.{c}"), absolute, relative, missing, kind=kinds[c]), F.lit(c)) for c in shared]), lambda x: x.isNotNull()) if shared else F.array().cast("array<string>")
    status = F.when((F.coalesce("_n_a", F.lit(0)) > 1) | (F.coalesce("_n_b", F.lit(0)) > 1), "duplicate-key").when(F.col("_n_a").isNull(), "added").when(F.col("_n_b").isNull(), "removed").when(F.size(differ) > 0, "changed").otherwise("unchanged")
    return both.select(*keys, status.alias("status"), F.when(status == "changed", F.array_join(differ, ",")).otherwise("").alias("fields"))


def rows_positional(a: DataFrame, b: DataFrame, place: str, **how) -> DataFrame:
    """As by key, on the row's place."""
    return rows_keyed(a, b, [place], **how)


def order_changed(a: DataFrame, b: DataFrame, key: str, place: str) -> DataFrame:
    """Whether shared keys come in another order: neighbours in ``a`` that turn round in ``b``.

    Places are compared between neighbours inside ranges of a's places and between the ranges' ends.
    """
    both = a.select(key, F.col(place).alias("_pa")).join(b.select(key, F.col(place).alias("_pb")), key)
    dealt = both.withColumn("_r", F.floor(F.col("_pa") / 10_000))
    inside = dealt.withColumn("_before", F.lag("_pb").over(Window.partitionBy("_r").orderBy("_pa"))).agg(F.coalesce(F.max(F.col("_pb") < F.col("_before")), F.lit(False)).alias("_x"))
    ends = dealt.groupBy("_r").agg(F.min_by("_pb", "_pa").alias("_first"), F.max_by("_pb", "_pa").alias("_last"))
    across = ends.withColumn("_before", F.lag("_last").over(Window.orderBy("_r"))).agg(F.coalesce(F.max(F.col("_first") < F.col("_before")), F.lit(False)).alias("_y"))
    return inside.crossJoin(across).select((F.col("_x") | F.col("_y")).alias("order_changed"))


def _step(name: str, first: bool = False) -> str:
    """A field in a path: after a dot, or quoted where its name is no plain word, so that ``a.b`` is never field b of a."""
    return ("" if first else ".") + name if re.fullmatch(r"[A-Za-z_]\w*", name) else '["' + name.replace('"', '\\"') + '"]'


def entries(value: Column, kind: T.DataType, path: Column) -> Column:
    """The leaves of a value as an array of (path, value): fields by name, array elements by place, map values by key.

    An empty array or map and a null are leaves themselves.
    """
    leaf = lambda v: F.array(F.struct(path.alias("path"), v.cast("string").alias("value")))
    if isinstance(kind, T.StructType) and len(kind.fields):
        inside = F.concat(*[entries(value.getField(f.name), f.dataType, F.concat(path, F.lit(_step(f.name)))) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        inside = F.flatten(F.transform(value, lambda x, i: entries(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        inside = F.when(F.size(value) > 0, inside).otherwise(leaf(F.lit("[]")))
    elif isinstance(kind, T.MapType):
        inside = F.flatten(F.transform(F.map_entries(value), lambda e: entries(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string")))))
        inside = F.when(F.size(value) > 0, inside).otherwise(leaf(F.lit("{}")))
    else:
        return leaf(value)
    return F.when(value.isNull(), leaf(F.lit(None))).otherwise(inside)


def leaves(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, path, value of every leaf of the fields, nested ones included."""
    every = F.concat(*[entries(F.col(f"`{c}`"), df.schema[c].dataType, F.lit(_step(c, True))) for c in fields])
    return df.select(key, F.explode(every).alias("_leaf")).select(key, "_leaf.path", "_leaf.value")


def nested_changes(a: DataFrame, b: DataFrame, key: str, ignore: tuple = ()) -> DataFrame:
    """key, path, before, after of every leaf that differs between rows of one key; ``ignore`` holds paths whose leaves, at any depth, do not count."""
    old, new = (d.select(key, F.struct(*[F.col(f"`{c}`") for c in d.columns if c != key]).alias(side)) for d, side in ((a, "_a"), (b, "_b")))
    both = old.join(new, key).where(~F.to_json("_a").eqNullSafe(F.to_json("_b")))
    sides = [F.map_from_entries(F.concat(*[entries(F.col(s).getField(f.name), f.dataType, F.lit(_step(f.name, True))) for f in both.schema[s].dataType.fields])).alias(s) for s in ("_a", "_b")]
    maps = both.select(key, *sides)
    paths = maps.select(key, "_a", "_b", F.explode(F.array_union(F.map_keys("_a"), F.map_keys("_b"))).alias("path"))
    out = paths.select(key, "path", F.try_element_at("_a", F.col("path")).alias("before"), F.try_element_at("_b", F.col("path")).alias("after"))
    for gone in ignore:
        inside = (F.col("path") == gone) | F.col("path").startswith(f"{gone}.") | F.col("path").startswith(f"{gone}[")
        out = out.where(~inside)
    return out.where(~F.col("before").eqNullSafe(F.col("after")))


def structural_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, path, status (add, change, remove, same) of every leaf: a full outer join on key and path. A null that is there is a value."""
    x, y = (leaves(d, key, [c for c in d.columns if c != key]).select(key, "path", F.struct("value").alias(s)) for d, s in ((a, "_x"), (b, "_y")))
    both = x.join(y, [key, "path"], "full")
    status = F.when(F.col("_x").isNull(), "add").when(F.col("_y").isNull(), "remove").when(F.col("_x.value").eqNullSafe(F.col("_y.value")), "same").otherwise("change")
    return both.select(key, "path", status.alias("status"))


def suggested_key(a: DataFrame, b: DataFrame) -> str | None:
    """The shared field that is an identifier on both sides, the most distinct first."""
    both = P.roles(a).join(P.roles(b).select("field", F.col("role").alias("_r"), F.col("distinct").alias("_d")), "field").where("role = 'identifier' and _r = 'identifier'")
    row = both.orderBy(F.desc(F.col("distinct") + F.col("_d")), "field").first()
    return row["field"] if row else None


def summary(found: DataFrame) -> DataFrame:
    """status, rows of a row comparison."""
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


def guarded(df: DataFrame) -> DataFrame:
    """Texts that a spreadsheet would run as formulas get an apostrophe."""
    return df.select(*[F.when(F.col(f.name).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(f.name))).otherwise(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in df.schema.fields])


def insights(found: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """kind, field, amount from field comparison: types, missingness of 5 points, added and removed."""
    gap = F.abs(F.coalesce("present_a", F.lit(0.0)) - F.coalesce("present_b", F.lit(0.0)))
    parts = [found.where(F.col("status").isin("added", "removed", "type-changed")).select(F.concat(F.lit("field-"), F.col("status")).alias("kind"), "field", F.lit(1.0).alias("amount")), found.where(F.col("type_a").isNotNull() & F.col("type_b").isNotNull() & (gap >= 0.05)).select(F.lit("missingness").alias("kind"), "field", gap.alias("amount"))]
    if rows is not None:
        parts.append(summary(rows).where("status <> 'unchanged'").select(F.concat(F.lit("rows-"), F.col("status")).alias("kind"), F.lit(None).cast("string").alias("field"), F.col("rows").cast("double").alias("amount")))
    return reduce(DataFrame.unionByName, parts)
