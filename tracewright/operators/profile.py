"""Dataset profiles: completeness, numbers, categories, texts, times, roles, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import values as V
from tracewright.operators.ordered import quantiles, quantiles_of_counts

#: Patterns that name what a text is, by role.
TEXT_ROLES = {
    "email-like": r"^[^\s@]+@[^\s@]+\.[^\s@]+$",
    "url-like": r"^https?://\S+$",
    "uuid": r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "datetime": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}",
    "integer": r"^[+-]?\d+$",
    "decimal": r"^[+-]?\d+\.\d+$",
}
PATTERN_SHARE = 0.9
LEAST = 8
TOP = 8
#: Share of one value beyond which, without spread, all others are rare.
DOMINANT = 0.75


def r4(c: Column) -> Column:
    """Round half up to four decimals."""
    return F.floor(c * 10000 + 0.5) / 10000


def unpivoted(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value (text) for each row and field."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in fields]).unpivot([], fields, "field", "value")


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: rows, present and null ones, empty and blank texts, share present."""
    v = F.col("value")
    g = unpivoted(df, fields).groupBy("field").agg(F.count(F.lit(1)).alias("total"), F.count(v).alias("present"), F.count_if(v == "").alias("empty"), F.count_if((v != "") & (V.trimmed(v) == "")).alias("blank"))
    return g.select("field", "total", "present", (F.col("total") - F.col("present")).alias("absent"), "empty", "blank", r4(F.col("present") / F.col("total")).alias("present_rate"))


def numbers(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value (double) of the numeric fields, nulls left out."""
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in fields])
    return wide.unpivot([], fields, "field", "value").where("value is not null")


def numeric(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: count, extremes, mean, population deviation, quantiles, MAD, IQR, signs.

    Values are counted once; quantiles, and the MAD around them, come from these counts.
    """
    long = numbers(df, fields)
    v = F.col("value")
    base = long.groupBy("field").agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.count_if(v == 0).alias("zero"), F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"))
    counts = long.where(v.isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    q = quantiles_of_counts(counts, ["field"], "value", {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    away = counts.join(F.broadcast(q.select("field", "median")), "field").groupBy("field", F.abs(v - F.col("median")).alias("value")).agg(F.sum("n").alias("n"))
    mad = quantiles_of_counts(away, ["field"], "value", {"mad": 0.5})
    out = base.join(q, "field").join(mad, "field")
    return out.select("field", "n", *[r4(F.col(c)).alias(c) for c in ("min", "max", "mean", "stddev", "p05", "p25", "median", "p75", "p95", "mad")], r4(r4(F.col("p75")) - r4(F.col("p25"))).alias("iqr"), "zero", "positive", "negative")


def mad_outliers(df: DataFrame, key: list[str], field: str, limit: float = 3.5) -> DataFrame:
    """Rows whose modified z-score 0.6745 (x - median) / MAD is beyond the limit; none under 8 values.

    At MAD 0, when at least 75 % of the values are the median, all others are rare deviations, with a null ``z``.
    """
    x = df.select(*key, F.col(field).cast("double").alias("value")).where("value is not null")
    centre = quantiles(x, [], "value", {"median": 0.5})
    away = x.crossJoin(F.broadcast(centre)).withColumn("_d", F.abs(F.col("value") - F.col("median")))
    spread = quantiles(away.select(F.col("_d").alias("value")), [], "value", {"mad": 0.5}).crossJoin(away.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.when(F.col("_d") == 0, 1.0).otherwise(0.0)).alias("_same")))
    z = F.when(F.col("mad") > 0, F.lit(0.6745) * (F.col("value") - F.col("median")) / F.col("mad"))
    rare = (F.col("mad") == 0) & (F.col("_same") >= DOMINANT) & (F.col("_d") > 0)
    return away.crossJoin(F.broadcast(spread)).where(F.col("_n") >= LEAST).withColumn("z", z).where((F.abs("z") > limit) | rare).select(*key, "value", r4(F.col("z")).alias("z"))


def zscore_outliers(df: DataFrame, key: list[str], field: str, limit: float = 2.5, by: list[str] | None = None) -> DataFrame:
    """Rows more than ``limit`` population deviations from the mean of their group of 8 or more."""
    by = by or []
    x = df.select(*dict.fromkeys([*key, *by]), F.col(field).cast("double").alias("value")).where("value is not null")
    stats = x.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.count(F.lit(1)).alias("_n"))
    both = x.join(stats, by) if by else x.crossJoin(F.broadcast(stats))
    z = (F.col("value") - F.col("_m")) / F.col("_s")
    return both.where((F.col("_n") >= LEAST) & (F.col("_s") > 0)).withColumn("z", z).where(F.abs("z") > limit).select(*dict.fromkeys([*key, *by]), "value", r4(F.col("z")).alias("z"))


def histogram(df: DataFrame, field: str) -> DataFrame:
    """bin, low, high, n by Freedman and Diaconis (square root rule if the IQR is 0), 8 to 24 bins, last closed."""
    x = df.select(F.col(field).cast("double").alias("value")).where("value is not null")
    s = x.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")).crossJoin(quantiles(x, [], "value", {"q1": 0.25, "q3": 0.75}))
    iqr, span = r4(F.col("q3")) - r4(F.col("q1")), F.col("hi") - F.col("lo")
    fd = F.ceil(span / (2 * iqr / F.cbrt(F.col("n").cast("double"))))
    bins = F.greatest(F.lit(8), F.least(F.lit(24), F.when(iqr > 0, fd).otherwise(F.ceil(F.sqrt(F.col("n").cast("double")))))).cast("int")
    s = s.select("lo", F.when(span > 0, bins).otherwise(1).alias("k"), span.alias("span")).withColumn("w", F.col("span") / F.col("k"))
    place = F.when(F.col("w") > 0, F.least(F.floor((F.col("value") - F.col("lo")) / F.col("w")), F.col("k") - 1)).otherwise(0).cast("int")
    counted = x.crossJoin(F.broadcast(s)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = s.select("lo", "w", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    return every.join(counted, "bin", "left").select("bin", r4(F.col("lo") + F.col("bin") * F.col("w")).alias("low"), r4(F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def categories(df: DataFrame, fields: list[str], top: int = TOP) -> DataFrame:
    """field, rank, value, n, share of the commonest values (ties by text)."""
    long = unpivoted(df, fields).where("value is not null")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("field").agg(F.sum("n").alias("_total"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).join(F.broadcast(total), "field").select("field", "rank", "value", "n", r4(F.col("n") / F.col("_total")).alias("share"))


def entropy(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, distinct, ratio, normalised base-2 entropy."""
    counts = unpivoted(df, fields).where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    # H = log2(N) - sum(n log2 n) / N: one pass over the counts
    g = counts.groupBy("field").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("_n"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("_s"))
    h = F.log2(F.col("_n").cast("double")) - F.col("_s") / F.col("_n")
    return g.select("field", "distinct", r4(F.col("distinct") / F.col("_n")).alias("distinct_ratio"), F.when(F.col("distinct") > 1, r4(h / F.log2(F.col("distinct").cast("double")))).otherwise(0.0).alias("entropy"))


def string_lengths(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: shortest, median, 95th percentile and longest text."""
    long = unpivoted(df, fields).where("value is not null").select("field", F.length("value").cast("double").alias("value"))
    q = quantiles(long, ["field"], "value", {"min": 0.0, "median": 0.5, "p95": 0.95, "max": 1.0})
    return q.select("field", *[r4(F.col(c)).alias(c) for c in ("min", "median", "p95", "max")])


def patterns(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, pattern, share for each pattern that at least 90 % of 8 or more texts meet."""
    v = F.col("value")
    g = unpivoted(df, fields).where("value is not null").groupBy("field").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(F.when(v.rlike(p), 1.0).otherwise(0.0)).alias(k) for k, p in TEXT_ROLES.items()])
    return g.where(F.col("_n") >= LEAST).unpivot(["field"], list(TEXT_ROLES), "pattern", "share").where(F.col("share") >= PATTERN_SHARE).select("field", "pattern", r4(F.col("share")).alias("share"))


def temporal_gaps(df: DataFrame, stamp: str, by: list[str] | None = None, times: float = 3.0, least_share: float = 0.05) -> DataFrame:
    """Gaps between neighbouring distinct times over 3 medians and over 5 % of the span, per group of ``by``.

    Neighbours are found inside groups; without groups the day is the group and the last time of
    the day before is carried over, so no task sorts the whole column.
    """
    by = by or []
    t = df.select(*by, F.unix_millis(F.col(stamp).cast("timestamp")).alias("ms")).where("ms is not null").distinct()
    if by:
        step = t.withColumn("_from", F.lag("ms").over(Window.partitionBy(*by).orderBy("ms")))
    else:
        t = t.withColumn("_day", F.floor(F.col("ms") / 86_400_000))
        edge = t.groupBy("_day").agg(F.max("ms").alias("_last"))
        edge = edge.select("_day", F.lag("_last").over(Window.orderBy("_day")).alias("_before"))  # a row for each day
        step = t.join(F.broadcast(edge), "_day").withColumn("_from", F.coalesce(F.lag("ms").over(Window.partitionBy("_day").orderBy("ms")), "_before"))
    step = step.where("_from is not null").withColumn("gap", F.col("ms") - F.col("_from"))
    span = t.groupBy(*by).agg((F.max("ms") - F.min("ms")).alias("_span"))
    mid = quantiles(step.select(*by, F.col("gap").cast("double").alias("gap")), by, "gap", {"_median": 0.5})
    stats = span.join(mid, by) if by else span.crossJoin(mid)
    both = step.join(stats, by) if by else step.crossJoin(F.broadcast(stats))
    return both.where((F.col("gap") > times * F.col("_median")) & (F.col("gap") > least_share * F.col("_span"))).select(*by, F.col("_from").alias("from_ms"), F.col("ms").alias("to_ms"), "gap")


def duplicates(df: DataFrame, fields: list[str]) -> DataFrame:
    """Each group of equal rows (by the fields): its fields and its size."""
    return df.groupBy(*fields).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def roles(df: DataFrame) -> DataFrame:
    """field, role from type, distinctness and patterns."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.dataType.simpleString().split("(")[0] in ("string", "boolean", "int", "bigint", "double", "float", "decimal", "date", "timestamp", "timestamp_ntz", "smallint", "tinyint")}
    fields = list(types)
    e = entropy(df, fields)
    p = patterns(df, [f for f in fields if types[f] == "string"] or fields[:1]).groupBy("field").agg(F.collect_set("pattern").alias("_p"))
    kind = F.create_map(*[x for f in fields for x in (F.lit(f), F.lit(types[f].split("(")[0]))])
    t = F.element_at(kind, F.col("field"))
    number = t.isin("int", "bigint", "double", "float", "decimal", "smallint", "tinyint")
    has = lambda k: F.array_contains(F.coalesce("_p", F.array().cast("array<string>")), k)
    role = F.when(t == "boolean", "boolean").when(t == "date", "date").when(t.startswith("timestamp"), "datetime")
    for k in ("uuid", "email-like", "url-like", "datetime", "date"):
        role = role.when((t == "string") & has(k), k)
    role = role.when((F.col("distinct_ratio") >= 0.98) & ((t == "string") | t.isin("int", "bigint")) & (F.col("distinct") >= LEAST), "identifier").when(number, "numeric-measure").when((t == "string") & ((F.col("distinct") <= 20) | (F.col("distinct_ratio") <= 0.2)), "category").when(t == "string", "text").otherwise("unknown")
    return e.join(p, "field", "left").select("field", role.alias("role"), "distinct")


def insights(df: DataFrame) -> DataFrame:
    """kind, field, score of what stands out, from the field profiles."""
    fields = [r.name for r in df.schema.fields if r.dataType.typeName() not in ("array", "struct", "map", "binary", "variant")]
    c, e, r = completeness(df, fields), entropy(df, fields), roles(df)
    top = categories(df, fields, 1).select("field", F.col("share").alias("_top"))
    both = c.join(e, "field").join(r.select("field", "role"), "field", "left").join(top, "field", "left")
    one = lambda kind, when, score: F.when(when, F.struct(F.lit(kind).alias("kind"), r4(score).alias("score")))
    found = F.array(
        one("missingness", F.col("present_rate") < 1, 1 - F.col("present_rate")),
        one("likely-identifier", F.col("role") == "identifier", F.col("distinct_ratio")),
        one("near-constant", (F.col("_top") >= 0.98) & (F.col("distinct") > 1), F.col("_top")),
        one("dominant-category", (F.col("role") == "category") & F.col("_top").between(0.75, 0.98), F.col("_top")),
        one("enum-candidate", (F.col("role") == "category") & F.col("distinct").between(2, 12), F.col("distinct_ratio") * -1 + 1),
    )
    return both.select("field", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_i")).select(F.col("_i.kind").alias("kind"), "field", F.col("_i.score").alias("score"))


def overview(found: DataFrame, most: int = 6, each: int = 2) -> list[dict]:
    """At most 6 insights, 2 of a kind and 2 of a field, best first (a report of bounded size)."""
    rank = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "kind", "field"))
    # no more than ``most`` of a kind can be chosen, so the rest never reaches the driver
    rows = found.withColumn("_r", rank("kind")).where(F.col("_r") <= most * each).orderBy(F.desc("score"), "kind", "field").collect()
    out: list[dict] = []
    for row in rows:
        if len(out) < most and sum(x["kind"] == row["kind"] for x in out) < each and sum(x["field"] == row["field"] for x in out) < each:
            out.append({"kind": row["kind"], "field": row["field"], "score": row["score"]})
    return out


def fingerprints(df: DataFrame, fields: list[str]) -> DataFrame:
    """All columns and ``fingerprint`` of the canonical JSON (sorted keys) of the fields."""
    return df.withColumn("fingerprint", V.fingerprint(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})))


def schema_fingerprint(df: DataFrame) -> str:
    """A hash of the sorted paths and types, nested ones included."""
    import zlib

    from pyspark.sql.types import ArrayType, StructType

    def paths(kind, at):
        if isinstance(kind, StructType):
            return [x for f in kind.fields for x in paths(f.dataType, f"{at}.{f.name}")]
        if isinstance(kind, ArrayType):
            return paths(kind.elementType, f"{at}[*]")
        return [f"{at}:{kind.simpleString()}"]

    return f"{zlib.crc32('|'.join(sorted(paths(df.schema, '$'))).encode()):08x}"


def dataset_digest(df: DataFrame) -> DataFrame:
    """An order-free digest of all rows: count and xor and sum of row hashes, one partial aggregate."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("sum"))


def _nodes(value, kind: T.DataType, depth: int):
    """(kind, depth, length, of records) of a value and of all inside it."""
    row = lambda name, length=None, records=False: F.array(F.struct(F.lit(name).alias("kind"), F.lit(depth).alias("depth"), (F.lit(None) if length is None else length).cast("int").alias("length"), F.lit(records).alias("records")))
    if isinstance(kind, T.StructType):
        out = F.concat(row("object"), *[_nodes(value.getField(f.name), f.dataType, depth + 1) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        out = F.concat(row("array", F.size(value), isinstance(kind.elementType, T.StructType)), F.flatten(F.transform(value, lambda x: _nodes(x, kind.elementType, depth + 1))))
    elif isinstance(kind, T.MapType):
        out = F.concat(row("object"), F.flatten(F.transform(F.map_values(value), lambda x: _nodes(x, kind.valueType, depth + 1))))
    else:
        out = row("number" if isinstance(kind, T.NumericType) else "boolean" if isinstance(kind, T.BooleanType) else "string")
    return F.when(value.isNull(), row("null")).otherwise(out)


def structure(df: DataFrame) -> DataFrame:
    """kind, n, deepest, longest array, arrays of records: all values of all rows by type; fields are at depth 1."""
    every = F.concat(*[_nodes(F.col(f"`{f.name}`"), f.dataType, 1) for f in df.schema.fields])
    return df.select(F.explode(every).alias("x")).groupBy("x.kind").agg(F.count(F.lit(1)).alias("n"), F.max("x.depth").alias("deepest"), F.max("x.length").alias("longest"), F.sum(F.col("x.records").cast("int")).alias("record_arrays"))


def row_insights(df: DataFrame, key: list[str], numeric_fields: list[str] = (), temporal_fields: list[str] = (), record: list[str] | None = None) -> DataFrame:
    """kind, field, affected: values far from their field's median, times with unusual gaps, and repeated records.

    ``affected`` are rows beyond a modified z-score of 3.5, gaps over three medians and 5 % of the span, and
    copies beyond the first. Kinds that affect nothing are left out.
    """
    parts = [mad_outliers(df, key, f).agg(F.count(F.lit(1)).alias("affected")).select(F.lit("unusual-numeric").alias("kind"), F.lit(f).alias("field"), "affected") for f in numeric_fields]
    parts += [temporal_gaps(df, f).agg(F.count(F.lit(1)).alias("affected")).select(F.lit("temporal-gap").alias("kind"), F.lit(f).alias("field"), "affected") for f in temporal_fields]
    same = duplicates(df, record or df.columns).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("affected"))
    parts.append(same.select(F.lit("duplicate-records").alias("kind"), F.lit("$").alias("field"), "affected"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("affected > 0")


def mixed_types(leaves_: DataFrame) -> DataFrame:
    """kind, field, types of leaf paths (``documents.leaf_profile``) with more than one type but null."""
    types = F.filter(F.split("types", ","), lambda t: t != "null")
    return leaves_.where(F.size(types) > 1).select(F.lit("mixed-types").alias("kind"), F.col("path").alias("field"), F.array_join(types, ",").alias("types"))
