"""Queries of the row operators: one program of one operator each over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.program import Op, run
from tracewright.queries import QUERIES, ORACLE_SQL, table


def shown(df: DataFrame) -> DataFrame:
    """Array results as text, so that both engines compare alike."""
    return df.withColumn("out", F.array_join("out", ",")) if df.schema["out"].dataType.typeName() == "array" else df


def _op(name: str, source: str, key: str, kind: str, params: dict, sql: str, prepare=None) -> None:
    """Register ``key, out`` of one operator over a table."""

    def f(spark, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return shown(run(prepare(df) if prepare else df, [Op(kind, "out", params)], keep=(key,)))

    QUERIES[name] = f
    ORACLE_SQL[name] = f"SELECT {key}, {sql} AS out FROM {source}"


_op("op_set", "customer", "c_custkey", "set", {"source": "$.c_name"}, "c_name")
_op("op_constant", "customer", "c_custkey", "constant", {"value": "v1"}, "'v1'")
_op("op_coerce", "events", "event_id", "coerce", {"source": "text", "to": "number"}, "TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)", lambda d: d.withColumn("text", F.regexp_extract("props", r"([0-9]+)", 1)))
_op("op_coerce_boolean", "orders", "o_orderkey", "coerce", {"source": "flag", "to": "boolean"}, "CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END", lambda d: d.withColumn("flag", F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").otherwise("maybe")))
_op("op_string_case_upper", "part", "p_partkey", "stringCase", {"source": "p_name", "mode": "trim+upper"}, "upper(trim(p_name))")
_op("op_string_case_title", "part", "p_partkey", "stringCase", {"source": "p_type", "mode": "title"}, "array_to_string(list_transform(regexp_extract_all(lower(p_type), '(\\w+|\\W+)', 1), lambda x: upper(x[1]) || x[2:]), '')")
_op("op_string_normalize_ws", "documents", "doc_id", "stringNormalize", {"source": "line", "mode": "collapseWhitespace"}, "trim(regexp_replace(split_part(text, chr(10), 1), '[ \\t]+', ' ', 'g'))", lambda d: d.withColumn("line", F.split("text", "\n")[0]))
_op("op_string_replace", "customer", "c_custkey", "stringReplace", {"source": "c_name", "search": "#", "replacement": "-"}, "replace(c_name, '#', '-')")
_op("op_numeric_add", "customer", "c_custkey", "numericTransform", {"source": "c_acctbal", "mode": "add", "value": 100}, "c_acctbal + 100")
_op("op_numeric_multiply", "customer", "c_custkey", "numericTransform", {"source": "c_acctbal", "mode": "multiply", "value": 100}, "c_acctbal * 100")
_op("op_numeric_divide", "customer", "c_custkey", "numericTransform", {"source": "c_acctbal", "mode": "divide", "value": 100}, "c_acctbal / 100")
_op("op_numeric_abs", "customer", "c_custkey", "numericTransform", {"source": "c_acctbal", "mode": "absolute", "value": 1}, "abs(c_acctbal)")
_op("op_numeric_binary_add", "part", "p_partkey", "numericBinary", {"left": "p_retailprice", "right": "p_size", "mode": "add"}, "p_retailprice + p_size")
_op("op_numeric_binary_subtract", "part", "p_partkey", "numericBinary", {"left": "p_retailprice", "right": "p_size", "mode": "subtract"}, "p_retailprice - p_size")
_op("op_numeric_binary_multiply", "part", "p_partkey", "numericBinary", {"left": "p_retailprice", "right": "p_size", "mode": "multiply"}, "p_retailprice * p_size")
_op("op_numeric_compare", "customer", "c_custkey", "numericCompare", {"source": "c_acctbal", "comparison": "lessThan", "value": 0}, "c_acctbal < 0")
_op("op_boolean_not", "orders", "o_orderkey", "booleanNot", {"source": "done"}, "NOT (o_orderstatus = 'F')", lambda d: d.withColumn("done", F.col("o_orderstatus") == "F"))
_op("op_conditional", "orders", "o_orderkey", "conditional", {"source": "o_orderstatus", "test": "equals", "value": "F", "then": "closed", "else": "open"}, "CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END")
_op("op_fallback", "customer", "c_custkey", "fallback", {"sources": ["a", "c_name"]}, "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END", lambda d: d.withColumn("a", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, "")))
_op("op_date_normalize", "orders", "o_orderkey", "stringNormalize", {"source": "day", "mode": "dateNormalize"}, "strftime(o_orderdate, '%Y-%m-%d')", lambda d: d.withColumn("day", F.date_format("o_orderdate", "dd/MM/yyyy")))
for _mode, _form in (("isoDate", "%Y-%m-%d"), ("usSlash", "%m/%d/%Y"), ("euSlash", "%d/%m/%Y"), ("yearMonth", "%Y-%m"), ("year", "%Y")):
    _op(f"op_date_format_{_mode.lower()}", "orders", "o_orderkey", "dateFormat", {"source": "day", "mode": _mode}, f"strftime(o_orderdate, '{_form}')", lambda d: d.withColumn("day", F.date_format("o_orderdate", "yyyy/MM/dd")))
_op("op_template", "customer", "c_custkey", "template", {"parts": [{"source": "c_name", "transform": "lower"}, {"literal": " <"}, {"source": "c_mktsegment"}, {"literal": ">"}]}, "lower(c_name) || ' <' || c_mktsegment || '>'")
_op("op_concat", "customer", "c_custkey", "concat", {"sources": ["c_name", "c_mktsegment"], "separators": [" / "]}, "c_name || ' / ' || c_mktsegment")
_op("op_split_part", "part", "p_partkey", "splitPart", {"source": "p_type", "separator": " ", "index": 1}, "coalesce(string_split(p_type, ' ')[2], '')")
_op("op_string_split", "part", "p_partkey", "stringSplit", {"source": "p_name", "separator": " "}, "array_to_string(string_split(p_name, ' '), ',')")
_op("op_extract_between", "events", "event_id", "extractBetween", {"source": "props", "prefix": ": ", "suffix": "}"}, "regexp_extract(props, ': ([^}]*)[}]', 1)")
_op("op_regex_extract", "customer", "c_custkey", "regexExtract", {"source": "c_name", "pattern": "[0-9]+"}, "regexp_extract(c_name, '[0-9]+')")
_op("op_value_map", "orders", "o_orderkey", "valueMap", {"source": "o_orderstatus", "map": {"F": "finished", "O": "open"}}, "CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END")
_op("op_quantity_transform", "part", "p_partkey", "quantityTransform", {"source": "q", "factor": 1024, "unit": "Ki"}, "(p_size * 1024)::VARCHAR || 'Ki'", lambda d: d.withColumn("q", F.concat(F.col("p_size").cast("string"), F.lit("Mi"))))
_op("op_phone", "customer", "c_custkey", "stringNormalize", {"source": "p", "mode": "phone", "country": "49"}, "'+49' || (2000000 + c_custkey)::VARCHAR", lambda d: d.withColumn("p", F.concat(F.lit("0"), F.substring((F.col("c_custkey") + 2000000).cast("string"), 1, 3), F.lit("-"), F.substring((F.col("c_custkey") + 2000000).cast("string"), 4, 20))))
_op("op_s3_key_decode", "part", "p_partkey", "stringNormalize", {"source": "k", "mode": "s3KeyDecode"}, "replace(p_name, ' ', '/') || ' x'", lambda d: d.withColumn("k", F.concat(F.replace("p_name", F.lit(" "), F.lit("%2F")), F.lit("+x"))))
_op("op_optional_domain", "events", "event_id", "set", {"source": "value", "domain": "only"}, "CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN value END", lambda d: d.join(F.broadcast(d.agg(F.min("event_type").alias("_m"))), how="cross").withColumn("only", F.when(F.col("event_type") == F.col("_m"), F.lit(1))))
for _r, _sql in {
    "none": "{y} / 100.0 * 1.0", "half-up": "floor({y} + 0.5) / 100.0", "half-away": "sign({y}) * floor(abs({y}) + 0.5) / 100.0",
    "half-even": "CASE WHEN abs({y} - floor({y}) - 0.5) < 1e-9 THEN CASE WHEN floor({y}) % 2 = 0 THEN floor({y}) ELSE floor({y}) + 1 END ELSE floor({y} + 0.5) END / 100.0",
    "floor": "floor({y}) / 100.0", "ceil": "ceil({y}) / 100.0", "trunc": "CASE WHEN {y} < 0 THEN ceil({y}) ELSE floor({y}) END / 100.0",
}.items():
    _v = "(l_extendedprice / 1 * (1 + -(l_discount / 1)))"
    _sql = _v + " * 1.0" if _r == "none" else _sql.format(y=f"({_v} * 100.0)")

    def _formula(spark, sf_dir, r=_r):
        op = Op("numericFormula", "out", {"base": "l_extendedprice", "rate": "l_discount", "rateDivisor": 1, "direction": "subtract", "rounding": r})
        return run(table(spark, sf_dir, "lineitem"), [op], keep=("l_orderkey", "l_linenumber"))

    QUERIES[f"op_numeric_formula_{_r.replace('-', '_')}"] = _formula
    ORACLE_SQL[f"op_numeric_formula_{_r.replace('-', '_')}"] = f"SELECT l_orderkey, l_linenumber, ({_sql})::DOUBLE AS out FROM lineitem"


def orders_nested(spark, sf_dir: str) -> DataFrame:
    """Orders with their lines as an array in line order: one shuffle by order key on each side."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("sku"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag")))).alias("lines"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey")


def _array_sql(name: str, kind: str, params: dict, agg: str) -> None:
    def f(spark, sf_dir: str) -> DataFrame:
        nested = orders_nested(spark, sf_dir).withColumn("flags", F.col("lines.flag"))
        return shown(run(nested, [Op(kind, "out", {"source": "$.lines", **params})], keep=("o_orderkey",)))

    QUERIES[name] = f
    ORACLE_SQL[name] = f"SELECT o_orderkey, a AS out FROM orders JOIN (SELECT l_orderkey, {agg} AS a FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"


_W = {"path": "flag", "equals": "R"}
_array_sql("op_array_map", "arrayMap", {"where": _W, "extract": "sku"}, "coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) FILTER (l_returnflag = 'R'), '')")
_array_sql("op_array_count", "arrayCount", {"where": _W}, "count(*) FILTER (l_returnflag = 'R')::INTEGER")
_array_sql("op_array_sum", "arraySum", {"extract": "quantity"}, "sum(l_quantity)")
_array_sql("op_array_weighted_sum", "arraySum", {"factors": ["quantity", "price"], "divisor": 100}, "list_reduce(list_prepend(0.0::DOUBLE, list(l_quantity * l_extendedprice ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag)), lambda a, b: a + b) / 100")
_array_sql("op_array_index_first", "arrayIndex", {"index": "first", "extract": "sku"}, "(list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag))[1]")
_array_sql("op_array_index_last", "arrayIndex", {"index": "last", "extract": "sku"}, "(list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag))[-1]")
_array_sql("op_array_index_second", "arrayIndex", {"index": 1, "extract": "sku"}, "(list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag))[2]")
_array_sql("op_array_join", "arrayJoin", {"extract": "flag", "separator": "-"}, "string_agg(l_returnflag, '-' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag)")
_array_sql("op_array_find", "arrayFind", {"where": _W, "extract": "price"}, "(list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) FILTER (l_returnflag = 'R'))[1]")
_array_sql("op_array_string_transform", "arrayStringTransform", {"mode": "lower", "source": "$.flags"}, "string_agg(lower(l_returnflag), ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag)")

def _project_text(spark, sf_dir: str) -> DataFrame:
    """Reshaped items, shown as text so that both engines compare alike."""
    op = Op("arrayProject", "out", {"source": "lines", "fields": [{"source": "sku", "target": "id"}, {"source": "flag", "target": "state", "transform": "lower"}]})
    out = run(orders_nested(spark, sf_dir), [op], keep=("o_orderkey",))
    return out.withColumn("out", F.array_join(F.transform("out", lambda x: F.concat_ws(":", x["id"].cast("string"), x["state"])), ","))


QUERIES["op_array_project"] = _project_text
ORACLE_SQL["op_array_project"] = "SELECT o_orderkey, a AS out FROM orders JOIN (SELECT l_orderkey, string_agg(l_partkey || ':' || lower(l_returnflag), ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) AS a FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"


def _grouped(spark, sf_dir: str) -> DataFrame:
    """In-record groups, a row for each key."""
    out = run(orders_nested(spark, sf_dir), [Op("arrayGroupBy", "out", {"source": "lines", "groupBy": "flag", "extract": "sku"})], keep=("o_orderkey",))
    return out.select("o_orderkey", F.explode("out").alias("key", "skus")).withColumn("skus", F.array_join("skus", ","))


QUERIES["op_array_group_by"] = _grouped
ORACLE_SQL["op_array_group_by"] = "SELECT l_orderkey AS o_orderkey, l_returnflag AS key, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) AS skus FROM lineitem GROUP BY ALL"


def _lookup(spark, sf_dir: str) -> DataFrame:
    """A lookup against a table."""
    from tracewright.plans.program import lookup

    return lookup(table(spark, sf_dir, "customer"), "c_nationkey", table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


QUERIES["op_value_map_table"] = _lookup
ORACLE_SQL["op_value_map_table"] = "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"
