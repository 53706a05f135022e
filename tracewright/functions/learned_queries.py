"""Queries of learned patterns, picked paths and exported programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import alignment as A
from tracewright.operators.search_queries import nested_orders
from tracewright.plans import export, picks
from tracewright.plans.program import Op, run
from tracewright.queries import query, table


def codes(spark, sf_dir):
    """Order codes of three forms; every 13th is of none."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    good = F.when(k % 3 == 0, F.concat(F.lit("ORD-"), k, F.lit("-"), status)).when(k % 3 == 1, F.concat(F.lit("ORD-"), k)).otherwise(F.concat(F.lit("ORD-"), k, F.lit("-"), status, F.lit(" (old)")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 13 == 0, F.concat(F.lit("order_"), k)).otherwise(good).alias("code"))


@query("regex_aligned_support", "SELECT count_if(o_orderkey % 13 <> 0) AS matches, count(*) AS rows FROM orders")
def _support(spark, sf_dir):
    """Learned from the good rows, tried on all."""
    df = codes(spark, sf_dir)
    found = A.learned(df.where("o_orderkey % 13 <> 0"), "code")
    return A.tested(df, "code", found.text).agg(F.count_if("matched").alias("matches"), F.count(F.lit(1)).alias("rows"))


@query("regex_aligned_groups", """SELECT o_orderkey, o_orderkey % 13 <> 0 AS matched, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderkey::VARCHAR END AS number, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 3 = 1 THEN '' ELSE o_orderstatus END AS status FROM orders""")
def _groups(spark, sf_dir):
    df = codes(spark, sf_dir)
    found = A.learned(df.where("o_orderkey % 13 <> 0"), "code", captures=True)
    rows = A.tested(df, "code", found.text)
    return rows.select("o_orderkey", "matched", F.get("groups", F.lit(0)).alias("number"), F.get("groups", F.lit(1)).alias("status"))


@query("regex_shapes", """WITH c AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'upper,-,digit,-,upper' WHEN 1 THEN 'upper,-,digit' ELSE 'upper,-,digit,-,upper,space,(,lower,)' END AS shape, length(o_orderkey::VARCHAR) AS n FROM orders WHERE o_orderkey % 13 <> 0)
SELECT shape, count(*) AS rows, min(n)::INTEGER AS low, max(n)::INTEGER AS high FROM c GROUP BY shape""")
def _shapes(spark, sf_dir):
    """The forms of the good codes, and the lengths of their numbers."""
    found = A.shapes(codes(spark, sf_dir).where("o_orderkey % 13 <> 0"), "code")
    return found.where("place = 2").select(F.array_join("shape", ",").alias("shape"), "rows", "low", "high")


_SAMPLE = {"lines": [{"flag": "R", "part": 1}, {"flag": "N", "part": 2}, {"flag": "R", "part": 3}], "customer": {"id": 7}}


@query("jq_picked_paths", """SELECT o_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) FILTER (WHERE l_returnflag = 'R'), ',') AS parts, any_value(o_custkey) AS customer FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def _picked(spark, sf_dir):
    """Two parts picked on a sample: the lines of one flag, on every order."""
    parts = picks.plan(_SAMPLE, ["$.lines[0].part", "$.lines[2].part"])
    customer = picks.plan(_SAMPLE, ["$.customer.id"])
    ops = [Op(o.kind, t, o.params) for t, o in (("parts", parts.ops[0]), ("customer", customer.ops[0]))]
    out = run(nested_orders(spark, sf_dir), ops, keep=("o_orderkey",))
    shown = F.array_join(F.transform("parts", lambda p: p.cast("string")), ",")
    return out.select("o_orderkey", F.when(F.size("parts") > 0, shown).alias("parts"), "customer")


_PROGRAM = [
    Op("arrayCount", "n", {"source": "lines", "where": {"path": "flag", "equals": "R"}}),
    Op("arraySum", "quantity", {"source": "lines", "extract": "qty"}),
    Op("arrayJoin", "parts", {"source": "lines", "extract": "part", "separator": "|"}),
    Op("arrayIndex", "last", {"source": "lines", "index": "last", "extract": "part"}),
    Op("splitPart", "place", {"source": "object", "separator": "+", "index": 1}),
    Op("fallback", "name", {"sources": ["nick", "login"]}),
    Op("template", "note", {"parts": [{"literal": "it's "}, {"source": "customer.info.status", "transform": "lower"}]}),
]


@query("export_sql_arrays", """SELECT o_orderkey, count_if(l_returnflag = 'R')::INTEGER AS n, sum(l_quantity)::DOUBLE AS quantity, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity), '|') AS parts, last(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS last,
'final.csv' AS place, CASE WHEN o_orderkey % 2 = 0 THEN 'nick' ELSE 'user' END || o_orderkey AS name, 'it''s ' || lower(any_value(o_orderstatus)) AS note FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def _exported(spark, sf_dir):
    """A program as SQL text, run by Spark's SQL."""
    view = f"orders_{abs(hash(sf_dir))}"
    nested_orders(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(export.spark_sql([Op("set", "o_orderkey", {"source": "o_orderkey"}), *_PROGRAM], view))
