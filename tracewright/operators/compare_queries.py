"""Queries of the comparisons: lineitem by return flag, and orders against a changed copy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import compare as C
from tracewright.operators import profile as P
from tracewright.queries import query, table


def versions(spark, sf_dir: str):
    """Orders, and a copy with some rows gone, some new and some changed."""
    a = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    b = a.where(k % 101 != 0).withColumn("o_totalprice", F.when(k % 97 == 0, F.col("o_totalprice") + 10).when(k % 89 == 0, F.col("o_totalprice") + 0.004).otherwise(F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(k % 83 == 0, "X").otherwise(F.col("o_orderstatus")))
    new = a.where(k % 103 == 0).withColumn("o_orderkey", -k)
    return a, b.unionByName(new)


_B = """b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 83 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 10 WHEN o_orderkey % 89 = 0 THEN o_totalprice + 0.004 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
 FROM orders WHERE o_orderkey % 101 <> 0 UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 103 = 0)"""


def _keyed_sql(price: str) -> str:
    return f"""WITH {_B}, j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey AS ka, b.o_orderkey AS kb,
 array_to_string(list_filter([CASE WHEN a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'o_custkey' END, CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN {price} THEN 'o_totalprice' END], lambda x: x IS NOT NULL), ',') AS f
 FROM orders a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, CASE WHEN ka IS NULL THEN 'added' WHEN kb IS NULL THEN 'removed' WHEN f <> '' THEN 'changed' ELSE 'unchanged' END AS status, CASE WHEN ka IS NULL OR kb IS NULL THEN '' ELSE f END AS fields FROM j"""


@query("compare_rows_keyed", _keyed_sql("a.o_totalprice IS DISTINCT FROM b.o_totalprice"))
def _keyed(spark, sf_dir):
    return C.rows_keyed(*versions(spark, sf_dir), ["o_orderkey"])


@query("compare_tolerant", _keyed_sql("abs(a.o_totalprice - b.o_totalprice) > 0.01"))
def _tolerant(spark, sf_dir):
    return C.rows_keyed(*versions(spark, sf_dir), ["o_orderkey"], absolute=0.01)


@query("compare_rows_positional", """SELECT l_linenumber AS place, CASE WHEN count(*) > 1 THEN 'duplicate-key' ELSE 'unchanged' END AS status, '' AS fields FROM lineitem GROUP BY l_linenumber""")
def _positional(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("place"), "l_quantity")
    return C.rows_positional(a, a, "place")


@query("compare_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _duplicate(spark, sf_dir):
    return C.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("compare_ks", """
WITH c AS (SELECT l_extendedprice AS v, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
r AS (SELECT v, sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c)
SELECT max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b, floor(max(abs(ca / na - cb / nb)) * 10000 + 0.5) / 10000 AS ks FROM r""")
def _ks(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return C.ks(x.where("l_returnflag = 'A'"), x.where("l_returnflag = 'R'"), "l_extendedprice")


@query("compare_jsd", """
WITH c AS (SELECT l_linestatus || l_shipdate::DATE AS v, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c)
SELECT floor(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END / 2 + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END / 2) * 10000 + 0.5) / 10000 AS jsd FROM p""")
def _jsd(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumn("v", F.concat("l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd")))
    return C.jsd(x.where("l_returnflag = 'A'"), x.where("l_returnflag = 'R'"), "v")


@query("compare_fields", """SELECT * FROM (VALUES ('c_custkey', 'same', 'bigint', 'bigint', 1.0, 1.0), ('c_name', 'removed', 'string', NULL, 1.0, NULL), ('c_acctbal', 'type-changed', 'double', 'string', 1.0, 1.0), ('extra', 'added', NULL, 'int', NULL, 1.0)) t(field, status, type_a, type_b, present_a, present_b)
UNION ALL SELECT 'c_mktsegment', 'presence-changed', 'string', 'string', 1.0, floor(count(CASE WHEN c_custkey % 10 <> 0 THEN 1 END) / count(*) * 10000 + 0.5) / 10000 FROM customer""")
def _fields(spark, sf_dir):
    a = table(spark, sf_dir, "customer").drop("c_nationkey")
    b = a.drop("c_name").withColumn("c_acctbal", F.col("c_acctbal").cast("string")).withColumn("extra", F.lit(1)).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")))
    return C.fields(a, b)


@query("compare_order_changed", "SELECT true AS order_changed")
def _order(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("p"))
    return C.order_changed(a, a.withColumn("p", -F.col("p")), "o_orderkey", "p")


@query("structural_diff", f"""WITH {_B}, x AS (UNPIVOT (SELECT o_orderkey, o_orderstatus::VARCHAR AS o_orderstatus, o_orderpriority::VARCHAR AS o_orderpriority FROM orders) ON o_orderstatus, o_orderpriority INTO NAME path VALUE v),
y AS (UNPIVOT (SELECT o_orderkey, o_orderstatus::VARCHAR AS o_orderstatus, o_orderpriority::VARCHAR AS o_orderpriority FROM b) ON o_orderstatus, o_orderpriority INTO NAME path VALUE v)
SELECT coalesce(x.o_orderkey, y.o_orderkey) AS o_orderkey, coalesce(x.path, y.path) AS path, CASE WHEN x.v IS NULL THEN 'add' WHEN y.v IS NULL THEN 'remove' WHEN x.v <> y.v THEN 'change' ELSE 'same' END AS status FROM x FULL JOIN y ON x.o_orderkey = y.o_orderkey AND x.path = y.path""")
def _structural(spark, sf_dir):
    a, b = (d.select("o_orderkey", "o_orderstatus", "o_orderpriority") for d in versions(spark, sf_dir))
    return C.structural_diff(a, b, "o_orderkey")


def nested(spark, sf_dir):
    """Both versions with a record and a list in place of flat fields."""
    head = F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("id")).alias("cust")).alias("head")
    return (d.select("o_orderkey", head, F.array("o_orderpriority", "o_orderstatus").alias("tags")) for d in versions(spark, sf_dir))


_LEAVES = """SELECT o_orderkey, unnest(['head.status', 'head.cust.id', 'tags[0]', 'tags[1]']) AS path, unnest([o_orderstatus, o_custkey::VARCHAR, o_orderpriority, o_orderstatus]) AS v FROM"""


@query("structural_diff_nested", f"""WITH {_B}, x AS ({_LEAVES} orders), y AS ({_LEAVES} b)
SELECT coalesce(x.o_orderkey, y.o_orderkey) AS o_orderkey, coalesce(x.path, y.path) AS path, CASE WHEN x.v IS NULL THEN 'add' WHEN y.v IS NULL THEN 'remove' WHEN x.v <> y.v THEN 'change' ELSE 'same' END AS status FROM x FULL JOIN y ON x.o_orderkey = y.o_orderkey AND x.path = y.path""")
def _structural_nested(spark, sf_dir):
    return C.structural_diff(*nested(spark, sf_dir), "o_orderkey")


@query("compare_nested_changes", f"""WITH {_B}, x AS ({_LEAVES} orders), y AS ({_LEAVES} b)
SELECT x.o_orderkey, x.path, x.v AS before, y.v AS after FROM x JOIN y ON x.o_orderkey = y.o_orderkey AND x.path = y.path WHERE x.v <> y.v AND x.path NOT LIKE 'tags[%'""")
def _nested_changes(spark, sf_dir):
    return C.nested_changes(*nested(spark, sf_dir), "o_orderkey", ignore=("tags",))


@query("profile_structure", """SELECT * FROM (SELECT 'object' AS kind, 2 * count(*) AS n, 2 AS deepest, NULL::INT AS longest, 0::BIGINT AS record_arrays FROM orders UNION ALL SELECT 'array', count(*), 1, 2, 0 FROM orders
UNION ALL SELECT 'string', 3 * count(*), 2, NULL, 0 FROM orders UNION ALL SELECT 'number', 2 * count(*), 3, NULL, 0 FROM orders)""")
def _structure(spark, sf_dir):
    return P.structure(next(nested(spark, sf_dir)))


@query("compare_shifts", f"""WITH {_B}, c AS (SELECT v, sum(x)::DOUBLE AS a, sum(y)::DOUBLE AS b FROM (SELECT o_totalprice AS v, 1 AS x, 0 AS y FROM orders UNION ALL SELECT o_totalprice, 0, 1 FROM b) GROUP BY v),
r AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS p, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS q FROM c), k AS (SELECT floor(max(abs(p - q)) * 10000 + 0.5) / 10000 AS ks FROM r),
m AS (SELECT (SELECT avg(o_totalprice) FROM orders) AS x, (SELECT avg(o_totalprice) FROM b) AS y),
s AS (SELECT v, sum(x)::DOUBLE AS a, sum(y)::DOUBLE AS b FROM (SELECT o_orderstatus AS v, 1 AS x, 0 AS y FROM orders UNION ALL SELECT o_orderstatus, 0, 1 FROM b) GROUP BY v),
n AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM s), j AS (SELECT floor(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END / 2 + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END / 2) * 10000 + 0.5) / 10000 AS jsd FROM n)
SELECT 'o_totalprice' AS field, 'numeric' AS kind, floor(x * 10000 + 0.5) / 10000 AS before, floor(y * 10000 + 0.5) / 10000 AS after, floor((y - x) * 10000 + 0.5) / 10000 AS delta, ks AS distance, 0::BIGINT AS new, 0::BIGINT AS lost, ks >= 0.2 AS shifted FROM m, k
UNION ALL SELECT 'o_orderstatus', 'categorical', count_if(a > 0)::DOUBLE, count_if(b > 0)::DOUBLE, (count_if(b > 0) - count_if(a > 0))::DOUBLE, any_value(jsd), count_if(a = 0), count_if(b = 0), any_value(jsd) >= 0.1 FROM s, j""")
def _shifts(spark, sf_dir):
    return C.shifts(*versions(spark, sf_dir), ["o_totalprice"], ["o_orderstatus"])
