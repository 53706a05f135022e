"""Queries of documents of any shape: JSON texts made of orders and events, with fields that come, go and change type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import documents as D
from tracewright.operators import profile as P
from tracewright.queries import query, table


def texts(spark, sf_dir) -> DataFrame:
    """An order as JSON text: lines as an array of records, a total that is a text on every seventh, a note on every third."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("flag")))).alias("lines"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey")
    total = F.when(k % 7 == 0, F.concat(F.lit('"'), F.col("o_custkey").cast("string"), F.lit('"'))).otherwise(F.col("o_custkey").cast("string"))
    note = F.when(k % 3 == 0, F.when(k % 2 == 0, F.lit(',"note":""')).otherwise(F.lit(',"note":"  "'))).otherwise(F.lit(""))
    json = F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"total":'), total, F.lit(',"who":{"status":"'), F.col("o_orderstatus"), F.lit('","vip":'), F.when(k % 5 == 0, "null").otherwise("true"), F.lit("}"), note, F.lit(',"lines":'), F.to_json("lines"), F.lit("}"))
    return o.select("o_orderkey", json.alias("doc"))


_L = "WITH o AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus, n, even FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END) AS even FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey), "


@query("document_leaves", _L + """
x AS (SELECT count(*) AS n, sum(n)::BIGINT AS l, sum(even)::BIGINT AS e, count_if(k % 3 = 0) AS note, count_if(k % 6 = 0) AS blank, count_if(k % 5 = 0) AS nul, count_if(k % 7 = 0) AS t FROM o)
SELECT '$.id' AS path, 'integer' AS types, n AS records, n AS present, 0 AS "null", 0 AS empty, 0 AS whitespace FROM x
UNION ALL SELECT '$.total', 'integer,string', n, n, 0, 0, 0 FROM x UNION ALL SELECT '$.who.status', 'string', n, n, 0, 0, 0 FROM x UNION ALL SELECT '$.who.vip', 'boolean,null', n, n, nul, 0, 0 FROM x
UNION ALL SELECT '$.note', 'string', n, note, 0, blank, note - blank FROM x UNION ALL SELECT '$.lines[].no', 'integer', l, l, 0, 0, 0 FROM x UNION ALL SELECT '$.lines[].part', 'integer', l, l, 0, 0, 0 FROM x UNION ALL SELECT '$.lines[].flag', 'string', l, e, 0, 0, 0 FROM x""")
def _leaves(spark, sf_dir):
    return D.leaf_profile(D.nodes(texts(spark, sf_dir), ["o_orderkey"], "doc"))


@query("document_record_sets", _L + "f AS (SELECT *, 2 + (even >= 0.5 * n)::INT AS s FROM o WHERE n >= 2) SELECT k AS o_orderkey, '$.lines' AS at, n AS rows, s AS shared, n * 100 - 10 + s AS score, 1::INTEGER AS rank FROM f")
def _sets(spark, sf_dir):
    return D.record_sets(D.nodes(texts(spark, sf_dir), ["o_orderkey"], "doc"), ["o_orderkey"]).drop("path")


@query("document_records", "SELECT o_orderkey, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def _records(spark, sf_dir):
    found = D.records(D.nodes(texts(spark, sf_dir), ["o_orderkey"], "doc"), ["o_orderkey"], "$.lines")
    return found.select("o_orderkey", F.variant_get("record", "$.part", "bigint").alias("part"))


@query("document_schema", _L + """
x AS (SELECT count(*) AS n, sum(n)::BIGINT AS l, sum(even)::BIGINT AS e, count_if(k % 3 = 0) AS note, count_if(k % 5 = 0) AS nul, count_if(k % 7 = 0) AS t FROM o)
SELECT '$' AS path, 'object' AS type, n FROM x UNION ALL SELECT '$.id', 'integer', n FROM x UNION ALL SELECT '$.total', 'string', t FROM x UNION ALL SELECT '$.total', 'integer', n - t FROM x UNION ALL SELECT '$.who', 'object', n FROM x
UNION ALL SELECT '$.who.status', 'string', n FROM x UNION ALL SELECT '$.who.vip', 'null', nul FROM x UNION ALL SELECT '$.who.vip', 'boolean', n - nul FROM x UNION ALL SELECT '$.note', 'string', note FROM x UNION ALL SELECT '$.lines', 'array', n FROM x
UNION ALL SELECT '$.lines[]', 'object', l FROM x UNION ALL SELECT '$.lines[].no', 'integer', l FROM x UNION ALL SELECT '$.lines[].part', 'integer', l FROM x UNION ALL SELECT '$.lines[].flag', 'string', e FROM x""")
def _schema(spark, sf_dir):
    return D.shape_counts(D.nodes(texts(spark, sf_dir), ["o_orderkey"], "doc")).select("path", "type", "n")


@query("document_violations", _L + """
b AS (SELECT k, k % 7 = 0 AS t, k % 5 = 0 AS v, o_orderstatus = 'P' AS p FROM o)
SELECT k AS o_orderkey, '$.total' AS at, 'type string' AS problem FROM b WHERE t UNION ALL SELECT k, '$.who.vip', 'type null' FROM b WHERE v UNION ALL SELECT k, '$.who.status', 'value' FROM b WHERE p
UNION ALL SELECT k, '$', 'missing note' FROM b WHERE k % 3 <> 0 UNION ALL SELECT o_orderkey, '$.lines[' || place || '].flag', 'unknown field' FROM (SELECT o_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END NULLS FIRST) - 1 AS place FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE l_linenumber % 2 = 0 AND l_returnflag IS NOT NULL""")
def _violations(spark, sf_dir):
    """Documents against a schema that is stricter than they are."""
    scalar = lambda t, **m: D.Shape([t], **m)
    line = D.Shape(["object"], {"no": scalar("integer"), "part": scalar("number")}, ["no", "part"])
    who = D.Shape(["object"], {"status": scalar("string", values=["F", "O"]), "vip": scalar("boolean")}, ["status"])
    wanted = D.Shape(["object"], {"id": scalar("integer"), "total": scalar("number"), "who": who, "note": scalar("string"), "lines": D.Shape(["array"], items=line)}, ["id", "note"])
    return D.violations(D.nodes(texts(spark, sf_dir), ["o_orderkey"], "doc"), ["o_orderkey"], wanted, closed=True)


@query("document_mixed_types", "SELECT 'mixed-types' AS kind, '$.total' AS field, 'integer,string' AS types FROM (SELECT count_if(o_orderkey % 7 = 0) AS t, count(*) AS n FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey) WHERE t > 0 AND t < n")
def _mixed(spark, sf_dir):
    return P.mixed_types(D.leaf_profile(D.nodes(texts(spark, sf_dir), ["o_orderkey"], "doc")))
