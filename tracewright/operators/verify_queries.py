"""Queries of inference and verification over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import infer as I
from tracewright.operators import verify as R
from tracewright.plans.program import Op
from tracewright.queries import query, table


def batch(spark, sf_dir: str):
    """Orders and what a job made of them, wrong on every 997th order."""
    a = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "dd/MM/yyyy")).drop("o_orderdate", "o_custkey")
    bad = F.col("o_orderkey") % 997 == 0
    label = F.element_at(F.create_map(*[F.lit(x) for x in ("F", "finished", "O", "open", "P", "pending")]), F.col("o_orderstatus"))
    b = a.select(
        "o_orderkey",
        F.when(bad, "lost").otherwise(label).alias("label"),
        (F.col("o_totalprice") * 100).alias("cents"),
        F.date_format(F.to_date("day", "dd/MM/yyyy"), "yyyy-MM-dd").alias("date"),
        F.when(bad & (F.col("o_orderkey") % 2 == 0), "?").otherwise(F.lower("o_orderpriority")).alias("priority"),
    )
    return a, b


_FLAGGED = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'label,priority' ELSE 'label' END AS targets FROM orders WHERE o_orderkey % 997 = 0"


@query("verify_flagged_rows", _FLAGGED)
def flagged(spark, sf_dir):
    return R.verify(*batch(spark, sf_dir), ["o_orderkey"]).flagged


@query("verify_dominant_inputs", """
WITH c AS (SELECT o_orderpriority, o_orderstatus AS output, count(*) AS rows FROM orders GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY rows DESC) AS k FROM c)
SELECT o_orderpriority, min(output) AS output, max(rows) AS rows, count(*) > 1 AS tied FROM r WHERE k = 1 GROUP BY 1""")
def _dominant(spark, sf_dir):
    return R.dominant_inputs(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus")


@query("verify_permutation_guard", "SELECT true AS permuted")
def _permuted(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    swap = F.when(F.col("c_custkey") == 1, 2).when(F.col("c_custkey") == 2, 1).otherwise(F.col("c_custkey"))
    b = a.select(swap.alias("c_custkey"), F.col("c_name").alias("w"))
    rule = I.Rule("w", Op("set", "w", {"source": "c_name"}), "dominant")
    return spark.range(1).select(F.lit(R.permutation(a.join(b, "c_custkey"), rule, "w")).alias("permuted"))


@query("infer_support", "SELECT 'upper' AS rule, count_if(upper(c_mktsegment) = c_mktsegment) AS matches, count(*) AS rows FROM customer UNION ALL SELECT 'split', count_if(coalesce(string_split(c_name, '#')[2], '') = c_custkey::VARCHAR), count(*) FROM customer")
def _support(spark, sf_dir):
    d = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey").cast("string"))
    tests = [("c_mktsegment", Op("stringCase", "x", {"source": "c_mktsegment", "mode": "upper"})), ("k", Op("splitPart", "x", {"source": "c_name", "separator": "#", "index": 1}))]
    agg = d.agg(*[F.struct(F.count_if(compiledmatch).alias("m"), F.count(F.lit(1)).alias("n")).alias(n) for n, compiledmatch in (("upper", _exact(*tests[0])), ("split", _exact(*tests[1])))])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n)["m"].alias("matches"), F.col(n)["n"].alias("rows")) for n in ("upper", "split")])).alias("r")).select("r.*")


def _exact(column, op):
    from tracewright.plans.program import compiled

    return compiled(op) == F.col(column)


@query("infer_value_map_dominant", """
WITH c AS (SELECT event_type AS source, user_id % 5 AS output, count(*) AS agree FROM events GROUP BY ALL), r AS (SELECT *, sum(agree) OVER (PARTITION BY source)::BIGINT AS rows, rank() OVER (PARTITION BY source ORDER BY agree DESC) AS k FROM c),
t AS (SELECT *, count(*) OVER (PARTITION BY source) AS tied FROM r WHERE k = 1)
SELECT source, output, rows, agree FROM t WHERE tied = 1""")
def _map(spark, sf_dir):
    d = table(spark, sf_dir, "events").withColumn("m", F.col("user_id") % 5)
    return I.lookup_counts(d, "event_type", "m")


@query("infer_conflicts", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS outputs FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def _conflicts(spark, sf_dir):
    return I.conflicts(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query("infer_memorisation", """SELECT 'o_orderkey' AS source, count(DISTINCT o_orderkey) AS "distinct", count(o_orderkey)::BIGINT AS rows, count(DISTINCT o_orderkey) >= 0.5 * count(o_orderkey) AS memorised FROM orders
UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), count(o_orderstatus)::BIGINT, count(DISTINCT o_orderstatus) >= 0.5 * count(o_orderstatus) FROM orders""")
def _memorised(spark, sf_dir):
    return I.memorisation(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"])


@query("infer_domain_guard", "SELECT 'guard' AS guard, count(*) AS rows FROM orders WHERE o_orderstatus = 'F'")
def _guard(spark, sf_dir):
    d = table(spark, sf_dir, "orders").withColumn("guard", F.when(F.col("o_orderstatus") == "F", F.lit(1))).withColumn("out", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return I.domain_guards(d, ["guard", "o_custkey"], "out")


@query("infer_rules", "SELECT * FROM (VALUES ('cents', 'numericTransform', 'exact'), ('date', 'stringNormalize', 'exact'), ('label', 'valueMap', 'dominant'), ('priority', 'stringCase', 'dominant')) t(target, op, status)")
def _rules(spark, sf_dir):
    pairs, inputs, outputs = R.aligned(*batch(spark, sf_dir), ["o_orderkey"])
    found = I.infer(pairs, ["o_orderkey", *inputs], outputs)
    return spark.createDataFrame([(r.target, r.op.kind if r.op else None, r.status) for r in found], "target string, op string, status string")


@query("infer_schema_drift", "SELECT * FROM (VALUES ('c_name', 'string', NULL, 'blocking'), ('c_acctbal', 'double', 'string', 'advisory'), ('extra', NULL, 'int', 'advisory')) t(path, was, now, drift)")
def _drift(spark, sf_dir):
    a = table(spark, sf_dir, "customer")
    b = a.drop("c_name").withColumn("c_acctbal", F.col("c_acctbal").cast("string")).withColumn("extra", F.lit(1))
    return I.drift(a, b, ["c_name"])
