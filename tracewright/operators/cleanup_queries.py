"""Queries of cleanup suggestions, change ledgers and insights of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import cleanup as C
from tracewright.operators import profile as P
from tracewright.plans.program import Op
from tracewright.queries import query, table


def untidy(spark, sf_dir):
    """Orders as texts, as a spreadsheet would give them."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("price"),
        F.lpad(k.cast("string"), 10, "0").alias("code"),
        F.concat(F.lit(" "), F.when(k % 2 == 0, "True").otherwise("false")).alias("paid"),
        F.struct(F.concat_ws("; ", "o_orderpriority", "o_orderstatus").alias("tags"), F.when(k % 9 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("weight")).alias("more"),
    )


@query("cleanup_suggestions", "SELECT 'coerce-number' AS kind, 'price' AS path, count(*) AS \"values\", NULL AS separator FROM orders UNION ALL SELECT 'coerce-boolean', 'paid', count(*), NULL FROM orders UNION ALL SELECT 'split-array', 'more.tags', count(*), ';' FROM orders")
def _suggested(spark, sf_dir):
    found = C.suggestions(untidy(spark, sf_dir))
    return spark.createDataFrame([(s.kind, s.path, s.values, s.separator) for s in found], "kind string, path string, `values` long, separator string")


@query("cleanup_applied", "SELECT o_orderkey, round(o_totalprice, 2) AS price, o_orderkey % 2 = 0 AS paid, lpad(o_orderkey::VARCHAR, 10, '0') AS code, o_orderpriority || '|' || o_orderstatus AS tags FROM orders")
def _applied(spark, sf_dir):
    df = untidy(spark, sf_dir)
    return C.cleaned(df, C.suggestions(df)).select("o_orderkey", "price", "paid", "code", F.array_join("more.tags", "|").alias("tags"))


@query("change_ledger", """SELECT 'key' AS target, 'set' AS op, 'moved' AS effect, count(*) AS rows, 0 AS changed, 0 AS empty, NULL AS example_key FROM orders
UNION ALL SELECT 'priority', 'stringCase', 'changed', count(*), count_if(lower(o_orderpriority) <> o_orderpriority), 0, min(CASE WHEN lower(o_orderpriority) <> o_orderpriority THEN o_orderkey END)::VARCHAR FROM orders
UNION ALL SELECT 'kind', 'constant', 'new', count(*), count(*), 0, min(o_orderkey)::VARCHAR FROM orders
UNION ALL SELECT 'name', 'valueMap', 'changed', count(*), count(*), count_if(o_orderstatus <> 'F'), min(o_orderkey)::VARCHAR FROM orders""")
def _ledger(spark, sf_dir):
    program = [Op("set", "key", {"source": "o_orderkey"}), Op("stringCase", "priority", {"source": "o_orderpriority", "mode": "lower"}), Op("constant", "kind", {"value": "order"}), Op("valueMap", "name", {"source": "o_orderstatus", "map": {"F": "finished"}})]
    return C.ledger(table(spark, sf_dir, "orders"), program, "o_orderkey").drop("before", "after")


@query("profile_row_insights", """WITH v AS (SELECT event_id, value, (event_id // 2) % 500 AS bucket FROM events), m AS (SELECT median(value) AS med FROM v), d AS (SELECT median(abs(value - med)) AS mad FROM v, m),
t AS (SELECT DISTINCT epoch_us(ts) // 1000 AS ms FROM events), g AS (SELECT ms - lag(ms) OVER (ORDER BY ms) AS gap FROM t), s AS (SELECT max(ms) - min(ms) AS span FROM t), q AS (SELECT median(gap) AS med FROM g WHERE gap IS NOT NULL),
r AS (SELECT 'unusual-numeric' AS kind, 'value' AS field, count(*) AS n FROM v, m, d WHERE abs(0.6745 * (value - med) / mad) > 3.5
UNION ALL SELECT 'temporal-gap', 'ts', count(*) FROM g, s, q WHERE gap > 3 * med AND gap > 0.05 * span
UNION ALL SELECT 'duplicate-records', '$', coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM events GROUP BY user_id, event_type))
SELECT * FROM r WHERE n > 0""")
def _rows(spark, sf_dir):
    return P.row_insights(table(spark, sf_dir, "events"), ["event_id"], numeric_fields=["value"], temporal_fields=["ts"], record=["user_id", "event_type"]).select("kind", "field", F.col("affected").alias("n"))
