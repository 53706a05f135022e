"""Queries of pattern functions, exports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import patterns as X
from tracewright.functions import values as V
from tracewright.queries import query, table
from tracewright.sources import formats
from tracewright.streaming import streams


@query("regex_support", "SELECT count_if(regexp_matches(c_name, '^[A-Z][a-z]{7}#\\d{1,9}$')) AS matches, count(c_name) AS rows FROM customer")
def _regex(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    sample = [r["c_name"] for o in (F.asc, F.desc) for r in df.orderBy(o("c_custkey")).limit(1).collect()]
    pattern = X.synthesize(sample)
    return X.support(df, "c_name", pattern or "$^")


@query("text_numbers", "SELECT event_id, array_to_string(regexp_extract_all(props, '-?\\d+(?:\\.\\d+)?'), ',') AS numbers FROM events")
def _numbers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.array_join(X.numbers(F.col("props")), ",").alias("numbers"))


@query("text_emails", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+(?:\\.[a-zA-Z0-9_-]+)+'), ',') AS emails FROM documents")
def _emails(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.emails(F.col("text")), ",").alias("emails"))


@query("text_classify", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'brass') THEN 'metal' WHEN contains(lower(p_type), 'small') THEN 'size' END AS label FROM part")
def _classify(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", X.classified(df, "p_type", {"metal": ["steel", "brass"], "size": ["small"]}).alias("label"))


@query("text_complete", "SELECT n_nationkey, (n_nationkey + 3 * (n_regionkey + 1))::DOUBLE AS next FROM nation")
def _complete(spark, sf_dir):
    k, s = F.col("n_nationkey"), F.col("n_regionkey") + 1
    return table(spark, sf_dir, "nation").select("n_nationkey", X.next_value(F.array(k, k + s, k + 2 * s)).alias("next"))


@query("text_hash", "SELECT r_regionkey, printf('%08x', list_reduce(list_prepend(2166136261, list_transform(string_split(r_name, ''), lambda x: ascii(x)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS hash FROM region")
def _hash(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", V.text_hash(F.col("r_name")).alias("hash"))


@query("export_sql", "SELECT 'INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ');' AS statement FROM nation")
def _inserts(spark, sf_dir):
    return formats.to_inserts(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation")


@query("stream_rate_limit", "SELECT user_id, time_bucket(INTERVAL '60 seconds', ts) AS start, count(*) AS requests, greatest(count(*) - 1, 0) AS refused FROM events GROUP BY ALL")
def _rate(spark, sf_dir):
    return streams.rate_windows(table(spark, sf_dir, "events"), "user_id", "ts", most=1)


@query("stream_contract_run", "SELECT event_id, value * 100 AS cents, 'passed' AS status FROM events")
def _contract(spark, sf_dir):
    from tracewright.operators.contract import Contract
    from tracewright.plans.program import Op

    c = Contract([Op("numericTransform", "cents", {"source": "value", "mode": "multiply", "value": 100})], {"event_id": "bigint"}, key=["event_id"])
    return streams.contract_stream(c, table(spark, sf_dir, "events")).select("event_id", F.col("output.cents").alias("cents"), "status")
