"""Queries of the profiles over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import profile as P
from tracewright.queries import query, table

_NUM = ("l_quantity", "l_extendedprice", "l_discount")
_R = "floor({} * 10000 + 0.5) / 10000"


def _r(x: str) -> str:
    return _R.format(f"({x})")


_CAT = ("o_orderstatus", "o_orderpriority")
_LONG = "(" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c}::VARCHAR AS value FROM orders" for c in _CAT) + ")"
_NLONG = "(" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value FROM lineitem" for c in _NUM) + ")"
_SEG = "nullif(CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN '  ' ELSE c_mktsegment END, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END)"


@query("profile_completeness", f"SELECT 'seg' AS field, count(*) AS total, count(s) AS present, count(*) - count(s) AS absent, count_if(s = '') AS empty, count_if(s <> '' AND trim(s) = '') AS blank, {_r('count(s) / count(*)')} AS present_rate FROM (SELECT {_SEG} AS s FROM customer)")
def _completeness(spark, sf_dir):
    c = F.col("c_custkey")
    seg = F.nullif(F.when(c % 7 == 0, "").when(c % 11 == 0, "  ").otherwise(F.col("c_mktsegment")), F.when(c % 5 == 0, F.col("c_mktsegment")))
    return P.completeness(table(spark, sf_dir, "customer").select(seg.alias("seg")), ["seg"])


_NUMSQL = f"""
WITH v AS {_NLONG}, q AS (SELECT field, median(value) AS med FROM v GROUP BY field)
SELECT field, count(*) AS n, {_r('min(value)')} AS min, {_r('max(value)')} AS max, {_r('avg(value)')} AS mean, {_r('stddev_pop(value)')} AS stddev,
 {_r('quantile_cont(value, 0.05)')} AS p05, {_r('quantile_cont(value, 0.25)')} AS p25, {_r('median(value)')} AS median, {_r('quantile_cont(value, 0.75)')} AS p75,
 {_r('quantile_cont(value, 0.95)')} AS p95, {_r('median(abs(value - med))')} AS mad, {_r(_r('quantile_cont(value, 0.75)') + ' - ' + _r('quantile_cont(value, 0.25)'))} AS iqr,
 count_if(value = 0) AS zero, count_if(value > 0) AS positive, count_if(value < 0) AS negative
FROM v JOIN q USING (field) GROUP BY field"""


@query("profile_numeric", _NUMSQL)
def _numeric(spark, sf_dir):
    return P.numeric(table(spark, sf_dir, "lineitem"), list(_NUM))


@query("profile_mad_outliers", f"""
WITH m AS (SELECT median(value) AS med FROM events), d AS (SELECT median(abs(value - med)) AS mad FROM events, m)
SELECT event_id, value, {_r('0.6745 * (value - med) / mad')} AS z FROM events, m, d WHERE abs(0.6745 * (value - med) / mad) > 1.2""")
def _mad(spark, sf_dir):
    return P.mad_outliers(table(spark, sf_dir, "events"), ["event_id"], "value", limit=1.2)


@query("profile_zscore_outliers", f"""
WITH s AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderpriority, o_totalprice AS value, {_r('(o_totalprice - m) / s')} AS z FROM orders JOIN s ON p = o_orderpriority WHERE abs((o_totalprice - m) / s) > 1.6""")
def _zscore(spark, sf_dir):
    return P.zscore_outliers(table(spark, sf_dir, "orders"), ["o_orderkey"], "o_totalprice", limit=1.6, by=["o_orderpriority"])


@query("profile_histogram", f"""
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, {_r('quantile_cont(o_totalprice, 0.75)')} - {_r('quantile_cont(o_totalprice, 0.25)')} AS iqr FROM orders),
k AS (SELECT lo, hi, greatest(8, least(24, ceil((hi - lo) / (2 * iqr / cbrt(n)))))::INTEGER AS k FROM s), w AS (SELECT *, (hi - lo) / k AS w FROM k),
c AS (SELECT least(floor((o_totalprice - lo) / w), k - 1)::INTEGER AS bin, count(*) AS n FROM orders, w GROUP BY 1)
SELECT b.bin, {_r('lo + b.bin * w')} AS low, {_r('lo + (b.bin + 1) * w')} AS high, coalesce(n, 0) AS n
FROM (SELECT unnest(range(0, k))::INTEGER AS bin, lo, w FROM w) b LEFT JOIN c USING (bin)""")
def _histogram(spark, sf_dir):
    return P.histogram(table(spark, sf_dir, "orders"), "o_totalprice")


@query("profile_categorical_topk", f"""
WITH c AS (SELECT field, value, count(*) AS n FROM {_LONG} GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY field) AS total, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c)
SELECT field, rank, value, n, {_r('n / total')} AS share FROM t WHERE rank <= 8""")
def _categories(spark, sf_dir):
    return P.categories(table(spark, sf_dir, "orders"), list(_CAT))


@query("profile_entropy", f"""
WITH c AS (SELECT field, value, count(*) AS n FROM {_LONG} GROUP BY ALL), t AS (SELECT field, count(*) AS d, sum(n) AS n, sum(n * log2(n)) AS s FROM c GROUP BY field)
SELECT field, d AS "distinct", {_r('d / n')} AS distinct_ratio, CASE WHEN d > 1 THEN {_r('(log2(n) - s / n) / log2(d)')} ELSE 0 END AS entropy FROM t""")
def _entropy(spark, sf_dir):
    return P.entropy(table(spark, sf_dir, "orders"), list(_CAT))


@query("profile_string_lengths", f"""
SELECT 'p_name' AS field, {_r('min(length(p_name))')} AS min, {_r('median(length(p_name))')} AS median, {_r('quantile_cont(length(p_name), 0.95)')} AS p95, {_r('max(length(p_name))')} AS max FROM part
UNION ALL SELECT 'p_type', {_r('min(length(p_type))')}, {_r('median(length(p_type))')}, {_r('quantile_cont(length(p_type), 0.95)')}, {_r('max(length(p_type))')} FROM part""")
def _lengths(spark, sf_dir):
    return P.string_lengths(table(spark, sf_dir, "part"), ["p_name", "p_type"])


@query("profile_patterns", "SELECT 'url' AS field, 'url-like' AS pattern, 1.0::DOUBLE AS share FROM pages HAVING avg(CASE WHEN regexp_matches(url, '^https?://\\S+$') THEN 1.0 ELSE 0.0 END) >= 0.9")
def _patterns(spark, sf_dir):
    return P.patterns(table(spark, sf_dir, "pages"), ["url"])


_GAPS = """
WITH t AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS ms FROM events), g AS (SELECT *, lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS f FROM t),
s AS (SELECT user_id, max(ms) - min(ms) AS span FROM t GROUP BY 1), m AS (SELECT user_id, median(ms - f) AS med FROM g WHERE f IS NOT NULL GROUP BY 1)
SELECT user_id, f AS from_ms, ms AS to_ms, ms - f AS gap FROM g JOIN s USING (user_id) JOIN m USING (user_id) WHERE f IS NOT NULL AND ms - f > 3 * med AND ms - f > 0.05 * span"""


@query("profile_temporal_gaps", _GAPS)
def _gaps(spark, sf_dir):
    return P.temporal_gaps(table(spark, sf_dir, "events"), "ts", ["user_id"])


@query("profile_temporal_gaps_all", """
WITH t AS (SELECT DISTINCT epoch_us(ts) // 1000 AS ms FROM events), g AS (SELECT ms, lag(ms) OVER (ORDER BY ms) AS f FROM t), s AS (SELECT max(ms) - min(ms) AS span FROM t), m AS (SELECT median(ms - f) AS med FROM g WHERE f IS NOT NULL)
SELECT f AS from_ms, ms AS to_ms, ms - f AS gap FROM g, s, m WHERE f IS NOT NULL AND ms - f > 3 * med AND ms - f > 0.0005 * span""")
def _gaps_all(spark, sf_dir):
    return P.temporal_gaps(table(spark, sf_dir, "events"), "ts", least_share=0.0005)


@query("profile_duplicates", "SELECT o_custkey, o_orderstatus, count(*) AS copies FROM orders GROUP BY ALL HAVING count(*) > 1")
def _duplicates(spark, sf_dir):
    return P.duplicates(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query("profile_roles", """SELECT * FROM (VALUES ('c_custkey', 'identifier'), ('c_name', 'identifier'), ('c_nationkey', 'numeric-measure'), ('c_acctbal', 'numeric-measure'), ('c_mktsegment', 'category')) t(field, role)
JOIN (SELECT 'c_custkey' AS field, count(DISTINCT c_custkey) AS "distinct" FROM customer UNION ALL SELECT 'c_name', count(DISTINCT c_name) FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal) FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer) USING (field)""")
def _roles(spark, sf_dir):
    return P.roles(table(spark, sf_dir, "customer"))


@query("profile_insights")
def _insights(spark, sf_dir):
    return P.insights(table(spark, sf_dir, "customer"))


@query("fingerprint_rows", """
WITH j AS (SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS t FROM nation),
c AS (SELECT n_nationkey, list_transform(string_split(t, ''), lambda x: ascii(x)::BIGINT) AS u FROM j)
SELECT n_nationkey, printf('%08x', list_reduce(list_prepend(2166136261, u), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) || printf('%08x', list_reduce(list_prepend(16777619, u), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS fingerprint FROM c""")
def _fingerprints(spark, sf_dir):
    return P.fingerprints(table(spark, sf_dir, "nation"), ["n_name", "n_nationkey", "n_regionkey"]).select("n_nationkey", "fingerprint")


@query("profile_digest")
def _digest(spark, sf_dir):
    return P.dataset_digest(table(spark, sf_dir, "orders"))
