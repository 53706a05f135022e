"""Divergence of sources by their terms, from exact integer sums of DuckDB over shards.

Every task counts its documents' terms in DuckDB, one slice of text at a time. Spark deals the
partial counts into shards by language and term, where DuckDB adds them up and keeps the terms of
enough documents; with the sums of all shards it then gives each shard's share of every pair's
divergence and the shard's best terms, which Spark merges.

A pair's divergence runs over all kept terms of a language, also those that one or both sources lack.
Those are never listed: with ``x0`` the value of an absent term, the sum of ``f(a, b)`` over all terms is

    sum over a's terms of f(a, b0)  +  sum over b's terms of f(a0, b)  +  (V - na - nb) f(a0, b0)
      +  sum over the terms of both of (f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0))

so a shard joins only what both sources have, and the first two sums need one row for each source
and value. All numbers are integers: the result does not depend on order or number of shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm._store import Workspace, kept
from tracewright.llm._text import slices

#: Documents of a language that must have a term; terms that are reported for a source.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Partial counts that a task holds before it adds them up, and hands them on where that leaves half as many.
HELD = 400_000
_MEMORY = "400MB"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters between terms, ``[\x00-\x40\x5B-\x60\x7B-\x7F]``.
_BETWEEN = "".join(map(chr, [*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_COUNTS = "lang string, source string, term string, n long, docs long"

_TERMS = """
INSERT INTO partial SELECT lang, source, term, sum(n)::BIGINT, count(*)::BIGINT FROM (
  SELECT d, lang, source, term, count(*) AS n FROM (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           unnest(string_split(translate(coalesce(text, ''), $1, $2), ' ')) AS term FROM slice)
  WHERE term <> '' GROUP BY ALL)
GROUP BY ALL"""

_KEPT = """
WITH c AS (SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM partial GROUP BY ALL),
     k AS (SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS of_lang, row_number() OVER (PARTITION BY lang, term ORDER BY source) AS place FROM c)
SELECT lang, source, term, n, place = 1 AS leads FROM k WHERE of_lang >= {least}"""

#: p of a source, p of an absent term, p of the language; sums of n exceed 64 bits once they are scaled.
_VALUES = """
CREATE TEMP TABLE v AS SELECT lang, source, term,
  (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * kinds))::BIGINT AS p,
  (1 + 2000000000::HUGEINT // (total + 2 * kinds))::BIGINT AS p0,
  (1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2)) // (of_lang + 2 * kinds))::BIGINT AS q
FROM counts"""

_SHARES = """
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, NULL::BIGINT AS p,
       sum({f_ab} - {f_ab0} - {f_a0b} + {f_a0b0})::BIGINT AS value, count(*)::BIGINT AS n
FROM v a JOIN v b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
UNION ALL
SELECT lang, source, 'values', NULL, p, NULL, count(*)::BIGINT FROM v GROUP BY ALL
UNION ALL
SELECT lang, source, 'term', term, NULL, value, NULL FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) AS k
  FROM (SELECT lang, source, term, {f_pq} AS value FROM v WHERE p > q)) WHERE k <= {top}"""


def _f(x: str, y: str) -> str:
    """``floor((x - y)^2 / (x + y))`` of values below 2^30 or so, which 64 bits hold."""
    return f"(({x} - {y}) * ({x} - {y}) // ({x} + {y}))"


def _connection():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": _MEMORY})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of each language, source and term of this task's documents."""
    con = _connection()
    con.execute("CREATE TABLE partial (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
    summed = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM partial GROUP BY ALL"
    lower = [_UPPER + _BETWEEN, _UPPER.lower() + " " * len(_BETWEEN)]
    held = 0
    for piece in slices(batches, most=8 << 20):
        con.register("slice", pa.Table.from_batches([piece]))
        held += con.execute(_TERMS, lower).fetchall()[0][0]
        con.unregister("slice")
        if held > HELD:
            con.execute(f"CREATE TABLE merged AS {summed}")
            con.execute("DROP TABLE partial")
            con.execute("ALTER TABLE merged RENAME TO partial")
            held = con.execute("SELECT count(*) FROM partial").fetchall()[0][0]
            if held > HELD // 2:
                yield from con.sql("SELECT * FROM partial").to_arrow_table().to_batches(max_chunksize=50_000)
                con.execute("DELETE FROM partial")
                held = 0
    yield from con.sql(summed).to_arrow_table().to_batches(max_chunksize=50_000)
    con.close()


def _shard(sqls: list[str], table: str):
    """A task that hands its shard to DuckDB and returns what the last statement gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, made = _connection(), False
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            con.execute(f"INSERT INTO {table} SELECT * FROM batch" if made else f"CREATE TABLE {table} AS SELECT * FROM batch")
            con.unregister("batch")
            made = True
        if made:
            for sql in sqls[:-1]:
                con.execute(sql)
            yield from con.sql(sqls[-1]).to_arrow_table().to_batches(max_chunksize=50_000)
        con.close()

    return run


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how each source's terms differ from other sources and its language.

    ``docs`` needs ``text, lang, source``; other columns are not read. Nulls count as empty texts, and
    an empty language or source is one like any other. Repeated rows count each, as a document of
    their own. A group without terms, or a language without kept terms, has its pairs (in the
    latter case with value 0) and no term; an empty table gives no rows. Ties of value go by the
    item's UTF-8 bytes. A shard holds its terms' counts once for each source, not once for each document.
    """
    work = Workspace(docs.sparkSession)
    try:
        return kept(_divergence(docs, least_docs, top, work), "divergence")
    finally:
        work.close()


def _divergence(docs: DataFrame, least_docs: int, top: int, work: Workspace) -> DataFrame:
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    partial = docs.select("lang", "source", "text").mapInArrow(_counted, _COUNTS)
    shard = _shard([_KEPT.format(least=least_docs)], "partial")
    counts = work.keep(partial.repartition("lang", "term").mapInArrow(shard, "lang string, source string, term string, n long, leads boolean"), "counts")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    langs = counts.groupBy("lang").agg(F.count_if("leads").alias("kinds"), F.sum("n").alias("of_lang"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = named.distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = work.keep(groups.select("lang", "source", *[zero(c) for c in ("total", "own", "kinds", "of_lang")]), "groups")
    known = counts.drop("leads").join(groups.drop("own"), ["lang", "source"])
    f = {"f_ab": _f("a.p", "b.p"), "f_ab0": _f("a.p", "b.p0"), "f_a0b": _f("a.p0", "b.p"), "f_a0b0": _f("a.p0", "b.p0"), "f_pq": _f("p", "q"), "top": top}
    share = _shard([_VALUES, _SHARES.format(**f)], "counts")
    columns = ["lang", "source", "term", "n", "total", "kinds", "of_lang"]
    shares = work.keep(known.select(*columns).repartition("lang", "term").mapInArrow(share, "lang string, source string, part string, item string, p long, value long, n long"), "shares")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    terms = terms.select("lang", "source", "part", "item", "value", "rank")

    pairs = _pairs(shares, groups, work)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)


def _pairs(shares: DataFrame, groups: DataFrame, work: Workspace) -> DataFrame:
    """lang, source, item, value of each ordered pair of a language's sources."""
    absent = F.when(F.col("kinds") > 0, F.expr("1 + 2000000000L div (total + 2 * kinds)")).otherwise(0)
    sized = groups.select("lang", "source", "own", "kinds", absent.alias("p0"))
    other = sized.select("lang", F.col("source").alias("item"), F.col("own").alias("item_own"), F.col("p0").alias("q0"))
    distinct = F.col("source") != F.col("item")
    # what a source's own terms add against the absent value of each other source: one row for each value
    values = shares.where("part = 'values'").groupBy("lang", "source", "p").agg(F.sum("n").alias("n"))
    alone = values.join(other, "lang").where(distinct).groupBy("lang", "source", "item").agg(F.sum(F.expr(f"n * ({_f_spark('p', 'q0')})")).alias("value"))
    alone = work.keep(alone, "alone")
    both = shares.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    neither = sized.join(other, "lang").where(distinct).select("lang", "source", "item", F.when(F.col("kinds") > 0, F.expr(f"(kinds - own - item_own) * ({_f_spark('p0', 'q0')})")).otherwise(0).alias("value"))
    turned = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = neither.unionByName(alone).unionByName(turned).unionByName(both)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _f_spark(x: str, y: str) -> str:
    return f"(({x} - {y}) * ({x} - {y})) div ({x} + {y})"


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank of all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT d) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(n)::HUGEINT AS total FROM c GROUP BY lang),
ps AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.total + 2 * v.v))::BIGINT AS p
       FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
pl AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(ln.total) + 2 * any_value(v.v)))::BIGINT AS q FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN ps x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN ps y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM ps JOIN pl USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, rank FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms) WHERE rank <= 10
"""
