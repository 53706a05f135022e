"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within its source, documents are dealt into
ranges of that key, each range is sorted, and prefix sums of the ranges' token counts
are added to the running sums inside each range, so no task ever holds a source.
A document's place in its source's order then tells how much of it the budget takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm._store import kept

#: Relative weights of the sources, in order of their names, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    blank = "\t\n\x0b\x0c\r"
    spaced = F.translate(text, blank, " " * len(blank))
    # the starts of words: a character after a blank, or the first one
    squeezed = F.regexp_replace(F.trim(spaced), " {2,}", " ")
    inner = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.when(F.length(squeezed) > 0, inner + 1).otherwise(0).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most_epochs: int = 3) -> DataFrame:
    """``source, source_size`` -> also ``target``: shares by weight, none above its cap.

    Filling all sources at a common level ``l`` gives ``min(cap, weight * l)``. Ordered by
    ``cap / weight``, the capped ones are a prefix; prefix sums give the level. The cap is
    ``most_epochs`` times the size, so the caps always hold the total.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("_k", (F.row_number().over(by_name) - 1) % len(weights))
    w = w.withColumn("_w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), F.col("_k") + 1).cast("double"))
    w = w.withColumn("_cap", (F.col("source_size") * most_epochs).cast("double"))
    w = w.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn("_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_after", F.sum("_w").over(after))
    w = w.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    w = w.withColumn("_full", F.col("_ratio") * F.col("_after") + F.col("_before") <= F.col("_total"))
    level = (F.col("_total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0.0))) / F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everything)
    w = w.withColumn("_level", level)
    return w.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_w") * F.col("_level"), F.col("_cap"))).alias("target"))


def mixed(docs: DataFrame, seed: int = 0, weights=WEIGHTS, most_epochs: int = 3, rows_per_range: int = 20_000) -> DataFrame:
    """All columns of ``docs`` and ``_size, _source_size, _target, _taken``.

    ``docs`` needs ``doc_id, text, source``; other columns pass through, whatever their names
    (but for names that begin with ``_mix``). A null text has size 0; a null id or source is a
    value like any other; repeated rows count each. Every document is taken
    ``floor(budget / source_size)`` times whole; in key order the rest of the budget takes
    whole documents once more, and the one that crosses the exact budget in part.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # Only ids, sizes and keys are shuffled; the texts join at the end, by those who need them.
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("_mix_size")).withColumn("_mix_key", key)
    return _placed(slim, weights, most_epochs, rows_per_range)


def _placed(slim: DataFrame, weights, most_epochs: int, rows_per_range: int) -> DataFrame:
    slim = kept(slim, "mix-sizes")
    by_source = slim.groupBy("source").agg(F.sum("_mix_size").alias("source_size"), F.count(F.lit(1)).alias("_mix_rows"))
    largest = by_source.agg(F.max("_mix_rows")).first()[0] or 1  # one number: how finely to cut
    ranges = max(16, min(1 << 24, -(-largest // rows_per_range)))
    goals = targets(by_source.select("source", "source_size"), weights, most_epochs)
    # the first 28 bits of the key, scaled to the number of ranges: ranges ascend with the key
    cut = F.floor(F.conv(F.substring("_mix_key", 1, 7), 16, 10).cast("long") * ranges / (1 << 28)).cast("long")
    ranged = slim.withColumn("_mix_range", cut).withColumn("_mix_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    sums = ranged.groupBy("_mix_source", "_mix_range").agg(F.sum("_mix_size").alias("_mix_sum"), F.first("source").alias("source"))
    ahead = Window.partitionBy("_mix_source").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("_mix_base", F.coalesce(F.sum("_mix_sum").over(ahead), F.lit(0)))
    bases = bases.join(goals.withColumnRenamed("source", "_mix_goal"), F.col("source").eqNullSafe(F.col("_mix_goal"))).select("_mix_source", "_mix_range", "_mix_base", "source_size", "target")
    within = Window.partitionBy("_mix_source", "_mix_range").orderBy("_mix_key", "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.withColumn("_mix_run", F.coalesce(F.sum("_mix_size").over(within), F.lit(0)))
    placed = run.join(bases, ["_mix_source", "_mix_range"])
    before, size = F.col("_mix_base") + F.col("_mix_run"), F.col("_mix_size")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    extra = F.greatest(F.lit(0), F.least(size, budget - epochs * F.col("source_size") - before))
    return placed.select("doc_id", "source", size.alias("size"), "source_size", "target", (epochs * size + extra).cast("long").alias("taken"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy taken, the copy that crosses a budget cut to its first words.

    Copies keep the columns of ``docs``; a cut copy's words are joined by one blank and its
    ``n_chars`` counts what is left. Documents without words are in no mix.
    """
    placed = mixed(docs).where("taken > 0").select("doc_id", "source", "size", "taken")
    # equal rows share id, source and size: pair the k-th with the k-th
    twin = Window.partitionBy("doc_id", "source", "_mix_size").orderBy("_mix_order")
    left = docs.withColumn("_mix_size", word_count(F.col("text"))).where("_mix_size > 0").withColumn("_mix_order", F.xxhash64("text")).withColumn("_mix_twin", F.row_number().over(twin)).drop("_mix_order")
    right = placed.withColumnRenamed("size", "_mix_size").withColumn("_mix_order", -F.col("taken")).withColumn("_mix_twin", F.row_number().over(twin)).select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("_mix_size").alias("_mix_words"), F.col("_mix_twin").alias("_mix_nth"), F.col("taken").alias("_mix_taken"))
    same = F.col("doc_id").eqNullSafe(F.col("_mix_id")) & F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_size") == F.col("_mix_words")) & (F.col("_mix_twin") == F.col("_mix_nth"))
    both = left.join(right, same)
    whole = (F.col("_mix_taken") / F.col("_mix_size")).cast("long")
    rest = (F.col("_mix_taken") - whole * F.col("_mix_size")).cast("int")
    part = F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))
    copies = F.concat(F.array_repeat(F.lit(0), whole.cast("int")), part)
    cut = F.concat_ws(" ", F.slice(F.split(F.trim(F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+", " ")), " "), F.lit(1), F.col("_mix_cut")))
    out = both.withColumn("_mix_cut", F.explode(copies))
    text = F.when(F.col("_mix_cut") > 0, cut).otherwise(F.col("text"))
    values = {"text": text, "n_chars": F.when(F.col("_mix_cut") > 0, F.length(cut)).otherwise(F.col("n_chars")).cast("long")}
    return out.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (ARRAY[5, 2, 1])[1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3]::DOUBLE AS w,
             (3 * source_size)::DOUBLE AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM w),
f AS (SELECT *, (cap / w) * a + b <= total AS capped FROM r),
l AS (SELECT *, (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN w END) OVER () AS lev FROM f),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(w * lev, cap) END AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS n FROM p)
SELECT doc_id, size, source_size, target,
       (n * size + greatest(0, least(size, budget - n * source_size - b)))::BIGINT AS taken
FROM e
""".replace(' COLLATE "C"', "")
