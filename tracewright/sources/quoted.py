"""Records with quoted line ends, from files that many tasks read at once.

Spark splits text files at line ends, and where a split begins it is not known whether a quote is open.
One pass counts quotes for each split; the sums before a split say if one is open at its start. In a
second pass every task cuts its splits into records by itself: nothing is moved but the pieces of records
that cross from one split into the next, one or two for each split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: A record that is whole in its split; one that began before, goes on after it, or both.
WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3
_PIECES = "file long, block long, kind int, place long, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("lineSep", "\n").text(path)
    place = df.metadataColumn("_metadata")
    return df.select(F.xxhash64(place["file_path"]).alias("file"), place["file_block_start"].alias("block"), "value")


def _cut(quote: str, end: str):
    """A task: lines in order of their splits to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, opened, out, place, size = None, [], False, [], 0, 0

        def piece(kind: int) -> None:
            nonlocal held, opened, place, size
            out.append((*now, kind, place, "\n".join(held)))
            size += sum(map(len, held))
            held, opened, place = [], False, place + 1

        def over() -> None:
            if held:
                piece(MIDDLE if opened else TAIL)

        def table() -> pa.RecordBatch:
            nonlocal out, size
            rows, out, size = out, [], 0
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["file", "block", "kind", "place", "text"])

        for batch in batches:
            for file, block, odd, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "odd", "value")), strict=True):
                if (file, block) != now:
                    if now:
                        over()
                    now, inside, opened, place = (file, block), odd, odd, 0
                held.append(line)
                inside ^= bool(line.count(quote) & 1)
                if not inside and (not end or line.rstrip().endswith(end)):
                    piece(HEAD if opened else WHOLE)
                if size > 4 << 20:
                    yield table()
        if now:
            over()
        if out:
            yield table()

    return run


def quoted_records(spark: SparkSession, path: str, quote: str = '"', end: str = "") -> DataFrame:
    """``first`` (whether it begins its file) and ``text`` of every record; a line end inside quotes is part of it.

    A doubled quote inside quotes is two quotes, and leaves them open. With ``end`` a record goes on until a
    line outside quotes ends with it. What follows the last end of a file is a record too. The table of splits, a row of 17 bytes
    for each split of a file, is broadcast.
    """
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    splits = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("odd"))
    pieces = lines.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "odd", "value").mapInArrow(_cut(quote, end), _PIECES)
    begins = (F.col("block") == 0) & (F.col("place") == 0)
    if end:
        return _stitched_statements(pieces, begins)
    whole = pieces.where(F.col("kind") == WHOLE).select(begins.alias("first"), "text")
    order = Window.partitionBy("file").orderBy("block", "place")
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("n", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    return whole.unionByName(_joined(parts, begins))


def _joined(parts: DataFrame, begins) -> DataFrame:
    """Pieces of one record, put together in order: ``n`` numbers the records of a file."""
    rows = parts.groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("block", "place", "text"))).alias("p"), F.max(begins).alias("first"))
    return rows.select("first", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def _stitched_statements(pieces: DataFrame, begins) -> DataFrame:
    """Statements: the first piece of a split may belong to an open one even where no quote is open."""
    open_ = F.col("kind").isin(TAIL, MIDDLE)
    edge = open_ | (F.col("place") == 0)
    whole = pieces.where(~edge).select(begins.alias("first"), "text")
    order = Window.partitionBy("file").orderBy("block", "place")  # two rows for each split
    starts = F.coalesce(F.lag(~open_).over(order), F.lit(True)).cast("int")
    parts = pieces.where(edge).withColumn("_starts", starts).withColumn("n", F.sum("_starts").over(order))
    return whole.unionByName(_joined(parts, begins))


def read_quoted_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, columns: list[str] | None = None) -> DataFrame:
    """CSV as texts, whatever line ends are inside quotes, each file read by many tasks.

    Every file begins with the header (the first file's names are taken) unless ``columns`` are given.
    Blank lines are skipped; ragged rows fail.
    """
    rows = quoted_records(spark, path)
    line = F.regexp_replace("text", "\r$", "")
    rows = rows.select("first", line.alias("text"))
    if not columns:
        top = rows.where("first").limit(1).collect()
        if not top:
            raise ValueError("csv: no header")
        one = spark.createDataFrame([(top[0]["text"],)], "t string")
        n = one.select(F.size(F.split(F.regexp_replace("t", '"([^"]|"")*"', "x"), "\\Q" + sep + "\\E"))).first()[0]
        shown = one.select(F.from_csv("t", ", ".join(f"c{i} string" for i in range(n)), {"sep": sep, "quote": '"', "escape": '"'}).alias("r")).select("r.*").first()
        columns = [c or "" for c in shown]
        if len(set(columns)) < n or any(not c.strip() for c in columns):
            raise ValueError("csv: header names must be unique and not empty")
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(columns))])
    body = rows.where((~F.col("first") if header else F.lit(True)) & (F.col("text") != ""))
    parsed = body.select(F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true", "lineSep": "\u0001"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])
