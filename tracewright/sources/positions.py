"""A row's place in a table of files, without a global sort.

A parquet reader knows each row's file and its place in the file. The files, in order of their
paths, are summed up by their row counts, and a row's place is its file's base and its own place there.
Only the small table of files is ordered; the rows are neither moved nor sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The column that rows get.
POSITION = "__row"


def numbered(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All rows of the parquet files at ``path`` with ``__row``, from 0, in order of files and rows."""
    df = spark.read.parquet(path)
    place = df.metadataColumn("_metadata")
    files = df.select(place["file_path"].alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    bases = files.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    rows = df.select(place["file_path"].alias("_file"), place["row_index"].alias("_index"), *[F.col(f"`{c}`") for c in columns or df.columns])
    out = rows.join(F.broadcast(bases), "_file")  # a join by file would move a whole file's rows into one task
    return out.select((F.col("_base") + F.col("_index")).alias(POSITION), *[F.col(f"`{c}`") for c in columns or df.columns])


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two numbered tables side by side; a row without partner has nulls on the other side."""
    names = {c: f"right_{c}" for c in right.columns if c != POSITION}
    return left.join(right.withColumnsRenamed(names), POSITION, "full")
