"""Queries of the file formats: the given tables written to a shared folder and read again over many splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.queries import query, table
from tracewright.shared import shared_folder
from tracewright.sources import formats
from tracewright.sources.quoted import read_quoted_csv


#: Bytes of a split at least, and splits of all files together at about most: what each task tells the driver must not grow with the input.
SPLIT, SPLITS = 64 << 10, 1 << 10


def _small_splits(spark, place: str):
    """A session in which the files at ``place`` are cut into splits of 64 KB, or larger ones where that were too many tasks."""
    where = spark._jvm.org.apache.hadoop.fs.Path(place)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(max(SPLIT, -(-size // SPLITS))))
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    return session


@query("csv_quoted_splits", "SELECT doc_id::VARCHAR AS doc_id, nullif(text, '') AS text, lang FROM documents")
def _csv(spark, sf_dir):
    """Whole texts with their line ends and quotes, through CSV files of many splits."""
    place = shared_folder(spark, "csv")
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang").write.csv(place, header=True, quote='"', escape='"', emptyValue="")
    return read_quoted_csv(_small_splits(spark, place), place)


@query("sql_insert_splits", "SELECT 'notes' AS \"table\", o_orderkey, o_orderpriority || chr(10) || 'it''s; ' || o_orderstatus AS note FROM orders")
def _inserts(spark, sf_dir):
    """INSERT statements whose texts have line ends, quotes and semicolons, through text files of many splits."""
    place = shared_folder(spark, "sql")
    note = F.concat("o_orderpriority", F.lit("\nit's; "), "o_orderstatus")
    formats.to_inserts(table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note")), "notes").write.text(place)
    rows = formats.read_inserts(_small_splits(spark, place), place)
    return rows.select("table", F.get_json_object("row", "$.o_orderkey").cast("bigint").alias("o_orderkey"), F.get_json_object("row", "$.note").alias("note"))
