"""Exact duplicates by a stream that never forgets, with DataFrame functions only.

A file stream keeps, for each digest ever seen, how many rows had it and the row that stays: its
stable identifier and its content's place (file and row). The state lies in RocksDB on the executors'
disks, has no expiry, and every change of it is kept in the checkpoint below ``spark.checkpoint.dir``:
a lost executor's state is rebuilt from there, and a later run with the same checkpoint reads only
files that are new. Reading the state is a scan like any other.

Rows whose digest repeats are hits. Their whole texts are compared byte by byte with the text at the
place that the state names; rows that only share the digest are grouped by their texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm._store import Workspace, kept

#: Bytes of files in one micro-batch: a failed one is read again alone.
BATCH_BYTES = 64 << 30
#: Bits for each repeated digest in the filter of texts that move, and the filter's largest size in bitmaps of 4 KiB (64 MB).
FILTER_BITS, MOST_BITMAPS = 16, 1 << 14
_ROCKS = "spark.sql.streaming.stateStore.rocksdb."
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _ROCKS + "changelogCheckpointing.enabled": "true",
    _ROCKS + "boundedMemoryUsage": "true",
    _ROCKS + "maxMemoryUsageMB": "256",
    _ROCKS + "allowFAllocate": "false",  # else every partition's manifest takes 4 MB of disk in advance
}
_BITS = 8 * 4096


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _placed(rows: DataFrame) -> list[Column]:
    """The content's place. The scheme's slashes differ between streams and tables: they are left out."""
    place = rows.metadataColumn("_metadata")
    return [F.regexp_replace(place["file_path"], "^file:/+", "/").alias("file"), place["row_index"].alias("row")]


def remember(spark: SparkSession, path: str, checkpoint: str, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """digest, n, doc_id, file, row: what the state holds once all files at ``path`` have been read.

    Files that an earlier run with this ``checkpoint`` has read are not read again, but still count.
    """
    session = spark.newSession()  # its settings are the stream's own
    for key, value in {**_SETTINGS, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        session.conf.set(key, value)
    path = path.rstrip("/")
    files = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only as a pattern
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    rows = session.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(files)
    seen = rows.select("doc_id", digest(normalised(F.col("text"))).alias("digest"), *_placed(rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "row")).alias("first")
    state = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first)
    state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    held = spark.read.format("statestore").load(checkpoint)
    n, first = held.schema["value"].dataType.names  # in the order of the aggregate
    return held.select("key.digest", F.col("value")[n].alias("n"), *[F.col("value")[first][c].alias(c) for c in ("doc_id", "file", "row")])


def _filter(repeated: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """One row with bitmaps of the repeated digests, and the test whether a digest may be among them.

    Its size is a power of two by their number, 64 MB at most; beyond that it lets more rows through,
    which changes no result.
    """
    many = repeated.count()
    size = 1
    while size < MOST_BITMAPS and size * _BITS < FILTER_BITS * many:
        size *= 2
    place = lambda d: F.pmod(F.xxhash64(d), F.lit(size * _BITS))
    bits = repeated.select(place(F.col("digest")).alias("p")).groupBy(F.expr(f"p div {_BITS}").alias("k")).agg(F.bitmap_construct_agg(F.col("p") % _BITS).alias("bits"))
    one = bits.agg(F.map_from_entries(F.collect_list(F.struct("k", "bits"))).alias("_bits"))

    def may(d: Column) -> Column:
        at = F.try_element_at(F.col("_bits"), F.floor(place(d) / _BITS).cast("bigint"))
        inside = (place(d) % _BITS).cast("int")
        byte = F.conv(F.hex(F.substring(at, F.floor(inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.call_function("shiftright", byte, inside % 8).bitwiseAND(F.lit(1)) == 1, F.lit(False))

    return one, may


def exact_duplicates(spark: SparkSession, path: str, checkpoint: str | None = None, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest, file, row for every row of the parquet files at ``path``.

    The files need ``doc_id`` (of any type that has an order) and ``text``; other columns are not
    read, whatever their names. Texts are equal if identical once runs of white space are one space;
    null counts as empty. Of equal texts the row with the smallest id stays, one without an id last;
    of repeated ids the first by file and row. Every row has its own decision, so exactly one row
    of a group is kept even if ids repeat. An empty table gives no rows. ``checkpoint`` (a folder
    that all executors share) holds the state; give the same one again to add files to it.
    """
    work = Workspace(spark)
    try:
        state = remember(spark, path, checkpoint or f"{work.folder}/state", digest, batch_bytes)
        return kept(_decided(spark.read.parquet(path), state, digest, work), "exact")
    finally:
        work.close()


def _decided(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column], work: Workspace) -> DataFrame:
    repeated = work.keep(state.where("n > 1").withColumnsRenamed({"doc_id": "keep_id", "file": "keep_file", "row": "keep_row"}), "repeated")
    one, may = _filter(repeated)
    text = normalised(F.col("text"))
    rows = docs.select("doc_id", "text", *_placed(docs)).withColumn("text", text).withColumn("digest", digest(F.col("text")))
    # only texts that may be hits move
    maybe = rows.crossJoin(F.broadcast(one)).withColumn("_may", may(F.col("digest"))).drop("_bits")
    texts = work.keep(maybe.withColumn("text", F.when(F.col("_may"), F.col("text"))).drop("_may"), "rows")
    found = texts.drop("text").join(repeated, "digest", "left")
    first = F.col("n").isNull() | ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row")))
    found = work.keep(found.withColumn("kept", first), "found")
    hits = found.where("not kept").select("file", "row", "keep_file", "keep_row")
    said = texts.where("text is not null").select("file", "row", "text")
    there = said.select(F.col("file").alias("keep_file"), F.col("row").alias("keep_row"), F.col("text").alias("keep_text"))
    odd = hits.join(said, ["file", "row"]).join(there, ["keep_file", "keep_row"]).where(F.col("text") != F.col("keep_text"))
    odd = work.keep(odd.select("file", "row", "text"), "odd")
    out = found.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), "kept", "digest", "file", "row")
    return out if odd.isEmpty() else _split(out, odd, work)


def _split(out: DataFrame, odd: DataFrame, work: Workspace) -> DataFrame:
    """Rows whose text is not that of the row kept for their digest: they leave its group and form groups by text."""
    of = out.join(odd, ["file", "row"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "row")).alias("first")
    groups = of.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), first)
    own = work.keep(of.join(groups, ["digest", "text"]).select("file", "row", F.col("first.doc_id").alias("own_keep"), F.col("n").alias("own_n"), ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))).alias("own_kept")), "own")
    gone = groups.groupBy("digest").agg(F.sum("n").alias("gone"))
    both = out.join(own, ["file", "row"], "left").join(gone, "digest", "left")
    other = F.col("own_n").isNotNull()
    return both.select(
        "doc_id",
        F.when(other, F.col("own_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("own_n", F.col("group_size") - F.coalesce("gone", F.lit(0))).alias("group_size"),
        F.when(other, F.col("own_kept")).otherwise(F.col("kept")).alias("kept"),
        "digest", "file", "row",
    )


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    found = exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
