"""Structured Streaming: rate windows and contracts on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.contract import Contract, run


def rate_windows(df: DataFrame, client: str, stamp: str, most: int = 30, seconds: int = 60, late: str | None = None) -> DataFrame:
    """client, start, requests, refused in tumbling windows. Works on tables and, with ``late``, on streams."""
    if late:
        df = df.withWatermark(stamp, late)
    g = df.groupBy(F.col(client), F.window(F.col(stamp), f"{seconds} seconds").alias("_w")).agg(F.count(F.lit(1)).alias("requests"))
    return g.select(client, F.col("_w.start").alias("start"), "requests", F.greatest(F.col("requests") - most, F.lit(0)).alias("refused"))


def first_of_key(df: DataFrame, keys: list[str], stamp: str, late: str) -> DataFrame:
    """Rows whose key has not come inside the watermark before."""
    return df.withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys)


def contract_stream(contract: Contract, df: DataFrame) -> DataFrame:
    """A contract's run on a stream: the same projection, no state."""
    return run(contract, df)


def split_sinks(ran: DataFrame, good: str, held: str, checkpoint: str, once: bool = True):
    """Write passed rows and held rows of a stream to two Parquet folders, each micro-batch exactly once.

    Every micro-batch writes into a folder of its own number and replaces it if it is run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        ok = F.col("status").isin("passed", "warned")
        batch.where(ok).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where(~ok).write.mode("overwrite").parquet(f"{held}/batch={number}")
        batch.unpersist()

    writer = ran.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
