"""Tables kept between steps in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new place below ``spark.checkpoint.dir``; where that is unset, a temporary one if all runs in one process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tracewright-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    return _written(df, f"{shared_folder(df.sparkSession)}/{name}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables that only the steps of one operator read; ``close`` removes them once its result is kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self._tables = spark, shared_folder(spark), []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}")

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """A table dealt by a key: joins by that key do not move it."""
        table = f"{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).option("path", f"{self.folder}/{table}").option("compression", "zstd").saveAsTable(table)
        self._tables.append(table)
        return self.spark.table(table)

    def remove(self, *tables: DataFrame) -> None:
        """Remove kept tables that no later step reads."""
        for table in tables:
            for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                self._delete(path)

    def close(self) -> None:
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
