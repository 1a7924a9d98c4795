"""Shared storage for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for tables of long texts: a batch or row group holds some megabytes even where texts have some kilobytes.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "parquet.block.size": str(16 << 20),
}


def small_batches(spark: SparkSession) -> None:
    """Set BATCH_SETTINGS for the session, save those that it has set itself."""
    for name, value in BATCH_SETTINGS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset a local session gets a temporary folder (tests); any other
    master raises ValueError, because executors do not see each other's disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-mergeloom-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def work_folder(spark: SparkSession, label: str) -> str:
    """A new name for an intermediate table's folder on shared storage."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet on shared storage and return a reader of it.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one call, in a folder of their own on shared storage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder = spark, work_folder(spark, label)
        self.paths: dict[str, list[str]] = {}
        self.stored = 0

    def store(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df as Parquet and return a reader of it; this cuts the lineage as materialize does."""
        path = self.path(name)
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        """A new place for what is not written by store."""
        self.stored += 1
        self.paths.setdefault(name, []).append(f"{self.folder}/{name}-{self.stored}")
        return self.paths[name][-1]

    def replace(self, df: DataFrame, name: str) -> DataFrame:
        """Store df, which may read the table stored under name before, and delete that one."""
        old = self.paths.pop(name, [])
        new = self.store(df, name)
        self.paths["replaced"] = old
        self.drop("replaced")
        return new

    def drop(self, *names: str) -> None:
        """Delete all that was stored under these names, or everything and the folder; what still reads it must have been stored before."""
        paths = [path for name in names for path in self.paths.pop(name, [])]
        if not names:
            self.paths, paths = {}, [self.folder]
        for path in paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
