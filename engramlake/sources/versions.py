"""Tables as numbered versions of Parquet folders: whole new versions in place of MERGE, one writer at a time."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new folder below the session's shared one; a folder of our own only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def finished_folders(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """The numbers of the folders ``root/<prefix><n>`` that a job has finished, in order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(root)):
        return []
    found = [f.getPath() for f in fs.listStatus(path(root))]
    return sorted(int(p.getName()[len(prefix) :]) for p in found if p.getName().startswith(prefix) and fs.exists(path(p, "_SUCCESS")))


class AppendedTable:
    """``root/batch=<n>``: rows are only added, each batch in a folder of its own number, so that a
    batch that is written again replaces itself and nothing else is touched."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def append(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch bigint").option("basePath", self.root).parquet(self.root)


class VersionedTable:
    """``root/v=<n>``; readers take the highest version that was finished.

    A version is visible once Spark has written its _SUCCESS marker, so a job that dies leaves the
    last one in force.  All file access goes through Hadoop's file system, as Spark's own."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def version(self) -> int:
        return max(finished_folders(self.spark, self.root, "v="), default=0)

    def read(self) -> DataFrame:
        n = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v={n}") if n else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> int:
        n = self.version() + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/v={n}")
        return n
