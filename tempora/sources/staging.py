"""Tables written to the folder that driver and executors share, where a plan has to be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made where no shared one is set, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tempora-"))
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """The rows as written and read back: a lost executor costs its tasks, and what follows never runs their plan again.

    Spark reads thousands of rows of a file at once: where rows are large, a file should hold few.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that is no longer read."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Passes:
    """Results of several passes over the same table, each written before the next is planned: the plan stays as short as one."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.schema = spark, scratch(spark, name), None

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)
        self.schema = rows.schema

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
