"""Points that become visible at once: append-only rows and a manifest of commits.

A video's points are appended under an attempt; one row in the manifest makes that attempt visible and hides earlier ones.
Nothing is rewritten, so a lost writer leaves rows that no one sees and that `purge` tells apart.
"""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def payload(chunks: DataFrame, meta: DataFrame, status: str = "pending") -> DataFrame:
    """Chunks with their video's metadata (vid_hash, domain, ..); a video without any has the domain `unknown`."""
    out = chunks.join(meta, "vid_hash", "left")
    return out.withColumns({"domain": F.coalesce("domain", F.lit(UNKNOWN)), "commit_status": F.lit(status)})


def point_id(chunks: DataFrame) -> DataFrame:
    """Deterministic ids, so that a retry writes the same points."""
    return chunks.withColumn("point_id", F.sha2(F.concat_ws("|", "vid_hash", "chunk_id"), 256))


def latest(manifest: DataFrame) -> DataFrame:
    """vid_hash, attempt: the last committed attempt of each video."""
    return manifest.groupBy("vid_hash").agg(F.max("attempt").alias("attempt"))


def visible(points: DataFrame, manifest: DataFrame) -> DataFrame:
    return points.join(latest(manifest), ["vid_hash", "attempt"], "left_semi").withColumn("commit_status", F.lit("committed"))


def with_status(points: DataFrame, manifest: DataFrame) -> DataFrame:
    """Points with commit_status and purge: true for rows of attempts that a later commit has overtaken."""
    out = points.join(latest(manifest).withColumnRenamed("attempt", "_done"), "vid_hash", "left")
    done = F.coalesce(F.col("attempt") == F.col("_done"), F.lit(False))
    gone = F.coalesce(F.col("attempt") < F.col("_done"), F.lit(False))
    return out.withColumns({"commit_status": F.when(done, "committed").otherwise("pending"), "purge": gone}).drop("_done")


def committed_counts(points: DataFrame, manifest: DataFrame) -> DataFrame:
    return visible(points, manifest).groupBy("vid_hash").agg(F.count(F.lit(1)).alias("n_points"))


def claim(spark: SparkSession, folder: str, number: int) -> int:
    """The first number from `number` on that no other writer has, and it is this caller's from now on.

    A number is a file that is created only where there is none, in one step: by the file system, or on a local disk, where Hadoop looks
    first and creates afterwards, by the operating system.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(top)
    local = top.toUri().getPath() if files.getUri().getScheme() == "file" else None
    while True:
        try:
            if local:
                os.close(os.open(f"{local}/{number:012d}", os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            else:
                files.create(spark._jvm.org.apache.hadoop.fs.Path(top, f"{number:012d}"), False).close()
            return number
        except FileExistsError:
            number += 1
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            number += 1


def write_points(points: DataFrame, path: str) -> None:
    points.write.mode("append").partitionBy("domain").parquet(path)


def commit(manifest_path: str, rows: DataFrame) -> None:
    """Append vid_hash, attempt; call it only once all points of the attempt are written."""
    rows.select("vid_hash", "attempt", F.current_timestamp().alias("committed_at")).write.mode("append").parquet(manifest_path)
