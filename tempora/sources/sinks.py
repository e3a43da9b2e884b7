"""Writers: chunks, points, evaluation queues, routed verdicts and CSV reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("vid_hash").parquet(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def csv_columns(rows: DataFrame) -> DataFrame:
    """Columns by name, nested ones as JSON: what a CSV report holds."""
    nested = {f.name for f in rows.schema if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)}
    return rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in sorted(rows.columns)])


def write_csv(rows: DataFrame, path: str) -> None:
    csv_columns(rows).write.mode("overwrite").option("header", True).csv(path)


def route_verdicts(rows: DataFrame, report: str, deep: str, batch: int) -> None:
    """Rows with their verdict as one batch of the report, and from there the borderline ones as one of the deep queue.

    The rows are evaluated once; a batch that is run again replaces its own part of both.
    """
    rows.write.mode("overwrite").parquet(f"{report}/batch={batch}")
    told = rows.sparkSession.read.schema(rows.schema).parquet(f"{report}/batch={batch}")
    told.filter("verdict = 'deep_queue'").write.mode("overwrite").json(f"{deep}/batch={batch}")
