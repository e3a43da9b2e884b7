"""Progress of videos through the phases, as an append-only log of states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a state, and what marks a phase as rolled back.
SCHEMA = "vid_hash string, phase int, status string, temp_workspace_path string, source_video_path string, error_message string, updated_at timestamp"
ROLLED_BACK = "rolled_back_by_resume_phase"


def latest(log: DataFrame) -> DataFrame:
    """The last state of each video and phase; of states of one time a committed one, then a failed one."""
    rest = [c for c in log.columns if c not in ("vid_hash", "phase", "updated_at")]
    weight = F.when(F.col("status") == "committed", 2).when(F.col("status") == "failed", 1).otherwise(0).alias("weight")
    best = log.groupBy("vid_hash", "phase").agg(F.max(F.struct("updated_at", weight, *rest)).alias("s"))
    return best.select("vid_hash", "phase", "s.updated_at", *[f"s.{c}" for c in rest])


def incomplete(states: DataFrame, phase: int) -> DataFrame:
    """States of the phase that are not committed, the oldest first."""
    return states.filter((F.col("phase") == phase) & (F.col("status") != "committed")).orderBy("updated_at")


def resumed(states: DataFrame, phase: int | None = None) -> DataFrame:
    """States with what was left unfinished (in one phase, or in all) marked as failed."""
    left = F.col("status") != "committed"
    left = left if phase is None else left & (F.col("phase") == phase)
    return states.withColumns({"status": F.when(left, "failed").otherwise(F.col("status")), "error_message": F.when(left, ROLLED_BACK).otherwise(F.col("error_message"))})


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


class Tracker:
    """The log in a folder that driver and executors share. One writer at a time, as in a single orchestrator."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def states(self) -> DataFrame:
        return latest(self.log())

    def _put(self, vid_hash: str, phase: int, status: str, workspace: str | None = None, source: str | None = None, error: str | None = None) -> None:
        row = self.spark.createDataFrame([(vid_hash, phase, status, workspace, source, error)], SCHEMA.rsplit(", ", 1)[0])
        row.withColumn("updated_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def mark_all(self, videos: DataFrame, phase: int, status: str, error: str | None = None) -> None:
        """The same state for every row of videos (vid_hash), in one write; error_message where videos have it, else `error`."""
        why = F.col("error_message") if "error_message" in videos.columns else F.lit(error).cast("string")
        told = videos.select("vid_hash", F.lit(phase).alias("phase"), F.lit(status).alias("status"), why.alias("error_message"), F.current_timestamp().alias("updated_at"))
        told = told.withColumns({"temp_workspace_path": F.lit(None).cast("string"), "source_video_path": F.lit(None).cast("string")})
        told.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(self.path)

    def record(self, vid_hash: str, phase: int):
        return self.states().filter((F.col("vid_hash") == vid_hash) & (F.col("phase") == phase)).first()

    def mark_processing(self, vid_hash: str, phase: int, workspace: str, source: str) -> None:
        self._put(vid_hash, phase, "processing", workspace, source)

    def mark_committed(self, vid_hash: str, phase: int) -> None:
        found = self.record(vid_hash, phase)
        if found is None:
            raise ValueError(f"phase {phase} of {vid_hash} was never begun")
        self._put(vid_hash, phase, "committed", found.temp_workspace_path, found.source_video_path)

    def mark_failed(self, vid_hash: str, phase: int, error: str) -> None:
        """Nothing happens where the phase was never begun."""
        found = self.record(vid_hash, phase)
        if found is not None:
            self._put(vid_hash, phase, "failed", found.temp_workspace_path, found.source_video_path, error)

    def is_committed(self, vid_hash: str, phase: int) -> bool:
        found = self.record(vid_hash, phase)
        return found is not None and found.status == "committed"

    def resume(self, phase: int) -> list[str]:
        """Mark what is unfinished as failed; the ids, oldest first. Points of theirs are not in the manifest already."""
        left = incomplete(self.states(), phase)
        resumed(left, phase).withColumn("updated_at", F.current_timestamp()).select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(self.path)
        return [r.vid_hash for r in left.select("vid_hash").collect()]
