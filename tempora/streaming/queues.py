"""Queues and ingestion as streams: each run takes what is new and stops; checkpoints remember what was taken."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import evaluation, models
from ..plans import tracker
from ..sources import sinks
from ..sources.readers import EVAL, LOGGED

JUDGED = "score_relevance double, score_ground double, score_answer_relevance double, verdict string"
CLOSED = "vid_hash string, text string, start double, end double, sentence_count int"


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand all new rows to `each`, a batch at a time, then stop."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def evaluate_queue(spark: SparkSession, queue: str, report: str, checkpoint: str, low: float = evaluation.LOW, high: float = evaluation.HIGH) -> None:
    """Score and judge new rows of the queue; a batch that is run again overwrites its own part of the report."""

    def each(batch: DataFrame, number: int) -> None:
        evaluation.tier1(models.triad(batch), low, high).write.mode("overwrite").parquet(f"{report}/batch={number}")

    drain(spark.readStream.schema(EVAL).json(queue), each, checkpoint)


def judge_queue(spark: SparkSession, queue: str, report: str, deep: str, checkpoint: str, rate: float = 0.1, low: float = evaluation.LOW, high: float = evaluation.HIGH) -> list[int]:
    """Judge an exact sample of the queue's new rows and pass the borderline ones on; the numbers of the batches that were new.

    A row is taken once: a second run finds nothing to do.
    """
    done = []

    def each(batch: DataFrame, number: int) -> None:
        told = batch.filter("query IS NOT NULL OR context IS NOT NULL OR answer IS NOT NULL").withColumn("_id", F.md5(F.concat_ws("|", "query", "answer")))
        sample = evaluation.exact_sample(told, "_id", rate).drop("_id")
        sinks.route_verdicts(evaluation.tier1(models.triad(sample), low, high), report, deep, number)
        done.append(number)

    drain(spark.readStream.schema(LOGGED).json(queue), each, checkpoint)
    return done


def drain_deep_queue(spark: SparkSession, deep: str, report: str, checkpoint: str) -> list[int]:
    """Have the judge score what is new in the deep queue; the numbers of the batches that were new."""
    done = []

    def each(batch: DataFrame, number: int) -> None:
        evaluation.tier2(batch.drop("batch"), models.judge()).write.mode("overwrite").parquet(f"{report}/batch={number}")
        done.append(number)

    drain(spark.readStream.schema(f"{LOGGED}, {JUDGED}").json(deep), each, checkpoint)
    return done


def ingest_new(spark: SparkSession, folder: str, schema: str, done: Callable[[], DataFrame], key: str, each: Callable[[DataFrame, int], None], checkpoint: str, files: int = 1000) -> None:
    """New files of the folder, without keys that are done already."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    drain(stream, lambda batch, n: each(tracker.not_done(batch, done(), key), n), checkpoint)


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows a window and key; rows later than `late` are left out and finished windows leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))


def _closed(state_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, max_chars: int, max_seconds: float) -> Iterator[pd.DataFrame]:
    """The chunker online: sentences arrive in order of time; a chunk leaves once the next sentence does not fit.

    A sentence without text ends its video."""
    text, start, end, n = state.get if state.exists else ("", 0.0, 0.0, 0)
    out = []
    for s in pd.concat(list(batches)).sort_values("start", kind="stable").itertuples():
        last = s.text is None
        # Joining spaces do not count towards the limit.
        if n and (last or len(text) - n + 1 + len(s.text) > max_chars or s.start - start > max_seconds):
            out.append((state_key[0], text, start, end, n))
            n = 0
        if not last:
            text, start, end, n = (f"{text} {s.text}", start, s.end, n + 1) if n else (s.text, s.start, s.end, 1)
    state.update((text, float(start), float(end), int(n)))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in CLOSED.split(", ")])


def chunk_stream(spoken: DataFrame, max_chars: int = 400, max_seconds: float = 15.0) -> DataFrame:
    """Closed chunks of a stream of sentences (vid_hash, text, start, end) within one scene."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _closed(key, batches, state, max_chars, max_seconds)

    return spoken.groupBy("vid_hash").applyInPandasWithState(run, CLOSED, "text string, start double, end double, n int", "append", GroupStateTimeout.NoTimeout)
