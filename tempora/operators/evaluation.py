"""Quality evaluation: cascade verdicts, ground truth, exact samples, and the weight grid."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, token_recall

LOW, HIGH, STEP, MIN_PAIRS = 0.4, 0.7, 0.1, 5
#: Queries of which a task holds the totals of the whole grid at a time.
GRID_QUERIES = 256
VERDICTS = ("pass", "fail", "deep_queue")


def verdict(relevance: Column, ground: Column, answer: Column, low: float = LOW, high: float = HIGH) -> Column:
    """pass if every score is above high, fail if any is below low, else deep_queue; on a boundary it is deep_queue."""
    good = (F.least(relevance, ground) > high) & (answer > high)
    return F.when(good, "pass").when(F.least(relevance, ground, answer) < low, "fail").otherwise("deep_queue")


def tier1(rows: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """rows (score_relevance, score_ground, score_answer_relevance) with their verdict, and scores at four decimals.

    Verdicts come from the scores as they are."""
    names = ("score_relevance", "score_ground", "score_answer_relevance")
    out = rows.withColumn("verdict", verdict(*[F.col(n) for n in names], low, high))
    return out.withColumns({n: F.round(n, 4) for n in names})


def verdict_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def tier2(rows: DataFrame, score: Column) -> DataFrame:
    """The queued rows with the judge's score from 1 to 5, and pass from 4 on."""
    return rows.filter("verdict = 'deep_queue'").withColumn("tier2_score", score).withColumn("tier2_verdict", F.when(F.col("tier2_score") >= 4, "pass").otherwise("fail"))


def tier2_counts(rows: DataFrame) -> DataFrame:
    """judged, passed, failed over judged rows; zeros where there are none."""
    return rows.agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col("tier2_verdict") == "pass").alias("passed"), F.count_if(F.col("tier2_verdict") == "fail").alias("failed"))


def ground_truth_metrics(results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of figures. results: query, answer, keyframes (array); truth: ord, query, expected_keyframe, expected_answer.

    Of equal normal forms of a query the last row of truth counts. Ranks leave out null and empty keyframes.
    """
    key = normalize(F.coalesce("query", F.lit(""))).alias("key")
    want = truth.select(key, "ord", "expected_keyframe", "expected_answer").groupBy("key").agg(F.max_by(F.struct("expected_keyframe", "expected_answer"), "ord").alias("t")).select("key", "t.*")
    both = results.select(key, "answer", F.filter("keyframes", lambda k: k.isNotNull() & (k != "")).alias("shown")).join(want, "key")
    place = F.coalesce(F.when(F.col("expected_keyframe") != "", F.array_position("shown", F.col("expected_keyframe"))), F.lit(0))
    overlap = F.when(F.col("expected_answer") != "", token_recall(F.col("answer"), F.col("expected_answer")))
    figures = both.select(place.alias("place"), overlap.alias("overlap")).agg(
        F.count(F.lit(1)).alias("matched_queries"), F.avg((F.col("place") > 0).cast("double")).alias("hit"), F.avg(F.when(F.col("place") > 0, 1 / F.col("place")).otherwise(0.0)).alias("mrr"), F.avg("overlap").alias("overlap")
    )
    total = truth.agg(F.count(F.lit(1)).alias("total_ground_truth"))
    flat = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    # Two tables of one row each.
    return figures.crossJoin(F.broadcast(total)).select("matched_queries", "total_ground_truth", flat("hit").alias("keyframe_hit_rate"), flat("mrr").alias("mean_reciprocal_rank"), flat("overlap").alias("mean_answer_overlap"))


def exact_sample(rows: DataFrame, id_col: str, rate: float, seed: int = 42) -> DataFrame:
    """max(1, int(n * rate)) rows, the same for the same seed: those that come first by a hash. A sample is what this is for.

    A histogram of the hash's first four digits tells which bucket holds the last row; only that bucket is sorted.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    bucket = F.substring(digest, 1, 4)
    sizes = sorted((r.bucket, r["count"]) for r in rows.groupBy(bucket.alias("bucket")).count().collect())  # at most 65,536
    n = sum(c for _, c in sizes)
    left = max(1, int(n * rate)) if n else 0
    for name, size in sizes:
        if left <= size:
            return rows.filter(bucket < name).unionByName(rows.filter(bucket == name).orderBy(digest, id_col).limit(left))
        left -= size
    return rows


def target_pairs(spark: SparkSession, given: str) -> DataFrame:
    """query, expected_keyframe from inline JSON or from a path; fewer than five pairs are an error."""
    text = given if given.lstrip().startswith("[") else "\n".join(r.value for r in spark.read.text(given).collect())
    pairs = [(str(q), str(k)) for q, k in json.loads(text)]
    if len(pairs) < MIN_PAIRS:
        raise ValueError(f"at least {MIN_PAIRS} pairs of query and keyframe are needed, not {len(pairs)}")
    return spark.createDataFrame(pairs, "query string, expected_keyframe string")


def grid(spark: SparkSession, step: float = STEP) -> DataFrame:
    """alpha, beta with alpha + beta <= 1, by steps."""
    n = round(1 / step)
    return spark.createDataFrame([(round(a * step, 3), round(b * step, 3)) for a in range(n + 1) for b in range(n + 1 - a)], "alpha double, beta double")


def _grid_ranks(alpha: np.ndarray, beta: np.ndarray):
    """For each query of a batch and each point of the grid the rank of the best candidate that counts as found; 0 if none does."""
    third = np.maximum(0.0, 1 - alpha - beta)

    def ranks(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column("found")
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat, starts = lists.flatten(), np.cumsum(size) - size
        r0, r1, r2 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("r0", "r1", "r2"))
        total = np.round(alpha[:, None] * r0 + beta[:, None] * r1 + third[:, None] * r2, 10)
        hit = flat.field("hit").to_numpy(zero_copy_only=False).astype(bool)
        each = lambda x: np.repeat(x, size, axis=1)
        best = each(np.maximum.reduceat(np.where(hit, total, -np.inf), starts, axis=1))
        place = np.arange(len(hit))
        # Candidates are sorted by point: of equal totals the first counts.
        first = each(np.minimum.reduceat(np.where(hit & (total == best), place, len(hit)), starts, axis=1))
        before = (total > best) | ((total == best) & (place < first))
        return np.where(np.logical_or.reduceat(hit, starts), 1 + np.add.reduceat(before, starts, axis=1, dtype=np.int64), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, GRID_QUERIES):
                part = b.slice(lo, GRID_QUERIES)
                found = ranks(part)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(alpha, n)), pa.array(np.repeat(beta, n)), pa.array(found.ravel())], ["alpha", "beta", "rank"])

    return run


def grid_mrr(parts: DataFrame, targets: DataFrame, points: DataFrame) -> DataFrame:
    """alpha, beta, mean_mrr for each point of the grid.

    parts: query_id, point_id, space (0, 1, 2), rrf, as retrieved once; targets: query_id, expected; points: alpha, beta.
    `expected` holds the keys that count as found, a point's key being in parts as `key`. Ties go to the smaller point.
    A query's candidates are a row, no more than k a space; all points of the grid look at them at once.
    """
    scores = parts.groupBy("query_id", "point_id", "key").agg(*[F.coalesce(F.max(F.when(F.col("space") == s, F.col("rrf"))), F.lit(0.0)).alias(f"r{s}") for s in range(3)])
    wanted = targets.groupBy("query_id").agg(F.collect_set("expected").alias("expected"))
    hit = F.coalesce(F.array_contains("expected", F.col("key")), F.lit(False)).alias("hit")
    candidate = F.struct("point_id", "r0", "r1", "r2", hit)
    rows = scores.join(wanted, "query_id").groupBy("query_id").agg(F.array_sort(F.collect_list(candidate)).alias("found"))
    grid = points.select("alpha", "beta").distinct().toPandas()  # a fixed number of points
    ranks = rows.select("found").mapInArrow(_grid_ranks(grid.alpha.to_numpy(float), grid.beta.to_numpy(float)), "alpha double, beta double, rank long")
    sums = ranks.groupBy("alpha", "beta").agg(F.sum(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)).alias("total"))
    # One row each: how many queries there are, those without candidates too.
    every = wanted.agg(F.count(F.lit(1)).alias("n"))
    found = points.join(sums, ["alpha", "beta"], "left").crossJoin(F.broadcast(every)).filter("n > 0")
    return found.select("alpha", "beta", F.round(F.coalesce("total", F.lit(0.0)) / F.col("n"), 5).alias("mean_mrr"))


def best_weights(mrr: DataFrame) -> DataFrame:
    """The best point; of equal ones the smallest alpha, then beta."""
    return mrr.orderBy(F.desc("mean_mrr"), "alpha", "beta").limit(1).withColumn("gamma", F.round(F.greatest(F.lit(0.0), 1 - F.col("alpha") - F.col("beta")), 3))
