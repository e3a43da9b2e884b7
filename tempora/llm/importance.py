"""Importance resampling towards a target distribution, over hashed n-gram features.

Every run of up to `n` consecutive words is a feature and falls into one of a fixed number of buckets by its crc32. How often
the buckets occur in the documents and in the target gives each bucket a gain, the scaled logarithm of its smoothed
probability ratio. A document's weight is the sum of the gains of its features; Gumbel noise from a hash of the id makes the
highest scores a draw without replacement in proportion to the weights' exponentials.

All of it is DataFrame code. Texts are read once: the buckets of their features are written to the shared folder, counted by
bucket, joined with the table of gains, which has no more rows than there are buckets, and summed by document. Scores are
sorted by ranges, and a row's rank is its place in its partition after all that the partitions before it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, stage

#: What separates words once A-Z are lower-cased: ASCII other than digits and letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, GRAM, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
SCALE, TWO_32 = 1000, 4294967296.0
#: monotonically_increasing_id() holds the partition above this many bits and the place in it below.
PLACE_BITS = 33


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def features(own: Column, n: int = GRAM) -> Column:
    """All runs of 1 to n consecutive words, joined by one space, repeats included."""
    if n == 1:
        return own

    def runs(k: int) -> Column:
        all_of_k = F.transform(F.sequence(F.lit(1), F.size(own) - k + 1), lambda i: F.array_join(F.slice(own, i, F.lit(k)), " "))
        return F.when(F.size(own) >= k, all_of_k).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(k) for k in range(1, n + 1)])


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def hashed(docs: DataFrame, text_col: str, n: int, buckets: int, *keep: Column) -> DataFrame:
    """The columns of `keep`, n_words, and `buckets`: the bucket of each feature of a row's text."""
    own = docs.select(*keep, words(F.col(text_col)).alias("_words"))
    own = own.select("*", F.size("_words").alias("n_words"), features(F.col("_words"), n).alias("_features"))
    return own.select(*own.columns[: len(keep)], "n_words", F.transform("_features", lambda f: bucket(f, buckets)).alias("buckets"))


def bucket_counts(rows: DataFrame, into: str) -> DataFrame:
    """bucket and how many features fall into it; tasks send no more than a row a bucket."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(into))


def gains(counts: DataFrame, source_total: int, target_total: int, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain. counts: bucket, s, t, features of the source and of the target in it."""
    ratio = (F.col("t") + 1.0) * (source_total + float(buckets)) / ((F.col("s") + 1.0) * (target_total + float(buckets)))
    return counts.select("bucket", F.floor(SCALE * F.log(ratio)).cast("long").alias("gain"))


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Scaled Gumbel noise from the first 32 bits of a hash of seed and id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / TWO_32))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """rows with `place`, 1 for the first by `order`, and how many rows there are.

    `order` must tell all rows apart that it matters to tell apart. The rows are sorted by ranges and staged once numbered, so
    that sampled range limits can't differ between two reads; the driver gets one count for each range.
    """
    sorted_rows = stage(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", PLACE_BITS).alias("_part")
    sizes = sorted((r["_part"], r["count"]) for r in sorted_rows.groupBy(part).count().collect())
    total, before = 0, {}
    for p, n in sizes:
        before[p], total = total, total + n
    # A row for each range, as many as the sort had partitions.
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "_part long, _before long")
    own = sorted_rows.withColumn("_part", F.shiftright("_at", PLACE_BITS)).join(F.broadcast(offsets), "_part")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    return own.select(*rows.columns, place.alias("place")), total


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    n: int = GRAM, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score, rank.

    Of the N rows with at least `min_words` words floor(percent * N / 100) are drawn: those of the highest scores, ties to the
    smaller id, null ids last, then to more features. rank is 1, 2, 3, ... among them and null for all others. Null, empty
    and blank texts have no feature and weight 0; a null id draws its noise as the empty text; very long texts are
    taken whole, and rows that repeat are scored and drawn each. An empty target has no feature: gains then follow the
    documents alone. Other columns are not read, so their names can't clash. An empty table gives an empty result.
    """
    own = hashed(docs, text_col, n, buckets, F.col(id_col).alias("doc_id"))
    own = stage(own.withColumn("row_key", F.monotonically_increasing_id()), "features")
    both = bucket_counts(own, "s").join(bucket_counts(hashed(target, target_col, n, buckets), "t"), "bucket", "full")
    counts = stage(both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "buckets")
    totals = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()

    # No more rows than buckets.
    gained = own.select("row_key", F.explode("buckets").alias("bucket")).join(F.broadcast(gains(counts, totals.s, totals.t, buckets)), "bucket")
    weights = gained.groupBy("row_key").agg(F.sum("gain").alias("weight"))
    scored = own.select("row_key", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features")).join(weights, "row_key", "left")
    scored = scored.withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long"))
    scored = stage(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    discard(own)
    discard(counts)

    able = scored.filter(F.col("n_words") >= min_words).drop("n_words")
    placed, total = ranked(able, F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.asc("row_key"))
    drawn = percent * total // 100
    rest = scored.filter(F.col("n_words") < min_words).drop("n_words").withColumn("place", F.lit(None).cast("long"))
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
