"""Line deduplication over levelled sorted runs of line keys.

The index is a set of runs: bucketed tables sorted by key, each key in exactly one of them. A new batch is summed to one
row a key, merge-anti-joined with the runs, and the keys that no run holds become a run of the batch's own; what the batch
adds to keys already held goes to a small table of updates. Once a level holds `fanout` runs they are merged into one run
of the next level, so that a batch meets few runs however many came before.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, discard, stage

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 3, 3
KEY = ["h1", "h2"]


class LineRuns:
    """The levelled runs. A run's columns: h1, h2 (128-bit key), n (documents), top (largest id)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.made = f"line_runs_{uuid.uuid4().hex}", 0
        self.levels: list[list[str]] = []
        self.updates: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.made += 1
        name = f"{self.name}_{level}_{self.made}"
        rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.levels[level].append(name)

    def absorb(self, batch: DataFrame) -> None:
        """batch: h1, h2, id; one row for each document and key. Documents come in one batch only."""
        own = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
        if runs := self.runs():
            own = stage(own, "line-batch")
            self.updates.append(stage(reduce(DataFrame.unionByName, [own.join(r, KEY, "left_semi") for r in runs]), "line-updates"))
        self._write(reduce(lambda rows, run: rows.join(run, KEY, "left_anti"), runs, own), 0)
        if runs:
            discard(own)
        self._compact()

    def _compact(self) -> None:
        for level, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                self._write(reduce(DataFrame.unionByName, [self.spark.table(t) for t in names]), level + 1)
                self.levels[level] = []
                for t in names:
                    self.spark.sql(f"DROP TABLE {t}")

    def totals(self) -> DataFrame:
        """h1, h2, n, top over all batches."""
        if not self.updates:
            return reduce(DataFrame.unionByName, self.runs())
        added = reduce(DataFrame.unionByName, self.updates).groupBy(*KEY).agg(F.sum("n").alias("more"), F.max("top").alias("upper"))
        added = stage(added, "line-added")
        return reduce(DataFrame.unionByName, [run.join(added, KEY, "left").select(*KEY, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("top", "upper").alias("top")) for run in self.runs()])

    def drop(self) -> None:
        for t in [t for level in self.levels for t in level]:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.levels = []


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def _long(line: Column, min_chars: int) -> Column:
    return (F.octet_length(line) >= min_chars) & (F.char_length(F.btrim(line, F.lit(SPACES))) >= min_chars)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_dropped, kept_text.

    A line whose key has at least `min_chars` code points and stands in at least `min_docs` rows is dropped except where
    the id is the largest that holds it. Null or empty texts are one empty line; a null id is below every other id. Rows
    that share an id count each. Very long texts are taken whole, in time linear in their lines. An empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keys = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"), F.col("doc_id").alias("id"), F.explode(F.transform(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: _long(x, min_chars)), _key)), _hashed)).alias("k"))  # texts are told apart by hashing, structs one by one
    keys = stage(keys.select("batch", "id", "k.h1", "k.h2"), "line-keys")
    index = LineRuns(spark)
    for b in range(batches):
        index.absorb(keys.filter(F.col("batch") == b))
    common = stage(index.totals().filter(F.col("n") >= min_docs).select(*KEY, "top"), "common-lines")
    index.drop()

    # Places of lost lines, by id and text: rows that share an id, or have none, keep apart, and equal rows have equal places.
    lines = _lines(F.col("text"))
    own = rows.withColumn("text_hash", F.xxhash64("text"))
    placed = F.filter(F.transform(lines, lambda x, i: F.when(_long(x, min_chars), F.struct(i.alias("at"), _hashed(_key(x)).alias("k")))), lambda x: x.isNotNull())
    spread = own.select("doc_id", "text_hash", F.explode(placed).alias("p")).select("doc_id", "text_hash", "p.at", "p.k.h1", "p.k.h2")
    lost = spread.join(common, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("lost"))
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "lost")
    joined = own.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    # Sets of integers are subtracted by hashing: the time is linear in the lines of a document.
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.transform(places, lambda at: F.get("lines", at)))
    return joined.withColumn("lines", lines).withColumn("kept", kept).select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text")
    )
