"""Small pieces shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space, and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
#: Matches only white space that differs from one single space.
WS_ODD = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)

#: Rows of a batch that a task looks at together.
SLICE_ROWS = 1000

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made where no shared one is set, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tempora-"))
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no more than its tasks."""
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    # Nothing reads what this write has shuffled once it is done: those files go then, not when the driver next collects garbage.
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that is no longer read."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def in_slices(run: Callable, schema: pa.Schema, rows: int = SLICE_ROWS) -> Callable:
    """`run`, a function from pandas frames to pandas frames, for mapInArrow: a task turns so many rows of a batch into objects at a time.

    Spark's batches have 10,000 rows: their texts, as strings, with what is made of them would be in memory at once.
    """

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole numbers stay so beside nulls.
        parts = (b.slice(at, rows).to_pandas(integer_object_nulls=True) for b in batches for at in range(0, b.num_rows, rows))
        for out in run(parts):
            yield pa.RecordBatch.from_pandas(out, schema, preserve_index=False)

    return sliced


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; plain ASCII takes the cheaper function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def remainder(id_col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % of).cast("int")


def most_frequent(counts: DataFrame, n: str, size: int) -> DataFrame:
    """The rows of at most `size` most frequent words: those from the least count on that no more than `size` words reach.

    Only the histogram of counts is ordered, so that neither words nor partial top lists gather anywhere.
    """
    # Counts from 64 on share a bucket with those within a sixty-fourth of them: a histogram of bounded size.
    level = F.when(F.col(n) < 64, F.col(n)).otherwise(64 + F.floor(F.log2(F.col(n) / 64.0) * 64)).cast("long")
    rows = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    left, least = size, None
    for r in sorted(rows, key=lambda r: -r.level):
        left -= r.words
        if left < 0:
            break
        least = r.level
    return counts.filter(level >= least) if least is not None else counts.limit(0)
