"""Readers of media folders, transcripts, metadata, queues and ground truth."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize

#: File patterns, in the order in which they are listed.
EXTENSIONS = ("mp4", "mkv", "mov", "avi")
SENTENCE = "array<struct<text:string,start:double,end:double>>"
TRANSCRIPT = f"language string, language_probability double, duration double, full_text string, segments array<struct<id:int,start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,sentences:{SENTENCE}>>"
META = "domain string, title string, source_url string, category string, extra map<string,string>"
EVAL = "query string, context string, answer string"
#: What is logged for each answer: the keyframes it rests on, in order of value, as well.
LOGGED = f"{EVAL}, keyframes array<string>"
TRUTH = "query string, expected_keyframe string, expected_answer string"
CHUNK = "chunk_id string, parent_chunk_id string, is_cross_scene_subchunk boolean, scene_index int, text string, start double, end double, keyframe_path string, sentence_count int, weight int"


def videos(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of the folder's videos, by kind and then by path; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").option("recursiveFileLookup", "false").load(folder)
    kind = F.array_position(F.array(*[F.lit(e) for e in EXTENSIONS]), F.regexp_extract("path", r"\.(\w+)$", 1))
    return files.select("path", "length", kind.alias("kind")).orderBy("kind", "path").drop("kind")


def contents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(folder).select("path", "length", "content")


def probe(rows: DataFrame, duration: Callable[[str], float]) -> DataFrame:
    """rows (path) with duration in seconds at three decimals and error; a file that cannot be probed does not stop the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b.path:
                try:
                    out.append((p, round(float(duration(p)), 3), None))
                except Exception as e:  # noqa: BLE001  whatever a probe raises marks its own file
                    out.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "duration", "error"])

    return rows.select("path").mapInPandas(run, "path string, duration double, error string")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def spoken(rows: DataFrame, vid_hash: str = "vid_hash") -> DataFrame:
    """vid_hash, ord, text, start, end: the non-blank sentences of transcripts."""
    s = rows.select(vid_hash, F.posexplode("segments").alias("i", "s")).select(vid_hash, "i", F.posexplode("s.sentences").alias("j", "x"))
    return s.select(F.col(vid_hash).alias("vid_hash"), (F.col("i").cast("long") * 1_000_000 + F.col("j")).alias("ord"), F.trim("x.text").alias("text"), "x.start", "x.end").filter("text <> ''")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of videos, a JSON document a file; what is broken or has no domain is `unknown`."""
    rows = spark.read.schema(META + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.withColumns({"domain": F.coalesce("domain", F.lit("unknown")), "path": F.input_file_name()}).drop("_corrupt_record")


def resolve_metadata(found: DataFrame, files: DataFrame, given: str | None = None) -> DataFrame:
    """path, meta_path for each video: the given path, `<stem>.source_meta.json` or `source_meta.json` beside it, or null.

    files: path of the metadata files that exist."""
    folder, stem = F.regexp_extract("path", r"^(.*/)[^/]*$", 1), F.regexp_extract("path", r"([^/]*)\.\w+$", 1)
    own = found.select("path", F.concat(folder, stem, F.lit(".source_meta.json")).alias("own"), F.concat(folder, F.lit("source_meta.json")).alias("common"))
    a, b = files.select(F.col("path").alias("own"), F.col("path").alias("a")), files.select(F.col("path").alias("common"), F.col("path").alias("b"))
    return own.join(a, "own", "left").join(b, "common", "left").select("path", F.coalesce(F.lit(given).cast("string"), "a", "b").alias("meta_path"))


def eval_queue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL).json(path).filter("query IS NOT NULL OR context IS NOT NULL OR answer IS NOT NULL")


def logged(spark: SparkSession, path: str) -> DataFrame:
    """All answers ever logged, with their keyframes; those logged without any have an empty list."""
    rows = spark.read.schema(LOGGED).json(path).filter("query IS NOT NULL OR context IS NOT NULL OR answer IS NOT NULL")
    return rows.withColumn("keyframes", F.coalesce("keyframes", F.array().cast("array<string>")))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """key, ord and the fields of each entry, in the file's order."""
    text = spark.read.option("wholetext", True).text(path)
    parsed = text.select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ':') for x in TRUTH.split(', '))}>>")).alias("ord", "e"))
    return parsed.select("ord", "e.*").withColumn("key", normalize(F.col("query")))


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).option("multiLine", True).json(path)
