"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, byte-level BPE.

Counted with the subpackage `tempora.llm`. Every stage works on all that its predecessor kept and is written as Parquet
before the next one reads it; all but the last return the columns of documents, and columns beyond those are kept under their
own names. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bpe, decontaminate, exact_dedup, minhash, toxicity
from tempora.llm.common import stage, table

#: Words of the coder's dictionary. It passes through the driver, which holds five stages' plans here; a word beyond it is folded where it stands.
DICTIONARY_WORDS = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; learns from labels of the documents that are not held out.

    Null and empty texts are scored like a text without any term. Without labels, or without documents, nothing is learnt and
    every text has one score. Rows that repeat are scored each.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """The smallest id of each group of equal texts; null and empty texts are one group, null ids come last."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """The smallest id of each class of near-duplicates; texts without words are one class, null ids come last."""
    return minhash.keep_representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null texts hold none, and an empty benchmark leaves all."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """doc_id, source, lang, ids, n_tokens, and whether decoding gives the text's bytes back; a null text has no ids."""
    coder = bpe.default_tokenizer(spark)
    out = coder.encode(docs, dictionary_words=DICTIONARY_WORDS)
    same = coder.decode(F.col("ids")) == F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("decodes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: A trained classifier, LSH and BPE are beyond SQL; tests hold the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
