"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted in their partitions and numbered, so equal blocks bear
one integer name and different blocks never share one. A name is only good for telling what is equal: its value follows the
number of partitions. Adjacent names are then paired and the distinct pairs are sorted
and numbered again, until each document is left with a single name: two texts are equal exactly if their number of blocks
and their last name are.

Block contents cross the network once, when they are made distinct. Occurrences find their block's name by a 128-bit key
of the block; that no two distinct blocks share a key is checked on the names, and another seed is taken if any do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_ODD, discard, fresh, stage

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS_ODD, " ")


def _keys(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), "block").alias("h1"), F.xxhash64(F.lit(~seed), "block").alias("h2")]


def _numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """Sorted rows with integer names. Staged by the caller: names never change once written."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _block_names(blocks: DataFrame, seed: int = 1) -> tuple[DataFrame, int]:
    while True:
        named = _numbered(blocks.select(*_keys(seed), "block").distinct(), "block")
        names = stage(named.select("h1", "h2", "name"), "block-names")
        if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            return names, seed
        discard(names)
        seed += 1


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: row_key, doc_id, text_sha256, n_blocks, name.

    Texts are equal after normalisation exactly if (n_blocks, name) are equal. Null texts are empty; a null id is kept.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).cast("binary").alias("_body"))
    base = base.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("_body") / block_bytes)).cast("int"))
    cut = F.substring(F.col("_body"), F.col("pos") * block_bytes + 1, F.lit(block_bytes)).alias("block")
    blocks = base.select("_body", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("pos")).select(cut)
    names, seed = _block_names(blocks)

    sha = F.when(F.col("pos") == 0, F.sha2("_body", 256)).alias("text_sha256")
    found = base.withColumn("row_key", F.monotonically_increasing_id())
    found = found.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("pos"))
    found = stage(found.select("row_key", "doc_id", "n_blocks", "pos", sha, cut).select("row_key", "doc_id", "n_blocks", "pos", "text_sha256", *_keys(seed)), "blocks")
    named = found.join(names, ["h1", "h2"]).drop("h1", "h2")

    single = named.filter("n_blocks = 1").drop("pos")
    level, most = stage(named.filter("n_blocks > 1"), "names-0"), found.agg(F.max("n_blocks")).first()[0] or 1
    width = most
    while width > 1:
        width = (width + 1) // 2
        side = F.col("pos") % 2
        pairs = level.groupBy("row_key", F.shiftright("pos", 1).alias("pos")).agg(
            F.max("doc_id").alias("doc_id"), F.max("n_blocks").alias("n_blocks"), F.max("text_sha256").alias("text_sha256"),
            F.max(F.when(side == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = stage(pairs, "pairs")
        names = stage(_numbered(pairs.select("a", "b").distinct(), "a", "b"), "pair-names")
        level = stage(pairs.join(names, ["a", "b"]).drop("a", "b"), "names")
    return single.unionByName(level.drop("pos"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest id stays; null ids come last, and of rows with the same id and text one stays. A group
    whose ids are all null has keep_id null. Null and empty texts are equal. An empty table gives an empty result.
    """
    who = stage(identities(docs, id_col, text_col, block_bytes), "identities")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    groups = who.groupBy("n_blocks", "name").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = stage(groups, "groups")  # a join of two tables: Spark splits a group that holds many rows
    return who.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row_key") == F.col("first.row_key")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of those with equal texts one with the smallest id.

    Rows with the same id and equal texts count as one; which of them stays is open. Null, empty and very long texts, null
    ids and an empty table are treated as in `exact_dedup`.
    """
    sha, keep_id, keep_sha = fresh(docs, "sha256", "keep_id", "keep_sha256")
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(keep_sha))
    own = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    rows = own.join(kept, own[id_col].eqNullSafe(kept[keep_id]) & (own[sha] == kept[keep_sha]), "left_semi")
    return rows.dropDuplicates([id_col, sha]).select(*docs.columns)
