"""Exact n-gram Jaccard self-join by rare-first prefixes.

A document is the set of its shingles, ordered from the rarest on. Two sets of sizes a and b that are similar enough share
at least o(a, b) shingles, so they share one among the first a - o + 1 of the one and b - o + 1 of the other. Only those
prefixes are joined. A pair that meets at a shingle goes on if
  - its sizes allow the similarity at all (length filter),
  - what follows the shingle in either set still has room for the overlap (positional filter), and
  - the sizes of the parts into which hash ranges cut both sets do not differ by more than a + b - 2 o (suffix filter),
and is then verified once on the whole sets. No filter loses a pair: the result is exact, whatever the order.

How frequent shingles are is counted over all documents, in a table of hashed counters whose size is fixed: a shingle that is
much more frequent than what shares its counter stands out, and only that matters for the order.

Documents of equal sets are one node. A shingle's bucket is not expanded into pairs: its members meet a leader first and
links are closed to components. Only members of different components go on, pair by pair in small buckets, in larger ones in
blocks of neighbouring sizes of which those meet whose sizes allow a link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_slices, stage
from .minhash import BLOCK_NODES, BLOCK_SHINGLES, _merging, components, overlaps
from .words import Hasher, grams, split

SHINGLE, PERCENT = 4, 85
#: Hashed counters of shingles, and into how many chunks they are cut to be summed.
COUNTERS, CHUNKS, FAN = 1 << 20, 16, 64
PARTS, FEW = 16, 32
_LONG, _LIST = pa.int64(), pa.list_(pa.int64())
_COUNTED = pa.schema([("doc_id", _LONG), ("node", pa.binary()), ("size", _LONG), ("chunk", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
_PREFIXES = pa.schema([("node", pa.binary()), ("doc_id", _LONG), ("text_hash", _LONG), ("size", pa.int32()), ("prefix", _LIST), ("low", _LONG), ("high", _LONG)])
_SETS = pa.schema([("id", _LONG), ("shingles", _LIST)])
#: Powers of two: bits of the filter of wanted texts at most.
FILTER_BITS = 24


def overlap(a: Column, b: Column, percent: int) -> Column:
    """The least number of common shingles that lets sets of sizes a and b be similar."""
    return F.ceil((a + b) * percent / F.lit(100.0 + percent)).cast("int")


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of the rarest shingles of a set may be the first it shares with a similar set of any size."""
    return n - -(-n * percent // 100) + 1


def shingle_set(text: str | None, hasher: Hasher, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    h = hasher.of(split(text, lower=True))
    return np.unique(grams(h, min(n, len(h)))) if len(h) else h


def node_key(own: np.ndarray) -> bytes:
    """A 128-bit name of a set of shingles."""
    return xxhash.xxh3_128_digest(own.tobytes())


def _counted(n: int):
    """Sets and, at the end of the task, what it has counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, counts = Hasher(), np.zeros(COUNTERS, np.int64)
        for b in batches:
            sets = [shingle_set(t, hasher, n) for t in b.text]
            if len(sets):
                np.add.at(counts, (np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), 1)
            yield pd.DataFrame({"doc_id": b.doc_id, "node": [node_key(s) for s in sets], "size": [len(s) for s in sets], "chunk": None, "part": None, "counts": None})
        part = TaskContext.get().partitionId()
        chunks = counts.reshape(CHUNKS, -1)
        yield pd.DataFrame({"doc_id": None, "node": None, "size": None, "chunk": range(CHUNKS), "part": part, "counts": [_packed(c) for c in chunks]})

    return run


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)


def counters(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters. It meets in a tree: a group adds up to FAN chunks, whatever the number of tasks."""

    def add(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTERS // CHUNKS, np.int64)
        for x in rows.counts:
            total += _unpacked(x)
        return pd.DataFrame({"chunk": rows.chunk.iloc[:1], "part": rows.part.iloc[:1] // FAN, "counts": [_packed(total)]})

    own = rows.filter("chunk IS NOT NULL").select("chunk", "part", "counts")
    most = own.agg(F.max("part")).first()[0] or 0
    while True:
        own = stage(own.groupBy("chunk", F.floor(F.col("part") / FAN)).applyInPandas(add, own.schema), "counters")
        if most < FAN:
            break
        most //= FAN
    out = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.int64)
    for r in own.collect():  # one row a chunk
        out[r.chunk] = _unpacked(r.counts)
    return out.reshape(-1)


def _prefixes(held, n: int, percent: int):
    """A set's rarest shingles, as far as its prefix goes, and the sizes of its parts, up to 255, as the bytes of two integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, counts = Hasher(), held.value
        for b in batches:
            rows = []
            for doc_id, text_hash, text in zip(b.doc_id, b.text_hash, b.text, strict=True):
                own = shingle_set(text, hasher, n)
                if len(own):
                    order = np.lexsort((own, counts[(own % np.uint64(COUNTERS)).astype(np.int64)]))
                    parts = np.bincount((own >> np.uint64(60)).astype(np.int64), minlength=PARTS)
                    low, high = np.minimum(parts, 255).astype(np.uint8).view(np.int64)
                    rows.append((node_key(own), doc_id, text_hash, len(own), own[order[: prefix_size(len(own), percent)]].view(np.int64), low, high))
            if rows:
                yield pd.DataFrame(rows, columns=["node", "doc_id", "text_hash", "size", "prefix", "low", "high"])

    return run


def near_sizes(a: str, b: str, percent: int) -> Column:
    """Whether members a and b of a bucket (structs of size, low, high) pass the length filter and the suffix filter."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    length = F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent
    octet = lambda c, k: F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))
    apart = sum((F.abs(octet(f"{a}.{half}", k) - octet(f"{b}.{half}", k)) for half in ("low", "high") for k in range(8)), F.lit(0))
    return length & (apart <= size_a + size_b - 2 * overlap(size_a, size_b, percent))


def fits(a: str, b: str, percent: int) -> Column:
    """Whether they pass the positional filter as well, by the rank of the shingle at which they meet."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    need = overlap(size_a, size_b, percent)
    return near_sizes(a, b, percent) & (size_a - F.col(f"{a}.rank") >= need) & (size_b - F.col(f"{b}.rank") >= need)


def _sets(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in batches:
            yield pd.DataFrame({"id": b.id, "shingles": [shingle_set(t, hasher, n).view(np.int64) for t in b.text]})

    return run


def sets_of(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets that `ids`, a staged table of one column, may name, and few others: the rest is not shuffled to a join that drops it."""
    wanted = ids.select(F.xxhash64(ids.columns[0]).alias("_id_hash"))
    return seen_in(sets.withColumn("id_hash", F.xxhash64("id")), "id_hash", wanted).drop("id_hash")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of staged pairs (a, b) those that are similar, counted on their whole sets."""
    left, right = (sets_of(pairs.select(x), sets).select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(b.sa, b.sb, strict=True)], np.int64)
            size = b.sa.map(len).to_numpy(np.int64) + b.sb.map(len).to_numpy(np.int64) - common
            yield b.loc[100 * common >= percent * size, ["a", "b"]]

    # Two joins in a row, each on a key that tells the rows of `sets` apart: a node in many pairs is split by AQE.
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "sa", "sb").mapInPandas(check, "a long, b long")


def _block_links(percent: int):
    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        label = pd.factorize(rows.label)[0]
        left = np.flatnonzero(rows.side == 0)
        right = np.flatnonzero(rows.side == 1) if rows.x.iloc[0] != rows.y.iloc[0] else left
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        pick = lambda at: [rows.shingles.iloc[k] for k in at]
        sizes = tuple(np.array([len(x) for x in pick(at)], float) for at in (left, right))
        found = _merging(overlaps(pick(left), pick(right)), sizes, (label[left], label[right]), percent / 100 - 1e-12)
        return pd.DataFrame({"a": [rows.id.iloc[left[i]] for i, _ in found], "b": [rows.id.iloc[right[j]] for _, j in found]}, dtype="int64")

    return run


def blocked(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different labels within large buckets: bucket, id, label, size, staged.

    A member's block is its class of sizes and a hash within it; a class ends where the next size could not be similar to its
    first, so similar sets lie in one class or in two that follow each other. A task holds two blocks, and a set travels once for each block it meets.
    """
    step = max(math.log(100 / percent), 1e-6) * (1 + 1e-6)
    band = F.floor(F.log(F.col("size").cast("double")) / step).cast("int")
    own = members.withColumn("band", band)
    of_band = own.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("mass"), F.countDistinct("label").alias("labels"))
    cut = F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("mass") / BLOCK_SHINGLES)).cast("int")
    cuts = stage(of_band.select("bucket", "band", cut.alias("cuts"), "labels"), "bands")
    above = cuts.select("bucket", (F.col("band") - 1).alias("band"), F.col("cuts").alias("cuts_above"))
    below = cuts.select("bucket", (F.col("band") + 1).alias("band"), F.col("cuts").alias("cuts_below"))
    plan = stage(cuts.join(above, ["bucket", "band"], "left").join(below, ["bucket", "band"], "left").na.fill(0, ["cuts_above", "cuts_below"]), "block-plan")
    u = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(2**53))
    member = own.join(plan, ["bucket", "band"]).withColumn("i", F.floor(u * F.col("cuts")).cast("int"))
    none = F.array().cast("array<struct<low:int,x:int,y:int,side:int>>")
    at = lambda low, x, y, side: F.struct(low.cast("int").alias("low"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # Blocks of one class meet once each; x is never above y. Blocks of the next class are y, shifted so that they differ from x.
    same = F.transform(upto(F.col("cuts")), lambda k: at(F.col("band"), F.least("i", k), F.greatest("i", k), F.when(F.col("i") <= k, 0).otherwise(1)))
    same = F.when((F.col("cuts") > 1) | (F.col("labels") > 1), same).otherwise(none)
    up = F.when(F.col("cuts_above") > 0, F.transform(upto(F.col("cuts_above")), lambda k: at(F.col("band"), F.col("i"), -1 - k, F.lit(0)))).otherwise(none)
    down = F.when(F.col("cuts_below") > 0, F.transform(upto(F.col("cuts_below")), lambda k: at(F.col("band") - 1, k, -1 - F.col("i"), F.lit(1)))).otherwise(none)
    dealt = member.select("bucket", "id", "label", F.explode(F.concat(same, up, down)).alias("at")).join(sets_of(members.select("id"), sets), "id").select("bucket", "at.*", "id", "label", "shingles")
    return dealt.groupBy("bucket", "low", "x", "y").applyInPandas(_block_links(percent), "a long, b long")


def pairs_of_few(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that meet in buckets of at most FEW members and pass the filters, each once.

    Here the positional filter counts on: what a pair shares is no more than the shingles at which it has met, those of larger
    buckets before the last of them, and what follows that one.
    """
    few = buckets.filter(F.col("n") <= FEW)
    one, two = (few.select("bucket", F.col("id").alias(x), F.col("m").alias(f"m{x}")) for x in "ab")
    met = one.join(two, "bucket").filter((F.col("a") < F.col("b")) & near_sizes("ma", "mb", percent))
    last = [F.max(f"m{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("rank", "large", "size")]
    told = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), *last)
    after = F.least(F.col("size_a") - F.col("rank_a"), F.col("size_b") - F.col("rank_b")) - 1
    most = F.col("c") + F.least("large_a", "large_b") + after
    return told.filter(most >= overlap(F.col("size_a"), F.col("size_b"), percent)).select("a", "b")


def pairs_with_leaders(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs of each bucket's members with its leader that pass the filters, each once."""
    # The leader meets most others over all its buckets: of copies with different edits, the original.
    mass = stage(buckets.groupBy("id").agg(F.sum("n").alias("mass")), "masses")
    lead = F.min(F.struct((-F.col("mass")).alias("order"), "id", "m")).alias("lead")
    leads = stage(buckets.join(mass, "id").groupBy("bucket").agg(lead).select("bucket", F.col("lead.id").alias("lead"), F.col("lead.m").alias("l")), "leaders")
    star = buckets.join(leads, "bucket").filter((F.col("id") != F.col("lead")) & fits("m", "l", percent))
    return star.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def links(buckets: DataFrame, star: DataFrame, few: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, label of all nodes that have a link.

    buckets: bucket, id, n (the bucket's members), m (size, rank, large, low, high); star: pairs with leaders; few: those of small buckets.
    """
    edges = stage(verified(star, sets, percent), "links")
    labels = components(edges)
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    label = lambda x: F.coalesce(f"l{x}", x)
    open_pairs = few.join(star, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").filter(label("a") != label("b")).select("a", "b")
    open_pairs = stage(open_pairs, "open-pairs")

    large = buckets.filter(F.col("n") > FEW).select("bucket", "id", F.col("m.size").alias("size"))
    marked = stage(large.join(labels, large.id == labels.node, "left").select("bucket", "id", "size", F.coalesce("label", "id").alias("label")), "marked")
    mixed = marked.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("mixed")).filter("mixed").select("bucket")
    members = stage(marked.join(stage(mixed, "mixed"), "bucket"), "open-members")
    more = verified(open_pairs, sets, percent).unionByName(blocked(members, sets, percent))
    more = stage(more, "more-links")
    return labels if more.isEmpty() else components(edges.unionByName(more))


def seen_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose 64-bit key may be in `wanted`, and few others: spares the shuffle of a join most of its rows.

    A bit for each hash value, at most FILTER_BITS of them, goes to all tasks; where far more keys are wanted than there are bits, all
    rows stay, and the join after it decides alone.
    """
    n = wanted.count()
    bits = 1 << max(10, min(FILTER_BITS, (64 * n).bit_length()))
    at = F.pmod(F.col(wanted.columns[0]), F.lit(bits))
    set_bits = wanted.select(F.floor(at / 64).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({wanted.columns[0]}, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    words = np.zeros(bits // 64, np.int64)
    for r in set_bits.collect():  # at most bits / 64 rows
        words[r.w] = r.b
    held = rows.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        k = keys.to_numpy(np.int64) % bits
        return pd.Series((held.value[k >> 6] >> (k & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return rows.filter(maybe(F.col(key)))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) and split at white space; a document's set holds its distinct shingles of n words, or its whole
    sequence where it has fewer. Documents are linked if 100 * intersection >= percent * union; component_id is the smallest
    id reachable by links, its own included. Null, empty and blank texts have an empty set and are linked with nothing.
    Very long texts are taken whole. Rows that repeat are linked with each other; a null id names no component, and one of null
    ids alone has component_id null. Ids are cast to long (an id that is no number raises). Other columns are not
    read, so their names can't clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    both = rows.mapInArrow(in_slices(_counted(n), _COUNTED), "doc_id long, node binary, size long, chunk int, part int, counts binary")
    both = stage(both, "documents")
    who = both.filter("chunk IS NULL").select("doc_id", "node", F.col("size").alias("n_shingles"))
    held = spark.sparkContext.broadcast(counters(both))  # COUNTERS numbers

    keyed = rows.withColumn("text_hash", F.xxhash64("text"))
    found = keyed.mapInArrow(in_slices(_prefixes(held, n, percent), _PREFIXES), "node binary, doc_id long, text_hash long, size int, prefix array<long>, low long, high long")
    prefixes = stage(found.dropDuplicates(["node"]).withColumn("id", F.monotonically_increasing_id()), "prefixes")
    held.unpersist()

    spread = prefixes.select("id", F.posexplode("prefix").alias("rank", "bucket"))
    shared = stage(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    met = stage(spread.join(shared, "bucket"), "met")
    nodes = stage(prefixes.drop("prefix"), "nodes")  # prefixes are most of the table, and all that follows is without them
    discard(prefixes)
    own = met.join(nodes.select("id", "size", "low", "high"), "id")
    before = F.coalesce(F.count_if(F.col("n") > FEW).over(Window.partitionBy("id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = stage(own.withColumn("large", before).select("bucket", "id", "n", F.struct("size", "rank", "large", "low", "high").alias("m")), "buckets")
    discard(shared)
    discard(met)

    few, star = stage(pairs_of_few(buckets, percent), "few"), stage(pairs_with_leaders(buckets, percent), "star")
    # Only nodes that some pair or a larger bucket holds are looked up: most shared shingles lead to no pair at all.
    in_pairs = few.unionByName(star).select(F.explode(F.array("a", "b")).alias("id"))
    open_ids = in_pairs.unionByName(buckets.filter(F.col("n") > FEW).select("id")).distinct()
    wanted = nodes.join(open_ids, "id", "left_semi").select("id", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    wanted = stage(wanted, "wanted")
    # By id and text: copies of a wanted text stay where they are.
    texts = seen_in(keyed.withColumn("row_hash", F.xxhash64("doc_id", "text_hash")), "row_hash", wanted.select(F.xxhash64("_id", "_hash").alias("_row"))).drop("row_hash")
    texts = texts.join(wanted, keyed.doc_id.eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    sets = stage(texts.select("id", "text").mapInArrow(in_slices(_sets(n), _SETS), "id long, shingles array<long>"), "sets")
    if not sets.groupBy("id").count().filter("count > 1").isEmpty():  # rows of one id and text, as far as there are any
        sets = stage(sets.dropDuplicates(["id"]), "sets")

    labels = links(buckets, star, few, sets, percent)
    of_node = stage(nodes.select("id", "node").join(labels.withColumnRenamed("node", "_id"), F.col("id") == F.col("_id"), "left").select("node", F.coalesce("label", "id").alias("label")), "labels")
    told = stage(who.join(of_node, "node", "left").select("doc_id", "n_shingles", "label"), "labelled")
    least = stage(told.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id")), "components")
    out = told.join(least, "label", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
