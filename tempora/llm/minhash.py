"""Near-duplicates by ProbMinHash over weighted and over plain shingles, banding and exact verification.

A document is the set of its shingles of five words, each weighted by how often it occurs. Every shingle is the source of
a Poisson process whose rate is its weight: arrivals come at exponential distances and each falls on one of the slots of
the signature, which keeps the earliest. Rounds of arrivals are generated for all shingles of many documents at once; a
shingle stops once its clock has passed the latest of its document's slots, since no later arrival can matter. Two slots
agree with the documents' probability Jaccard similarity.

What is verified is the Jaccard similarity of sets, which counts do not enter: near sets of unequal counts would seldom meet
in bands of weighted signatures. So a document that repeats a shingle has a second group of bands, of the signature with
every shingle at weight one, whose slots agree with the Jaccard similarity of sets. Where no shingle repeats the two signatures
are the same, and both groups share their keys, so that such a document has its bands once and meets either kind.

Documents of equal words are one node. Nodes that share a band meet in buckets. A bucket is not expanded into pairs: its
members are held against a leader, the one that meets most others over all buckets, and verified links are closed to
classes. In a bucket whose members still lie in different classes every pair across classes is tested in blocks: a task
holds two blocks of bounded size, counts all their intersections at once and returns only links that join classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, stage
from .words import Hasher, grams, mixed, split

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 24, 5, 0.8
#: Members of a block, and shingles in it on average; buckets of no more than FEW members are tested pair by pair.
BLOCK_NODES, BLOCK_SHINGLES, FEW = 512, 500_000, 4
COLUMNS, BATCH_WORDS = 4096, 150_000


def shingles(words: list[bytes], hasher: Hasher, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles in order; a shorter text that has any words is one shingle."""
    h = hasher.of(words)
    return grams(h, min(n, len(h))) if len(h) else h


def signatures(sets: list[np.ndarray], slots: int, weighted: bool = True) -> np.ndarray:
    """For each document the hash of the element that comes first in each slot; zero where the document has none.

    An element's weight is how often it stands in the list, or one where `weighted` is false.
    """
    n = len(sets)
    times, firsts = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)
    unique = [np.unique(s, return_counts=True) for s in sets]
    doc = np.repeat(np.arange(n), [len(u) for u, _ in unique])
    if not len(doc):
        return firsts.reshape(n, slots)
    element = np.concatenate([u for u, _ in unique])
    rate = np.concatenate([c for _, c in unique]).astype(float) if weighted else np.ones(len(element))
    state, clock = element.copy(), np.zeros(len(element))
    while len(element):
        state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
        clock = clock - np.log(((state >> np.uint64(11)).astype(float) + 0.5) / 2**53) / rate
        state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
        at = doc * slots + (state % np.uint64(slots)).astype(np.int64)
        order = np.lexsort((element, clock, at))
        lead = order[np.concatenate([[True], np.diff(at[order]) != 0])]
        better = lead[clock[lead] < times[at[lead]]]
        times[at[better]], firsts[at[better]] = clock[better], element[better]
        on = clock < times.reshape(n, slots).max(axis=1)[doc]
        element, rate, state, clock, doc = element[on], rate[on], state[on], clock[on], doc[on]
    return firsts.reshape(n, slots)


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> list[np.ndarray]:
    """Keys of each document's bands: of its weighted signature, and of that with all weights one where a shingle repeats."""

    def keys(some: list[np.ndarray], weighted: bool) -> np.ndarray:
        sig = signatures(some, bands * rows, weighted).reshape(len(some), bands, rows)
        key = np.zeros((len(some), bands), np.uint64)
        for r in range(rows):
            key = mixed(key * np.uint64(31) + sig[:, :, r] + np.arange(1, bands + 1, dtype=np.uint64))
        return key

    out = [k if len(s) else k[:0] for k, s in zip(keys(sets, True), sets, strict=True)]
    again = [i for i, s in enumerate(sets) if len(np.unique(s)) < len(s)]
    for i, k in zip(again, keys([np.unique(sets[i]) for i in again], False), strict=True):
        out[i] = np.union1d(out[i], k)
    return out


def _nodes(bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in batches:
            texts, start = [split(t, lower=True) for t in b.text], 0
            while start < len(b):
                stop, size = start, 0
                while stop < len(b) and (size == 0 or size < BATCH_WORDS):
                    size, stop = size + len(texts[stop]) + 1, stop + 1
                part = texts[start:stop]
                keys = band_keys([shingles(w, hasher) for w in part], bands, rows)
                own = b.iloc[start:stop]
                yield pd.DataFrame({
                    "doc_id": own.doc_id, "text_hash": own.text_hash, "node": [xxhash.xxh3_128_digest(b" ".join(w)) for w in part],
                    "bands": [k.view(np.int64) for k in keys],
                })
                start = stop

    return run


def _shingle_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = Hasher()
    for b in batches:
        sets = [np.unique(shingles(split(t, lower=True), hasher)).view(np.int64) for t in b.text]
        yield pd.DataFrame({"node": b.node, "shingles": sets})


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of nodes those whose Jaccard similarity over shingle sets is at least the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").filter(F.col("sa").isNotNull()).join(right, "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(b.sa, b.sb, strict=True)], float)
            size = b.sa.map(len).to_numpy(float) + b.sb.map(len).to_numpy(float) - common
            yield b.loc[common >= threshold * size, ["a", "b"]]

    return both.select("a", "b", "sa", "sb").mapInPandas(check, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node with an edge. Labels shrink and jump until none changes."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        now = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        now = stage(now.join(up, "next", "left").select("node", "label", F.least("next", F.coalesce("jump", "next")).alias("next")), "labels")
        if now.filter("label <> next").isEmpty():
            discard(now)
            return labels
        discard(labels)
        labels = now.select("node", F.col("next").alias("label"))


def _merging(common: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], labels: tuple[np.ndarray, np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Of the links of a block pair those that join two labels not joined before: no more than there are labels."""
    linked = (common >= threshold * (sizes[0][:, None] + sizes[1][None, :] - common)) & (labels[0][:, None] != labels[1][None, :])
    above = np.arange(1 + max([-1, *labels[0], *labels[1]]))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = top(labels[0][i]), top(labels[1][j])
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block of sets with another, by products of incidence matrices COLUMNS wide."""
    out = np.zeros((len(left), len(right)))
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for sets in (left, right):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        own = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[own], kind="stable")
        sides.append((at[own][order], row[own][order]))
    for start in range(0, len(both), COLUMNS):
        part = []
        for (at, row), sets in zip(sides, (left, right), strict=True):
            lo, hi = np.searchsorted(at, [start, start + COLUMNS])
            matrix = np.zeros((len(sets), min(COLUMNS, len(both) - start)), np.float32)
            matrix[row[lo:hi], at[lo:hi] - start] = 1
            part.append(matrix)
        out += part[0] @ part[1].T
    return out


def _block_links(threshold: float):
    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        label = pd.factorize(rows.label)[0]
        left = np.flatnonzero(rows.side == 0)
        right = np.flatnonzero(rows.side == 1) if (rows.side == 1).any() else left  # a block with itself comes once
        pick = lambda at: [rows.shingles.iloc[k] for k in at]
        if not len(left) or rows.with_main.iloc[0] and right is left:
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        sizes = tuple(np.array([len(x) for x in pick(at)], float) for at in (left, right))
        found = _merging(overlaps(pick(left), pick(right)), sizes, (label[left], label[right]), threshold)
        return pd.DataFrame({"a": [rows.node.iloc[left[i]] for i, _ in found], "b": [rows.node.iloc[right[j]] for _, j in found]}, dtype=object)

    return run


def _mixed_buckets(marked: DataFrame) -> DataFrame:
    """bucket, n, main (the label of most members), and in how many blocks its members and the others are cut."""
    of_label = marked.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("size"))
    main = F.max(F.struct("m", "label", "size")).alias("main")
    out = of_label.groupBy("bucket").agg(F.sum("m").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("labels"), main).filter("labels > 1 AND n > 2")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK_NODES), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    m, of_main = F.col("main.m"), F.col("main.size")
    return out.select("bucket", "n", F.col("main.label").alias("main"), blocks(m, of_main).alias("mains"), blocks(F.col("n") - m, F.col("size") - of_main).alias("others"))


def _blocked(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between different labels within buckets.

    A bucket's main label is cut into blocks, its other members likewise; each block of others meets each block of others
    and each of the main label's. A task holds two blocks, so a set travels once for each block it meets, not for each pair.
    """
    i = F.floor(F.col("u") * F.when(F.col("label") == F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    member = members.withColumn("i", i)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    mine = F.transform(upto(F.col("others")), lambda k: F.struct(F.lit(True).alias("with_main"), k.alias("x"), F.col("i").alias("y"), F.lit(1).alias("side")))
    own = F.transform(upto(F.col("others")), lambda k: F.struct(F.lit(False).alias("with_main"), F.least("i", k).alias("x"), F.greatest("i", k).alias("y"), F.when(F.col("i") <= k, 0).otherwise(1).alias("side")))
    other = F.transform(upto(F.col("mains")), lambda k: F.struct(F.lit(True).alias("with_main"), F.col("i").alias("x"), k.alias("y"), F.lit(0).alias("side")))
    place = F.when(F.col("label") == F.col("main"), mine).otherwise(F.concat(own, other))
    dealt = member.join(sets.select("node", "shingles"), "node").select("bucket", "node", "label", "shingles", F.explode(place).alias("at")).select("bucket", "at.*", "node", "label", "shingles")
    return dealt.groupBy("bucket", "with_main", "x", "y").applyInPandas(_block_links(threshold), "a binary, b binary")


def _links(buckets: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Labels of all nodes that have a verified link. buckets: bucket, node, u (its place in [0, 1)), only of two and more."""
    # The leader is the member that meets most others over all its buckets: of copies with different edits, the original.
    sizes = stage(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket-sizes")
    mass = buckets.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("mass"))
    leads = buckets.join(stage(mass, "masses"), "node").groupBy("bucket").agg(F.min(F.struct((-F.col("mass")).alias("order"), "u", "node")).alias("lead"))
    star = buckets.join(stage(leads, "leaders"), "bucket").select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).filter("a <> b").distinct()
    edges = stage(_verified(star, sets, threshold), "links")
    labels = components(edges)

    size = sets.select("node", F.size("shingles").cast("long").alias("size"))
    marked = buckets.join(labels, "node", "left").join(size, "node").select("bucket", "node", "u", "size", F.coalesce("label", "node").alias("label"))
    marked = stage(marked, "marked")
    members = stage(marked.drop("size").join(stage(_mixed_buckets(marked), "mixed"), "bucket"), "open")
    few = members.filter(F.col("n") <= FEW)
    one, two = few.select("bucket", F.col("node").alias("a"), F.col("label").alias("la")), few.select("bucket", F.col("node").alias("b"), F.col("label").alias("lb"))
    pairs = one.join(two, "bucket").filter("a < b AND la <> lb").select("a", "b").distinct()
    more = _blocked(members.filter(F.col("n") > FEW), sets, threshold)
    more = stage(_verified(pairs, sets, threshold).unionByName(more), "more-links")
    return labels if more.isEmpty() else components(edges.unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, class_id, class_size, kept.

    Words are lower-cased (A-Z) and split at white space. Documents are linked if their shingle sets have a Jaccard
    similarity of at least `threshold`; classes are the closure of links. Texts of equal words are linked always, so
    null, empty and blank texts are one class. class_id is the class's smallest id (null if all are), and of its rows
    that bear it one is kept. A text of under five words is one shingle; very long texts are taken whole. Ids are cast to long
    (an id that is no number raises). Other columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    who = rows_in.mapInPandas(_nodes(bands, rows), "doc_id long, text_hash long, node binary, bands array<long>").withColumn("row_key", F.monotonically_increasing_id())
    who = stage(who, "nodes")

    place = (F.shiftrightunsigned(F.xxhash64("node"), 11) / F.lit(float(2**53))).alias("u")
    spread = who.select("node", F.explode("bands").alias("bucket")).distinct()
    shared = spread.groupBy("bucket").count().filter("count > 1").select("bucket")
    buckets = stage(spread.join(shared, "bucket").select("bucket", "node", place), "shared-buckets")

    wanted = who.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).join(buckets.select("node").distinct(), "node")
    wanted = wanted.select("node", F.col("r.doc_id").alias("_id"), F.col("r.text_hash").alias("_hash"))
    found = rows_in.join(wanted, rows_in.doc_id.eqNullSafe(wanted["_id"]) & (rows_in.text_hash == wanted["_hash"]))
    sets = stage(found.select("node", "text").mapInPandas(_shingle_sets, "node binary, shingles array<long>").dropDuplicates(["node"]), "shingles")

    labels = _links(buckets, sets, threshold)
    classes = who.drop("bands").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    groups = classes.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size"))
    groups = stage(groups, "classes")  # a join of two tables: Spark splits a class that holds many rows
    return classes.join(groups, "label").select("doc_id", "text_hash", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row_key") == F.col("first.row_key")).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each class, with all their columns.

    Rows with the same id and text count as one; which of them stays is open. Null, empty and very long texts, null ids and
    an empty table are treated as in `near_duplicates`.
    """
    own_hash, keep_id, keep_hash = fresh(docs, "text_hash", "keep_id", "keep_hash")
    kept = near_duplicates(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(keep_id), F.col("text_hash").alias(keep_hash))
    own = docs.withColumn(own_hash, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = own.join(kept, own[id_col].eqNullSafe(kept[keep_id]) & (own[own_hash] == kept[keep_hash]), "left_semi")
    return rows.dropDuplicates([id_col, own_hash]).select(*docs.columns)
