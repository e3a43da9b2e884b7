"""Substring deduplication: one level of a suffix tree, dealt to memory-sized groups.

Suffixes start at every word. What counts is the tree's level at the depth of one window: an internal node there, a path with
more than one suffix below it, is a repeat, and runs of such nodes along a document are its maximal repeats. A tree over
words would need every suffix to bring its own window of words along, some twenty times the text, so no tree is built: a
path is a 64-bit name, and names meet in groups. A group is given by the path's prefix and by a second fingerprint of the whole
path that shares no step with the name, so that groups stay of one size whatever prefix is frequent. Two different windows count as
one only if name and group both agree; the number of groups grows with the corpus and lengthens what is compared.

Tasks first settle their own block of documents, so that only the earliest suffix below a node enters a group and a passage
that every document repeats sends one suffix a block; the block's later suffixes are repeats already and travel by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BASE, BASE_INVERSE, Hasher, joined, mixed, split

WINDOW, PREFIX_BYTES = 20, 24
BLOCK_WORDS, GROUP_WORDS, SHARD_BYTES = 600_000, 1_000_000, 4_000_000
NO_ID = np.iinfo(np.int64).max
#: A prime: taken modulo it first, ids at regular distances fall into all shards.
SPREAD = 1_000_000_007
BRANCHES = "group int, names binary, first binary, again binary"
REMOVED = "shard int, spans binary"
KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _pack(docs: np.ndarray, starts: np.ndarray) -> bytes:
    """Positions in order of document: differences of ids, and starts, compressed."""
    return zstandard.compress(np.diff(docs, prepend=0).astype(np.int64).tobytes() + starts.astype(np.int32).tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw[: 8 * n], np.int64)), np.frombuffer(raw[8 * n :], np.int32)


NOTHING = _pack(np.zeros(0, np.int64), np.zeros(0, np.int32))


def path_names(h: np.ndarray, window: int) -> np.ndarray:
    """A fingerprint for each `window` consecutive words, by doubling."""
    name, have, out, done = h, 1, None, 0
    while True:
        if window & have:
            part = name[done:]
            if out is None:
                out = part
            else:
                n = min(len(out), len(part))
                out = mixed(out[:n] * BASE + part[:n])
            done += have
        if done == window:
            return out[: max(0, len(h) - window + 1)]
        name = mixed(name[:-have] * BASE + name[have:]) if len(name) > have else name[:0]
        have *= 2


def path_groups(h: np.ndarray, ends: np.ndarray, window: int, groups: int) -> np.ndarray:
    """The group of each suffix, by its prefix and its whole path. ends: bytes of all words up to and with each."""
    n = len(h)
    begins = np.concatenate([[0], ends[:-1]])
    length = np.clip(np.searchsorted(ends, begins + PREFIX_BYTES) + 1 - np.arange(n), 1, window)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[:n])])
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE_INVERSE)])) if n else powers[:0]
    upto = lambda some: (sums[np.minimum(np.arange(n) + some, n)] - sums[:-1]) * back
    return (mixed(mixed(upto(length)) + upto(window)) % np.uint64(groups)).astype(np.int32)


def _branches(window: int, groups: int):
    def block(docs: list[tuple[int, list[bytes]]], hasher: Hasher) -> pd.DataFrame:
        docs.sort(key=lambda d: d[0])
        docs = [d for d in docs if len(d[1]) >= window]
        if not docs:
            return pd.DataFrame({c.split()[0]: [] for c in BRANCHES.split(", ")})
        h, offsets = joined(hasher.of(w) for _, w in docs)
        ends = np.cumsum(np.fromiter((len(x) for _, w in docs for x in w), np.int64, len(h)))
        doc = np.repeat(np.arange(len(docs)), np.diff(offsets))
        at = np.flatnonzero(np.arange(len(h)) + window <= offsets[1:][doc])
        names, group = path_names(h, window)[at], path_groups(h, ends, window, groups)[at]
        ids, starts = np.array([d[0] for d in docs], np.int64)[doc[at]], (at - offsets[:-1][doc[at]]).astype(np.int32)
        # Rows of one id are one document: equal starts in them are one place.
        order = np.lexsort((starts, ids, names)) if len(set(ids[np.concatenate([[True], np.diff(doc[at]) != 0])])) < len(np.unique(doc[at])) else np.argsort(names, kind="stable")
        same = np.concatenate([[False], np.diff(names[order]) == 0])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        twin = same & (ids[order] == ids[order][head]) & (starts[order] == starts[order][head])
        lead = np.zeros(len(at), bool)
        lead[order[~same]] = True
        again = np.zeros(len(at), bool)
        again[order[same & ~twin]] = True
        rows = []
        by = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[by])) + 1
        for part in np.split(by, cuts):
            a = part[lead[part]]
            if len(a):
                rows.append((int(group[a[0]]), names[a].tobytes(), _pack(ids[a], starts[a]), NOTHING))
        # What is settled in the block is dealt by the block, in groups below zero.
        b = np.flatnonzero(again)
        for part in np.split(b, np.arange(GROUP_WORDS, len(b), GROUP_WORDS)) if len(b) else []:
            rows.append((-1 - int(names[part[0]] % np.uint64(groups)), b"", NOTHING, _pack(ids[part], starts[part])))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in BRANCHES.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, held, size = Hasher(), [], 0
        for b in batches:
            for i, t in zip(b.doc_id, b.text, strict=True):
                held.append((NO_ID if pd.isna(i) else int(i), split(t)))
                size += len(held[-1][1])
                if size >= BLOCK_WORDS:
                    yield block(held, hasher)
                    held, size = [], 0
        if held:
            yield block(held, hasher)

    return run


def _repeats(shards: int):
    def subtree(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.names])
        firsts, again = [_unpack(x) for x in rows["first"]], [_unpack(x) for x in rows.again]
        ids, starts = (np.concatenate([f[k] for f in firsts]) for k in (0, 1))
        order = np.argsort(names)
        same = np.diff(names[order]) == 0
        edge = np.zeros(min(1, len(names)), bool)
        below = order[np.concatenate([same, edge]) | np.concatenate([edge, same])]  # suffixes below an internal node
        below = below[np.lexsort((starts[below], ids[below], names[below]))]
        later = np.concatenate([[False], np.diff(names[below]) == 0]) if len(below) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(later, 0, np.arange(len(below))))
        twin = (ids[below] == ids[below[head]]) & (starts[below] == starts[below[head]]) if len(below) else later
        gone = below[later & ~twin]
        ids, starts = np.concatenate([ids[gone], *(a[0] for a in again)]), np.concatenate([starts[gone], *(a[1] for a in again)])
        order = np.lexsort((starts, ids))
        ids, starts = ids[order], starts[order]
        shard = ((ids % SPREAD) % shards).astype(np.int32)
        return pd.DataFrame([(int(s), _pack(ids[shard == s], starts[shard == s])) for s in np.unique(shard)], columns=["shard", "spans"])

    return subtree


def _cover(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    edge = np.zeros(n + window + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:n] > 0


def _kept(window: int):
    def run(_: tuple, docs: pd.DataFrame, removed: pd.DataFrame) -> pd.DataFrame:
        found = [_unpack(x) for x in removed.spans]
        ids, starts = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(ids, kind="stable")
        ids, starts = ids[order], starts[order]
        out = []
        for i, t in zip(docs.doc_id, docs.text, strict=True):
            words, key = split(t), NO_ID if pd.isna(i) else int(i)
            a, b = np.searchsorted(ids, [key, key], side="left")[0], np.searchsorted(ids, key, side="right")
            own = starts[a:b]
            gone = _cover(own[own + window <= len(words)], len(words), window) if b > a else np.zeros(len(words), bool)
            kept = compress(words, ~gone) if b > a else words
            out.append((None if key == NO_ID else key, len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=[c.split()[0] for c in KEPT.split(", ")]).astype({"doc_id": "Int64"})

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept (the remaining words joined by one space).

    A word goes if it is covered by a window of `window` words whose sequence also starts earlier: in a smaller id, or
    earlier in the same document. Null texts have no words; a null id comes after all others. Rows that share an id are
    read as one document: windows at the same start count as one place; equal rows therefore do not repeat each other. Very
    long texts are taken whole. Ids are cast to long (an id that is no number raises). Other columns are not read. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, shards = max(parts, size // 6 // GROUP_WORDS), max(parts, size // SHARD_BYTES)
    branches = rows.mapInPandas(_branches(window, groups), BRANCHES)
    removed = branches.groupBy("group").applyInPandas(_repeats(shards), REMOVED)
    shard = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(int(NO_ID))), F.lit(SPREAD)), F.lit(shards)).cast("int").alias("shard")
    texts = rows.select(shard, "doc_id", "text")
    return texts.groupBy("shard").cogroup(removed.groupBy("shard")).applyInPandas(_kept(window), KEPT)
