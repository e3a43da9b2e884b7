"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of words, lower-cased and without punctuation at their edges. The CGK embedding walks over a window
with a random bit for each step and symbol that says whether to go on to the next word: windows at a small edit distance
soon walk in step, so that edit distance becomes Hamming distance. A hash table keys a window by a few sampled steps of
one walk; several walks and samples together reach the target recall. Windows have an item's size and lie where the
document shares one of the item's q-grams, q being small enough that any window within the edit bound shares one.
Candidates are verified by the exact edit distance between the item and the best substring around the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage
from .words import Hasher, joined, mixed, split

SIMILARITY, WALKS, SAMPLES, BITS, SEED = 0.8, 6, 12, 3, 11
ITEMS_PER_BLOCK, BATCH_WORDS, EXPANDED = 20_000, 200_000, 1_000_000
CANDIDATES = "doc_id long, text_hash long, item int, start int, region array<long>"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def bare(word: bytes) -> bytes:
    return word.strip(PUNCTUATION) or word


def bound(n: int, similarity: float) -> int:
    """The largest number of edits that an item of n words allows."""
    return int((1 - similarity) * n + 1e-9)


def _grams(h: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - q + 1), np.uint64)
    for k in range(q):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return out


def embed(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, walk: int, steps: np.ndarray) -> np.ndarray:
    """The symbols that the CGK walk sees at the given steps, a row for each window; zero past a window's end."""
    out = np.zeros((len(starts), len(steps)), np.uint64)
    want = {int(s): k for k, s in enumerate(steps)}
    at, end = starts.copy(), starts + sizes
    padded = np.concatenate([words, np.zeros(1, np.uint64)])
    for step in range(int(steps.max()) + 1):
        inside = at < end
        symbol = np.where(inside, padded[np.minimum(at, len(words))], np.uint64(0))
        if step in want:
            out[:, want[step]] = symbol
        go = mixed(symbol + np.uint64((walk << 32) + step * 2654435761)) >> np.uint64(63)
        at = at + (inside & (go == 1))
    return out


def _plan(size: int, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps to look at, and for each sample which of them make its key; steps lie within twice the window's size."""
    rng = np.random.default_rng([SEED, size, walk])
    picks = rng.integers(0, max(1, 2 * size), (SAMPLES, BITS))
    steps = np.unique(picks)
    return steps, np.searchsorted(steps, picks)


def keys(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A row for each window, a column for each walk and sample."""
    out = []
    for walk in range(WALKS):
        steps, picks = _plan(size, walk)
        seen = embed(words, starts, np.full(len(starts), size), walk, steps)
        for s, pick in enumerate(picks):
            key = np.full(len(starts), np.uint64(size << 16 | walk << 8 | s))
            for p in pick:
                key = mixed(key * np.uint64(31) + seen[:, p])
            out.append(key)
    return np.stack(out, axis=1)


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The least number of word edits between the item and any substring of the region, and where that substring ends."""
    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for n, word in enumerate(item, 1):
        up = np.minimum(row[1:] + 1, row[:-1] + (region != word))
        row = np.minimum.accumulate(np.concatenate([[n], up]) - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Items:
    """A block of items: word hashes, q-grams with their offsets, and the keys of each hash table."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float) -> None:
        hasher = Hasher(bare)
        words = [hasher.of(split(t, lower=True)) for _, t in rows]
        self.similarity = similarity
        self.ids = [i for i, _ in rows]
        self.words = words
        self.q = {}  # q -> sorted gram hashes, offsets, sizes of items
        by_q: dict[int, list] = {}
        for n, w in enumerate(words):
            if len(w):
                by_q.setdefault(min(4, max(1, len(w) // (bound(len(w), similarity) + 1))), []).append(n)
        for q, members in by_q.items():
            g, o = joined(_grams(words[n], q) for n in members)
            item = np.repeat(members, np.diff(o))
            offset = np.arange(len(g)) - np.repeat(o[:-1], np.diff(o))
            # Items of one size that have a gram at one offset ask for the same window.
            place = np.unique(np.stack([g.view(np.int64), offset, np.array([len(words[n]) for n in item], np.int64)], axis=1), axis=0)
            order = np.argsort(place[:, 0].view(np.uint64), kind="stable")
            self.q[q] = tuple(place[order].T.copy())
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.tables = {}  # size -> for each column sorted keys and the items that have them
        for size in np.unique(self.sizes[self.sizes > 0]):
            members = np.flatnonzero(self.sizes == size)
            k = keys(*self._flat(members), int(size))
            order = np.argsort(k, axis=0, kind="stable")
            self.tables[int(size)] = np.take_along_axis(k, order, axis=0), members[order]

    def _flat(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, o = joined(self.words[n] for n in members)
        return flat, o[:-1]

    def windows(self, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of windows that share a q-gram with an item at the item's own place."""
        starts, sizes = [], []
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for q, (grams, offset, size) in self.q.items():
            own = _grams(h, q)
            lo, hi = np.searchsorted(grams.view(np.uint64), own, "left"), np.searchsorted(grams.view(np.uint64), own, "right")
            hit = np.flatnonzero(hi > lo)
            hit = hit[doc[hit] == doc[hit + q - 1]] if len(hit) else hit
            every = hi[hit] - lo[hit]
            for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(np.cumsum(every) // EXPANDED)) + 1):
                some, n = hit[part], every[part]
                pick = np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(some, n)
                both = np.unique(np.stack([np.clip(at - offset[pick], offsets[:-1][doc[at]], None), size[pick]], axis=1), axis=0)
                starts.append(both[:, 0])
                sizes.append(both[:, 1])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(starts), np.concatenate(sizes)], axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def candidates(self, h: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, start) of windows that share a key with an item of their size."""
        starts, sizes = self.windows(h, offsets)
        ends = offsets[1:]
        found = []
        for size, (table, members) in self.tables.items():
            own = starts[sizes == size]
            if not len(own):
                continue
            doc = np.searchsorted(ends, own, "right")
            # A window that would pass the document's end stops there.
            k = self._keys_within(h, own, size, ends[doc])
            for c in range(k.shape[1]):
                lo, hi = np.searchsorted(table[:, c], k[:, c], "left"), np.searchsorted(table[:, c], k[:, c], "right")
                for w in np.flatnonzero(hi > lo):
                    found += [(int(doc[w]), int(m), int(own[w])) for m in members[lo[w] : hi[w], c]]
        return iter(sorted(set(found)))

    @staticmethod
    def _keys_within(h: np.ndarray, starts: np.ndarray, size: int, ends: np.ndarray) -> np.ndarray:
        short = starts + size > ends
        k = np.zeros((len(starts), WALKS * SAMPLES), np.uint64)
        if (~short).any():
            k[~short] = keys(h, starts[~short], size)
        for w in np.flatnonzero(short):
            k[w] = keys(h[starts[w] : ends[w]], np.zeros(1, np.int64), size)[0]
        return k


def _search(items: Items):
    def part(rows: pd.DataFrame, words: list[list[bytes]], hasher: Hasher) -> pd.DataFrame:
        h, offsets = joined(hasher.of(w) for w in words)
        out, seen = [], {}
        for doc, item, start in items.candidates(h, offsets):
            n = int(items.sizes[item])
            k = bound(n, items.similarity)
            if seen.get((doc, item), -(10**9)) + k >= start:
                continue  # its region covers this one too
            seen[doc, item] = start
            a, b = max(int(offsets[doc]), start - 2 * k), min(int(offsets[doc + 1]), start + n + 3 * k + 1)
            out.append((rows.doc_id.iloc[doc], rows.text_hash.iloc[doc], item, a - int(offsets[doc]), h[a:b].view(np.int64)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CANDIDATES.split(", ")]).astype({"doc_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(bare)
        for b in batches:
            words, start = [split(t, lower=True) for t in b.text], 0
            while start < len(b):
                stop, size = start, 0
                while stop < len(b) and (size == 0 or size < BATCH_WORDS):
                    size, stop = size + len(words[stop]) + 1, stop + 1
                yield part(b.iloc[start:stop], words[start:stop], hasher)
                start = stop

    return run


def _verify(items: Items):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, item, start, region in b.itertuples(index=False):
                words = items.words[item]
                edits, end = edit_distance(words, np.asarray(region, np.int64).view(np.uint64))
                if edits <= bound(len(words), items.similarity):
                    out.append((doc, text, items.ids[item], start + end, edits, 1 - edits / len(words)))
            yield pd.DataFrame(out, columns=["doc_id", "text_hash", "item_id", "end_word", "edits", "similarity"]).astype({"doc_id": "Int64"})

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and item that it holds: doc_id, text_hash, item_id, end_word, edits, similarity.

    A document holds an item of n words if a substring of its words is within (1 - similarity) * n word edits of it;
    the best place is returned (the earliest of equal ones). Null or empty texts and items hold and match nothing. Rows
    that share an id are told apart by text_hash; equal rows give one row. Very long texts are taken whole. Ids are cast to long (an
    id that is no number raises). Other columns are not read. An empty table on either side gives an empty result. Items go to tasks in blocks of at most ITEMS_PER_BLOCK, a pass each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    named = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, -(-named.count() // (ITEMS_PER_BLOCK // 2)))
    out = None
    for block in range(blocks):
        own = named.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = Items([(r.item_id, r.text) for r in own], similarity)
        found = stage(rows.mapInPandas(_search(items), CANDIDATES), "candidates")
        checked = found.repartition(*found.columns[:4]).mapInPandas(_verify(items), "doc_id long, text_hash long, item_id long, end_word int, edits int, similarity double")
        out = checked if out is None else out.unionByName(checked)
    best = out.groupBy("doc_id", "text_hash", "item_id").agg(F.min(F.struct("edits", "end_word", "similarity")).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", "best.end_word", "best.edits", "best.similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns.

    Rows are told apart by id and text, so that repeated rows stay or go together; null ids, null, empty and very long texts
    and empty tables are treated as in `leaks`.
    """
    own_hash, bad_id, bad_hash = fresh(docs, "text_hash", "bad_id", "bad_hash")
    bad = stage(leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct(), "leaks")
    own = docs.withColumn(own_hash, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return own.join(bad, own[id_col].eqNullSafe(bad[bad_id]) & (own[own_hash] == bad[bad_hash]), "left_anti").select(*docs.columns)
