"""Grouping of spelling variants: words one edit apart, found by automata over tries.

The vocabulary is counted by Spark, sorted by ranges and cut into shards, each a trie in a few flat arrays of bounded size.
Shards are broadcast in groups of bounded size, a pass over the vocabulary each. In a pass, every word's distance-one
Levenshtein automaton runs through each shard depth-first: states (word, trie node, place in the word, edits) lie on a
stack in batches of many words, the newest batch is stepped to all children at once, and what stands on an accepting node with
one edit is a neighbour. A word leaves a task as one row at most for each pass: how many neighbours it has there and the
best of them; these are reduced by word.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, scratch_path, stage

RUN = r"[A-Za-zÀ-ÿ]+"
NOISE, MIN_CHARS, MIN_COUNT, RATIO = 97, 5, 3, 2
#: A shard takes words until it has so many code points; shards of so many bytes go out in one broadcast.
SHARD_CHARS, PASS_BYTES = 1_000_000, 24_000_000
#: Words whose automata run together, and states that are stepped at once.
BATCH_WORDS, BATCH_STATES = 2048, 200_000
CODE_BITS = 21


def varied(id_col: Column, run: Column, noise: int = NOISE) -> Column:
    """The run without one code point where `noise` divides the crc32 of id and run; a null id counts as the empty text."""
    h = F.crc32(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % noise == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of at least `min_chars` code points that occur at least `min_count` times."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    # A deletion makes a run no longer, so short ones can go at once.
    runs = runs.filter(F.char_length("run") >= min_chars)
    ascii_only = F.octet_length("run") == F.char_length("run")
    lowered = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    told = lowered.select(varied(F.col("id"), F.col("run"), noise).alias("word")).filter(F.char_length("word") >= min_chars)
    return told.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words in a row, and where each word starts."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


class Trie:
    """A shard: edges sorted by (parent, label), so that a node's children lie together and one is found by bisection.

    Node 0 is the root; edge k leads to node k + 1. `word` is a node's word, or -1.
    """

    def __init__(self, words: list[str], counts: list[int]) -> None:
        flat, starts = code_points(words)
        lengths = np.diff(starts)
        node, keys, ends = np.zeros(len(words), np.int64), [], {}
        total = 1
        for depth in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > depth)
            found, at = np.unique((node[live] << CODE_BITS) | flat[starts[live] + depth], return_inverse=True)
            keys.append(found)
            node[live] = total + at
            total += len(found)
            done = live[lengths[live] == depth + 1]
            ends.update(zip(node[done].tolist(), done.tolist(), strict=True))
        # Levels are numbered one after the other and parents rise within a level: all keys are sorted as they come.
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.keys, np.arange(total + 1, dtype=np.int64) << CODE_BITS).astype(np.int32)
        self.word = np.full(total, -1, np.int32)
        self.word[list(ends)] = list(ends.values())
        self.words, self.n = words, np.array(counts, np.int64)

    def child(self, node: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The child of each node by its label; -1 where there is none."""
        key = (node << CODE_BITS) | label
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == key, at + 1, -1) if len(self.keys) else np.full(len(node), -1)

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes and which child, for all children of all nodes."""
        lo, size = self.first[node].astype(np.int64), (self.first[node + 1] - self.first[node]).astype(np.int64)
        of = np.repeat(np.arange(len(node)), size)
        return of, lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + 1


def neighbours(trie: Trie, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in words, word of the trie) exactly one insertion, deletion or replacement apart, each once."""
    flat, starts = code_points(words)
    length = np.diff(starts)
    flat = np.append(flat, -1)  # what is read past the last word
    found = []
    # A state: word, node, place in the word. Stacks hold batches without an edit and with one.
    zero = np.zeros(len(words), np.int64)
    stack = [(0, np.arange(len(words)), zero, zero)]
    while stack:
        edits, w, node, at = stack.pop()
        if len(w) > BATCH_STATES:
            half = len(w) // 2
            stack += [(edits, w[:half], node[:half], at[:half]), (edits, w[half:], node[half:], at[half:])]
            continue
        left = length[w] - at
        if edits:
            ends = (left == 0) & (trie.word[node] >= 0)
            found.append(np.stack([w[ends], trie.word[node[ends]]]))
            on = left > 0
            w, node, at = w[on], node[on], at[on]
            to = trie.child(node, flat[starts[w] + at])
            on = to >= 0
            if on.any():
                stack.append((1, w[on], to[on], at[on] + 1))
            continue
        last = (left == 1) & (trie.word[node] >= 0)  # the last code point deleted
        found.append(np.stack([w[last], trie.word[node[last]]]))
        of, to = trie.children(node)
        label = trie.keys[to - 1] & ((1 << CODE_BITS) - 1)
        fits = (left[of] > 0) & (label == flat[starts[w[of]] + np.minimum(at[of], length[w[of]])])
        swap = (left[of] > 0) & ~fits
        skip = left[of] > 1
        skip &= label == flat[np.minimum(starts[w[of]] + at[of] + 1, len(flat) - 1)]
        one = [(of, to, at[of]), (of[swap], to[swap], at[of[swap]] + 1), (of[skip], to[skip], at[of[skip]] + 2)]
        stack.append((1, *(np.concatenate(x) for x in ([w[o] for o, _, _ in one], [t for _, t, _ in one], [a for _, _, a in one]))))
        if fits.any():
            stack.append((0, w[of[fits]], to[fits], at[of[fits]] + 1))
    who, word = np.concatenate(found, axis=1)
    pairs = np.unique(who * max(1, len(trie.words)) + word)
    return np.divmod(pairs, max(1, len(trie.words)))


def _shards(chars: int):
    def pack(words: list[str], counts: list[int]) -> pd.DataFrame:
        data = zlib.compress(pickle.dumps(Trie(words, counts)), 1)
        return pd.DataFrame({"first": [words[0]], "size": [len(data)], "trie": [data]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, counts, size = [], [], 0
        for b in batches:
            for word, n in zip(b.word, b.n, strict=True):
                words.append(word)
                counts.append(n)
                size += len(word)
                if size >= chars:
                    yield pack(words, counts)
                    words, counts, size = [], [], 0
        if words:
            yield pack(words, counts)

    return run


def shards(words: DataFrame, chars: int = SHARD_CHARS) -> DataFrame:
    """first, size, trie: tries of consecutive words, each of about `chars` code points or of one longer word."""
    return stage(words.sort("word").mapInPandas(_shards(chars), "first string, size long, trie binary"), "tries")


def _passes(tries: DataFrame, most: int) -> Iterator[list[bytes]]:
    """Groups of shards of at most `most` bytes, or of one larger shard, one after the other."""
    group, size = [], 0
    for r in tries.select("first", "size").orderBy("first").collect():  # a row of a few bytes for each shard
        if group and size + r.size > most:
            yield group
            group, size = [], 0
        group.append(r.first)
        size += r.size
    if group:
        yield group


def _intersect(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = [pickle.loads(zlib.decompress(x)) for x in held.value]
        for b in batches:
            for start in range(0, len(b), BATCH_WORDS):
                own = b.word.iloc[start : start + BATCH_WORDS].tolist()
                near, best = np.zeros(len(own), np.int64), [None] * len(own)
                for t in tries:
                    who, word = neighbours(t, own)
                    np.add.at(near, who, 1)
                    for i, k in zip(who.tolist(), word.tolist(), strict=True):
                        n, w = int(t.n[k]), t.words[k]
                        if best[i] is None or (-n, w) < (-best[i][0], best[i][1]):
                            best[i] = (n, w)
                at = [i for i, x in enumerate(best) if x]
                if at:
                    yield pd.DataFrame({"word": [own[i] for i in at], "n_near": near[at], "best_n": [best[i][0] for i in at], "best": [best[i][1] for i in at]})

    return run


def near_words(words: DataFrame, chars: int = SHARD_CHARS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """word, n_near, best, best_n for each word that has words one edit away. words: word, n, distinct and staged.

    best is the neighbour of largest n, of equals the smallest in code-point order. A pass over the words serves a group of
    shards; there are as many passes as the tries have blocks of `pass_bytes`, and each is written before the next.
    """
    spark = words.sparkSession
    tries, path, kind = shards(words, chars), scratch_path(spark, "near"), "word string, n_near long, best_n long, best string"
    spark.createDataFrame([], kind).write.parquet(path)
    for group in _passes(tries, pass_bytes):
        data = [bytes(r.trie) for r in tries.filter(F.col("first").isin(group)).select("trie").collect()]
        held = spark.sparkContext.broadcast(data)  # at most pass_bytes, or one shard
        # Words one edit apart lie together when sorted: dealt by hash, tasks have alike shares of them.
        words.select("word").repartition("word").mapInPandas(_intersect(held), kind).write.mode("append").parquet(path)
        held.unpersist()
    discard(tries)
    found = spark.read.schema(kind).parquet(path)
    best = F.min(F.struct((-F.col("best_n")).alias("order"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.order")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that is reached by following forms. forms: word, form; a chain never returns.

    Pointers double in each round. A word's count at least doubles from one form to the next, so that a chain has no more
    links than a count has bits and rounds are few.
    """
    at = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(at)
        at = now.drop("moved")
        if now.filter("moved").isEmpty():
            return at


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT, ratio: int = RATIO, shard_chars: int = SHARD_CHARS, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """One row for each word: word, n, form, form_n, n_near, root.

    form is the word's most frequent neighbour, of equals the smallest in code-point order, if that occurs at least `ratio` (2
    or more) times as often, else null; root is the last word on the way of forms, the word itself where it has none.
    Null and empty texts have no words; very long texts and words are taken whole; rows that repeat count each; a null id
    counts as the empty text. Other columns are not read. A table without words gives an empty result.
    """
    words = stage(vocabulary(docs, id_col, text_col, noise, min_chars, min_count), "vocabulary")
    near = near_words(words, shard_chars, pass_bytes)
    chosen = F.col("best_n") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).alias("n_near")
    )
    told = stage(told, "forms")
    ends = roots(told.filter("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
