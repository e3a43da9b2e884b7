"""Hashed maximum-entropy language model with a class-factored softmax.

p(word | context) = p(class | context) * p(word | class, class before). The first factor is a softmax over classes whose
logits sum the weights of hashed features: the word before, the pair of words before (n-grams), and the words two and
three before (skips). The second is a softmax over the class's words with one feature for each pair of the previous class
and the word; such indicator features have their optimum in closed form, from counts. Words outside the head vocabulary
form one class and follow their smoothed counts, an unseen word included, so probabilities over all words sum to one.

Counts are summed by Spark. Weights are trained by rounds of distributed updates: each task starts from the model so far,
takes AdaGrad steps over its own documents and sends what changed; Spark averages the changes of each row of weights by
how often a task used it, and shrinks rows that were seldom used. Sums of tasks meet in a tree. A round reads one of ROUNDS shares of
the documents, dealt by a hash of the text, so that training is one pass; as a task steps over its own documents, weights
depend a little on how the documents are partitioned. The numbers of slots and of head words double with every sixteenfold
number of tokens beyond GROWTH_TOKENS; the driver holds the weights, which so grow with the fourth root of the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, most_frequent, remainder, stage
from .words import split

END = b"\n"  # no word holds a line break
FOLDS, HELD_OUT = 5, 1
DICTIONARY, HEAD, ANCHORS, CLUSTERS, CLASSES = 300_000, 16_384, 64, 8, 24
SLOTS, TAIL_BUCKETS, PARTS, ROUNDS, FAN = 1 << 15, 4096, 16, 2, 64
GROWTH_TOKENS = 1 << 28
BATCH, READ_WORDS, COUNT_WORDS = 16_384, 150_000, 200_000
RATE, SMOOTH, SHRINK, MIN_COUNT = 0.4, 20.0, 2.0, 5
SCORES = "doc_id long, n_tokens long, n_known long, base double, score double, tail array<binary>"


def held_out(id_col: Column) -> Column:
    return remainder(id_col, FOLDS) == HELD_OUT


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words (A-Z alone), then one end."""
    return [*split(text, lower=True), END]


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all tokens of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.text:
                seen.update(tokens(t))
                if len(seen) > COUNT_WORDS:
                    yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                    seen = Counter()
        yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    return docs.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """Ranks of the dictionary's words; any other word gets one of the buckets after them."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(words))
        self.size = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.size + xxhash.xxh3_64_intdigest(word) % TAIL_BUCKETS

    def __reduce__(self):
        return Vocabulary, (list(self.keys()),)

    def ranks(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all words, and each word's place in its document."""
        flat = np.fromiter(map(self.__getitem__, chain.from_iterable(docs)), np.int32, sum(map(len, docs)))
        return flat, np.concatenate([np.arange(len(d), dtype=np.int32) for d in docs]) if docs else flat

    def symbols(self, ranks: np.ndarray, head: int) -> np.ndarray:
        """What contexts see: head words as they are, others by bucket."""
        tail = head + np.where(ranks >= self.size, ranks - self.size, ranks % TAIL_BUCKETS)
        return np.where(ranks < head, ranks, tail).astype(np.int32)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[list[bytes]]]]:
    """Documents in groups of READ_WORDS words or one document."""
    for b in batches:
        start, size, docs = 0, 0, []
        for i, t in enumerate(b.text):
            docs.append(tokens(t))
            size += len(docs[-1])
            if size >= READ_WORDS or i + 1 == len(b):
                yield b.iloc[start : i + 1], docs
                start, size, docs = i + 1, 0, []


def _earlier(symbols: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The symbol k before, -1 at a document's start."""
    out = np.full(len(symbols), -1, np.int64)
    out[k:] = np.where(place[k:] >= k, symbols[:-k], -1) if len(symbols) > k else out[k:]
    return out


def features(symbols: np.ndarray, place: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Four of the slots for each token: the word before, the pair before, the words two and three before."""
    one, two, three = (_earlier(symbols, place, k) for k in (1, 2, 3))
    mixed = np.stack([one * 4 + 1, (one * 1_000_003 + two) * 4 + 2, two * 4 + 3, three * 4], axis=1).view(np.uint64)
    mixed += np.uint64(0x9E3779B97F4A7C15)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed >>= np.uint64(40)
    mixed &= np.uint64(slots - 1)  # slots are a power of two
    return mixed.view(np.int64)


@dataclass
class Model:
    vocabulary: Vocabulary
    counts: np.ndarray  # of the dictionary's words
    total: int
    distinct: int
    head: int
    classes: np.ndarray  # of head words; the last class is all other words
    n_classes: int
    weights: np.ndarray
    bias: np.ndarray
    inner: np.ndarray | None = None  # log p(word | class, class before)

    def of_class(self, ranks: np.ndarray) -> np.ndarray:
        return np.where(ranks < self.head, self.classes[np.minimum(ranks, self.head - 1)], self.n_classes - 1)

    def logits(self, slots: np.ndarray) -> np.ndarray:
        """Logits of all classes, the largest being 0."""
        out = self.weights.take(slots[:, 0], axis=0)
        out += self.bias
        for k in range(1, slots.shape[1]):  # one table of tokens at a time stays in the processor's cache
            out += self.weights.take(slots[:, k], axis=0)
        out -= out.max(axis=1, keepdims=True)
        return out

    def shares(self, slots: np.ndarray) -> np.ndarray:
        """p(class | context) of all classes."""
        out = self.logits(slots)
        np.exp(out, out=out)
        out /= out @ np.ones((self.n_classes, 1), out.dtype)
        return out

    def log_classes(self, slots: np.ndarray) -> np.ndarray:
        out = self.logits(slots)
        out -= np.log(np.exp(out).sum(axis=1, keepdims=True))
        return out

    def log_class(self, slots: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(class | context) of one class for each context."""
        out = self.logits(slots)
        own = out[np.arange(len(out)), target]
        np.exp(out, out=out)
        return own - np.log(out @ np.ones(self.n_classes, out.dtype))

    @property
    def tail(self) -> tuple[float, float]:
        """Tokens outside the head, and what their smoothed counts are divided by."""
        n = self.total - int(self.counts[: self.head].sum())
        return n, n + 0.5 * (self.distinct - self.head + 1)


def _packed(x: np.ndarray, kind: type) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x, kind).tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _met(frame: DataFrame, kinds: dict[str, type]) -> list:
    """The sum of what tasks send, a row for each part: up to FAN tasks meet in a group, their sums likewise, until one is left.

    frame: part, and for each of `kinds` a packed array of fixed size. As many levels as tasks need and no more: FAN tasks take one.
    """

    def add(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"part": rows.part.iloc[:1], "task": rows.task.iloc[:1] // FAN}
        for name, kind in kinds.items():
            into = np.float64 if kind == np.float32 else kind
            total = _unpacked(rows[name].iloc[0], kind).astype(into)
            for x in rows[name].iloc[1:]:
                total += _unpacked(x, kind)
            out[name] = [_packed(total, kind)]
        return pd.DataFrame(out)

    own = stage(frame.withColumn("task", F.spark_partition_id()), "sent")
    most = own.agg(F.max("task")).first()[0] or 0
    while True:
        sums = stage(own.groupBy("part", F.floor(F.col("task") / FAN)).applyInPandas(add, own.schema), "sums")
        discard(own)
        own = sums
        if most < FAN:
            break
        most //= FAN
    rows = sorted(own.collect(), key=lambda r: r.part)  # PARTS rows at most
    discard(own)
    return rows


def _summed(frame: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of one matrix of fixed size from each task, packed in rows of `part`."""
    rows = _met(frame, {"data": np.int64})
    return np.concatenate([_unpacked(r.data, np.int64) for r in rows]).reshape(shape) if rows else np.zeros(shape, np.int64)


def _parts(matrix: np.ndarray, kind: type) -> list[bytes]:
    return [_packed(p, kind) for p in np.array_split(matrix, PARTS)]


def cooccurrences(docs: DataFrame, vocabulary: Vocabulary, head: int) -> np.ndarray:
    """How often each head word stands within two words after or before one of the most frequent words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, any_doc = np.zeros(head * ANCHORS, np.int64), False
        for _, words in _groups(batches):
            any_doc = True
            ranks, place = shared.value.ranks(words)
            cells = []
            for k in (1, 2):
                before = _earlier(ranks, place, k)
                for a, w in ((before, ranks), (ranks, before)):
                    near = np.flatnonzero((a >= 0) & (a < ANCHORS))
                    a, w = a[near], w[near]
                    ok = (w >= 0) & (w < head)
                    cells.append(w[ok].astype(np.int64) * ANCHORS + a[ok])
            total += np.bincount(np.concatenate(cells), minlength=head * ANCHORS)
        if any_doc:
            yield pd.DataFrame({"part": range(PARTS), "data": _parts(total, np.int64)})

    return _summed(docs.select("text").mapInPandas(run, "part int, data binary"), (head, ANCHORS))


def word_classes(near: np.ndarray, counts: np.ndarray, classes: int) -> np.ndarray:
    """Classes of equal mass within clusters of words that keep the same company."""
    x = np.sqrt((near + 0.1) / (near + 0.1).sum(axis=0, keepdims=True))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(7)
    k = min(CLUSTERS, len(x))
    centres = x[rng.choice(min(len(x), 2000), k, replace=False)]
    for _ in range(25):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(k):
            if (own == c).any():
                centres[c] = (x * counts[:, None])[own == c].sum(axis=0)
                centres[c] /= max(np.linalg.norm(centres[c]), 1e-12)
    order = np.lexsort((-counts, own))
    mass = np.cumsum(counts[order]) - counts[order] / 2
    out = np.empty(len(x), np.int32)
    out[order] = np.minimum((mass / max(1, counts.sum()) * classes).astype(np.int32), classes - 1)
    return out


def _steps(model: Model, slots: np.ndarray, target: np.ndarray, squares: np.ndarray, used: np.ndarray) -> None:
    """One AdaGrad step on a batch."""
    p = model.shares(slots)
    p[np.arange(len(p)), target] -= 1
    model.bias -= RATE * p.mean(axis=0)
    flat = slots.ravel()
    order = np.argsort(flat.astype(np.uint16) if len(model.weights) <= 1 << 16 else flat, kind="stable")  # numpy sorts 16 bits by radix
    ordered = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rows = ordered[first]
    gradient = np.add.reduceat(p.take(order // slots.shape[1], axis=0), first, axis=0)
    used[rows] += np.diff(np.append(first, len(ordered)))
    squares[rows] += (gradient**2).sum(axis=1)
    model.weights[rows] -= RATE / np.sqrt(squares[rows] + 1.0)[:, None] * gradient


def _train_round(docs: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes of weights (averaged by use), of biases, and counts of (class before, word)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n, head = model.n_classes, model.head

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        own = Model(m.vocabulary, m.counts, m.total, m.distinct, head, m.classes, n, m.weights.copy(), m.bias.copy())
        squares, used, pairs, seen = np.zeros(len(m.weights), np.float32), np.zeros(len(m.weights), np.float32), np.zeros(n * head, np.int64), 0
        for _, words in _groups(batches):
            ranks, place = own.vocabulary.ranks(words)
            slots, target = features(own.vocabulary.symbols(ranks, head), place, len(own.weights)), own.of_class(ranks)
            for at in range(0, len(ranks), BATCH):
                _steps(own, slots[at : at + BATCH], target[at : at + BATCH], squares, used)
            before = _earlier(target, place, 1)
            before[before < 0] = n - 1
            inside = ranks < head
            pairs += np.bincount(before[inside] * head + ranks[inside], minlength=n * head)
            seen += len(ranks)
        if seen:
            change = (own.weights - m.weights) * used[:, None]
            yield pd.DataFrame({
                "part": range(PARTS), "change": _parts(change, np.float32), "used": _parts(used, np.float32),
                "pairs": _parts(pairs, np.int64), "bias": _parts(np.append((own.bias - m.bias) * seen, seen), np.float64),
            })

    kinds = {"change": np.float32, "used": np.float32, "pairs": np.int64, "bias": np.float64}
    rows = _met(docs.select("text").mapInPandas(run, "part int, change binary, used binary, pairs binary, bias binary"), kinds)
    shared.unpersist()
    if not rows:
        return np.zeros_like(model.weights), np.zeros_like(model.bias), np.zeros((n, head), np.int64)
    change, used, pairs, bias = (np.concatenate([_unpacked(r[k], kind) for r in rows]) for k, kind in kinds.items())
    change = change.reshape(model.weights.shape) / (used + SHRINK)[:, None]
    return change, bias[:-1] / bias[-1], pairs.reshape(n, head)


def _inner(pairs: np.ndarray, counts: np.ndarray, classes: np.ndarray, n: int) -> np.ndarray:
    """log p(word | class, class before): counts of pairs, drawn to the word's share of its class."""
    mass = np.bincount(classes, weights=counts + 0.5, minlength=n)
    share = (counts + 0.5) / mass[classes]
    total = np.stack([np.bincount(classes, weights=row, minlength=n) for row in pairs])
    return np.log((pairs + SMOOTH * share) / (total[:, classes] + SMOOTH)).astype(np.float32)


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of docs (text), and the counts of its words."""
    counts = stage(count_words(docs), "word-counts")
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    most = most_frequent(counts, "n", DICTIONARY).toPandas().sort_values(["n", "word"], ascending=[False, True])  # at most DICTIONARY words
    vocabulary = Vocabulary([bytes(w) for w in most.word] or [END])
    known = most.n.to_numpy(np.int64) if len(most) else np.zeros(1, np.int64)
    # Rare words stay in the last class, which so learns where words come that training has not seen.
    larger = 1 << int(np.ceil(max(0.0, np.log2(max(1, total or 0) / GROWTH_TOKENS)) / 4))
    head, n = max(1, min(HEAD * larger, int((known >= MIN_COUNT).sum()))), CLASSES
    classes = word_classes(cooccurrences(docs, vocabulary, head), known[:head].astype(float), n - 1)
    weights = np.zeros((SLOTS * larger, n), np.float32)
    model = Model(vocabulary, known, int(total or 0), int(distinct), head, classes, n, weights, np.zeros(n, np.float32))
    pairs = np.zeros((n, head), np.int64)
    for r in range(ROUNDS):
        part = docs.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == r) if ROUNDS > 1 else docs
        change, bias, more = _train_round(part, model)
        model.weights, model.bias, pairs = model.weights + change, (model.bias + bias).astype(np.float32), pairs + more
    model.inner = _inner(pairs, known[:head], classes, n)
    return model, counts


def _tails(docs: list[list[bytes]], ranks: np.ndarray, starts: np.ndarray, size: int) -> list[list[bytes]]:
    """The words of each document that are beyond the dictionary."""
    out: list[list[bytes]] = [[] for _ in docs]
    at = np.flatnonzero(ranks >= size)
    own = np.searchsorted(starts, at, side="right") - 1
    for d, i in zip(own.tolist(), (at - starts[own]).tolist(), strict=True):
        out[d].append(docs[d][i])
    return out


def _scored(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = shared.value
        log10 = np.log(10)
        rest = np.log(m.total + 0.5 * (m.distinct + 1))
        tail_total = np.log(m.tail[1])
        of_word = np.log(m.counts + 0.5)
        for rows, words in _groups(batches):
            ranks, place = m.vocabulary.ranks(words)
            target = m.of_class(ranks)
            slots = features(m.vocabulary.symbols(ranks, m.head), place, len(m.weights))
            score = np.empty(len(ranks))
            for at in range(0, len(ranks), BATCH):
                part = slice(at, at + BATCH)
                score[part] = m.log_class(slots[part], target[part])
            before = _earlier(target, place, 1)
            before[before < 0] = m.n_classes - 1
            known = ranks < m.vocabulary.size
            own = of_word[np.minimum(ranks, m.vocabulary.size - 1)]
            inside = ranks < m.head
            score += np.where(inside, m.inner[before, np.minimum(ranks, m.head - 1)], np.where(known, own, 0.0) - tail_total)
            base = np.where(known, own, 0.0) - rest
            starts = np.flatnonzero(place == 0)
            yield pd.DataFrame({
                "doc_id": rows.doc_id, "n_tokens": np.diff(np.append(starts, len(ranks))), "n_known": np.add.reduceat(known.astype(np.int64), starts),
                "base": np.add.reduceat(base, starts) / log10, "score": np.add.reduceat(score, starts) / log10, "tail": _tails(words, ranks, starts, m.vocabulary.size),
            })

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_known, base_score, score (log10 probabilities of the text).

    Words beyond the dictionary, the rare ones, find their counts by a join. Null texts are one end token.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_scored(shared), SCORES)
    rows = stage(rows.withColumn("row_key", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row_key", F.explode("tail").alias("word")).join(counts, "word", "left")
    # Both sums hold log10(c + 0.5): divisors were taken in the tasks.
    rare = rare.groupBy("row_key").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count("n").alias("found"))
    out = rows.drop("tail").join(rare, "row_key", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def score_held_out(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Ids are cast to long before they are dealt to folds, so that "007" and 7 fall on one side. A null id counts as training text; rows
    that share an id are scored each. Null and empty texts are one end token; very long texts are taken whole, in groups of
    their own. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model, counts = train(rows.filter(~held_out(F.col("doc_id"))))
    out = score(rows, model, counts)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
