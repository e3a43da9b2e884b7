"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A word is folded by `Bpe.fold`: an array holds one number for each token, the rank of the pair that it makes with the token
after it above the token's own id. The least number names the leftmost pair of least rank; it and the number before it are
replaced, until no pair has a rank. Ranks are a literal of pairs of ids: an array of small maps, dealt by the pair, since a
map is searched from end to end. Literals are scalar subqueries over tables of one row, so no plan spells them out.

Words are counted over all documents. The most frequent distinct ones, at most `dictionary_words`, are folded once each and
their ids become another literal of bounded size; a word beyond it is folded where it stands, since to join it back the
ids of all documents would have to be shuffled. Each step of the fold copies the array, so a word of more than LONG
bytes is folded in a Python task instead, with a heap. Decoding looks each id up in a literal array of binary pieces and
concatenates them.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, most_frequent, stage

DICTIONARY_WORDS, LONG = 600_000, 256
#: Ids take the low bits of a number; EDGE is the id of what stands before and after a word.
ID_BITS = 20
EDGE = (1 << ID_BITS) - 1
NO_RANK = EDGE


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The pair of ids that each token is merged from, and its rank.

    A token's pair is what is left of its bytes once all merges of lower rank are done. Where every token has such a pair, no
    other pair can come to be merged. Other vocabularies are refused, and so is one without all single bytes.
    """
    if any(bytes([b]) not in ranks for b in range(256)) or max(ranks.values()) >= EDGE:
        raise ValueError("the vocabulary needs all single bytes and ids below 2**20 - 1")
    found = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            least, i = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if least >= rank:
                raise ValueError(f"token {token!r} is not merged from two tokens of lower rank")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            found[ranks[parts[0]], ranks[parts[1]]] = rank
    return found


def fold_long(word: bytes, byte_ids: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    """The ids of one word of any length: pairs wait in a heap by rank, then place."""
    ids, n = [byte_ids[b] for b in word], len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(merges[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merges]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j >= n or ids[i] < 0 or merges.get((ids[i], ids[j])) != rank:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (new := merges.get((rank, ids[after[i]]))) is not None:
                heapq.heappush(heap, (new, i))
        if before[i] >= 0 and (new := merges.get((ids[before[i]], rank))) is not None:
            heapq.heappush(heap, (new, before[i]))
    return [i for i in ids if i >= 0]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


class Lookup:
    """A literal from keys to values: an array of maps, a key's place among them being `place`.

    The literal is a column `literal` of the rows at work, a scalar subquery; `bound` names it once for a whole expression.
    """

    def __init__(self, table: DataFrame, n: int) -> None:
        self.literal, self.n, self.maps = table.select("maps").scalar(), n, None

    def bound(self, column: str, use: Callable[[], Column]) -> Column:
        def name(maps: Column) -> Column:
            self.maps = maps
            try:
                return use()
            finally:
                self.maps = None

        return _let(F.col(column), name)

    def get(self, key: Column, place: Column) -> Column:
        return F.try_element_at(F.get(self.maps, place), key)


def _word_place(word: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(n)).cast("int")


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        self.merges = merge_table(ranks)
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.bytes = F.split(F.lit(",".join(map(str, self.byte_ids))), ",").cast("array<bigint>")
        by_id = {v: k for k, v in ranks.items()}
        each = range(max(by_id) + 1)
        self.pieces = F.split(F.lit(",".join(by_id.get(i, b"").hex() for i in each)), ",", -1)
        self.little_endian = F.split(F.lit(",".join(i.to_bytes(4, "little").hex() for i in each)), ",", -1)
        self.app, self.rank = "", None

    def _ranks(self, spark: SparkSession) -> Lookup:
        """Ranks of pairs, written once in an application."""
        if self.app != spark.sparkContext.applicationId:
            dealt: list[dict[int, int]] = [{} for _ in range(len(self.merges) | 1)]
            for (a, b), rank in self.merges.items():
                key = a << ID_BITS | b
                dealt[key % len(dealt)][key] = rank
            table = stage(spark.createDataFrame([(dealt,)], "maps array<map<bigint,bigint>>"), "bpe-ranks")
            self.app, self.rank = spark.sparkContext.applicationId, Lookup(table, len(dealt))
        return self.rank

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + self.pattern), F.lit(0))

    def _number(self, pair: Column) -> Column:
        """What stands for the first token of a pair of ids: the pair's rank above the id."""
        rank = F.coalesce(self.rank.get(pair, (pair % self.rank.n).cast("int")), F.lit(NO_RANK).cast("bigint"))
        return F.shiftleft(rank, ID_BITS).bitwiseOR(F.shiftright(pair, ID_BITS))

    def fold(self, word: Column) -> Column:
        """The ids of one word: pairs are merged by rank, leftmost first."""
        edge = F.lit(EDGE).cast("bigint")
        pair = lambda a, b: F.shiftleft(a, ID_BITS).bitwiseOR(b)
        own = lambda s, i: F.get(s, i).bitwiseAND(edge)
        chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        ids = F.concat(F.array(edge), F.transform(chars, lambda c: F.get(self.bytes, F.ascii(c))), F.array(edge))
        start = _let(ids, lambda p: F.transform(p, lambda a, i: self._number(pair(a, F.coalesce(F.get(p, i + 1), edge)))))

        def merge(s: Column, least: Column, at: Column) -> Column:
            # `at` counts from one, so it is also the place, from zero, of the pair's second token.
            new = F.shiftright(least, ID_BITS)
            pairs = F.array(pair(own(s, at - 2), new), pair(new, own(s, at + 1)))
            return F.concat(F.slice(s, F.lit(1), at - 2), F.transform(pairs, self._number), F.slice(s, at + 2, F.size(s)))

        none = F.shiftleft(F.lit(NO_RANK).cast("bigint"), ID_BITS)
        place = lambda s, least: _let(F.array_position(s, least).cast("int"), lambda at: merge(s, least, at))
        step = lambda s, _: _let(F.array_min(s), lambda least: F.when(least >= none, s).otherwise(place(s, least)))
        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(word) - 1))
        return F.aggregate(steps, start, step, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(edge).cast("int")))

    def folded(self, words: DataFrame) -> DataFrame:
        """words (word) with the ids of each, for words of up to LONG bytes."""
        rank = self._ranks(words.sparkSession)
        return words.withColumn("maps", rank.literal).withColumn("ids", rank.bound("maps", lambda: self.fold(F.col("word")))).drop("maps")

    def dictionary(self, docs: DataFrame, text_col: str, size: int) -> Lookup | None:
        """Ids of the most frequent words, at most `size`; counts cover every document."""
        if size <= 0:
            return None
        short = F.filter(self.words(F.col(text_col)), lambda w: F.octet_length(w) <= LONG)
        words = stage(docs.select(F.explode(short).alias("word")).groupBy("word").count(), "bpe-words")
        rows = stage(most_frequent(words, "count", size), "bpe-frequent")
        discard(words)
        n = max(1, rows.count() // 2)
        folded = self.folded(rows.repartition("word")).select("word", "ids")
        packed = folded.groupBy(_word_place(F.col("word"), n).cast("long").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("word", "ids"))).alias("map"))
        placed = docs.sparkSession.range(n).join(packed, "id", "left").select(F.struct("id", F.coalesce("map", F.create_map().cast("map<string,array<int>>")).alias("map")).alias("x"))
        # One row of at most `size` words, which is what bounds the literal.
        by_place = F.array_sort(F.collect_list("x"), lambda a, b: (a["id"] - b["id"]).cast("int"))
        return Lookup(stage(placed.agg(F.transform(by_place, lambda x: x["map"]).alias("maps")), "bpe-dictionary"), n)

    def _long_words(self, spark: SparkSession) -> Callable[[Column], Column]:
        shared = spark.sparkContext.broadcast((self.byte_ids, self.merges))

        @F.pandas_udf("array<array<int>>")
        def fold_all(words: pd.Series) -> pd.Series:
            return words.map(lambda own: [fold_long(w.encode("utf-8", "surrogatepass"), *shared.value) for w in own])

        return fold_all

    def encode(self, docs: DataFrame, text_col: str = "text", into: str = "ids", dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
        """docs with a column of ids, in the order of the text.

        Null and empty texts have no ids. Texts are taken whole, words of any length too. Every row is encoded for itself, so rows
        that repeat or share an id do not matter. Other columns are kept; one named as `into` is replaced. Of words that are as
        frequent as the last of the dictionary none is taken, which changes no result. An empty table gives an empty result.
        """
        known = self.dictionary(docs, text_col, dictionary_words)
        words, far, folded, ranks, texts = fresh(docs, "words", "long", "folded", "ranks", "texts")
        rank = self._ranks(docs.sparkSession)
        rows = docs.withColumn(words, self.words(F.col(text_col)))
        rows = rows.withColumn(far, F.array_distinct(F.filter(words, lambda w: F.octet_length(w) > LONG)))
        rows = rows.withColumn(folded, self._long_words(docs.sparkSession)(F.col(far))).withColumn(ranks, rank.literal)

        def ids(word: Column) -> Column:
            other = F.when(F.octet_length(word) > LONG, F.element_at(F.col(folded), F.array_position(far, word).cast("int"))).otherwise(self.fold(word))
            return F.coalesce(known.get(word, _word_place(word, known.n)), other) if known else other

        every = lambda: F.flatten(F.transform(words, ids))
        if known:
            rows = rows.withColumn(texts, known.literal)
        inner = (lambda: known.bound(texts, every)) if known else every
        return rows.withColumn(into, rank.bound(ranks, inner)).drop(words, far, folded, ranks, texts)

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), ""))

    def id_bytes(self, ids: Column) -> Column:
        """The ids as little-endian unsigned 32-bit integers."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.little_endian, i)), ""))


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Bpe:
    """The coder of a file of ranks; columns of one session only, as a driver has."""
    return Bpe(read_ranks(path), pattern)


def default_tokenizer(spark: SparkSession) -> Bpe:  # noqa: ARG001
    import public_tokenizers

    return load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
