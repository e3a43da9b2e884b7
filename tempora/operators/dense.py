"""Exact top-k by inner product, in blocks of queries and points.

A pass of queries is broadcast; a task multiplies its points, a chunk at a time, with the queries, a block at a time, and keeps the k
best points of each query. Once a query has k points, only scores that reach the least of them are looked at one by one, so a
pair costs a multiplication of matrices and one comparison. Both are done in single precision, with a margin for what that may be
off; what reaches it is scored again in double. What a task holds is a chunk's scores and k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a chunk and queries of a block: together the scores that a task holds at a time.
CHUNK, BLOCK = 4096, 1024
#: Scores are ranked as rounded to DIGITS; two scores that round alike differ by no more than SLACK.
DIGITS, SLACK = 6, 2e-6
#: Single precision: its unit of rounding, and between which bounds products are taken in it.
UNIT, LEAST, MOST = 2.0**-24, 1e-30, 1e30
#: Where more than one in so many pairs is looked at, all are scored in double at once.
DENSE_PAIRS = 16


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores at DIGITS places, halves away from zero, and no negative zero."""
    return np.copysign(np.floor(np.abs(scores) * 10**DIGITS + 0.5) / 10**DIGITS, scores) + 0.0


def _lengths(vectors: pa.Array) -> np.ndarray:
    """The length of each vector; -1 for null."""
    return pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)


def _matrix(vectors: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    return vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), length)


def _single(matrix: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return matrix.astype(np.float32)


def _least(matrix: np.ndarray) -> float:
    """The least of the numbers above zero."""
    return float(np.min(matrix, where=matrix > 0, initial=np.inf))


class Block:
    """Queries of one length of vector, sorted by `code`, which stands for their ids; -1 is the length of null."""

    def __init__(self, rows: np.ndarray, codes: np.ndarray, matrix: np.ndarray, length: int) -> None:
        self.rows, self.codes, self.length, self.matrix = rows, codes, length, matrix
        self.nan, self.norms = bool(np.isnan(matrix).any()), np.linalg.norm(matrix, axis=1)
        self.single, self.least = _single(matrix), _least(matrix)


class Asked:
    """A pass of queries in blocks."""

    def __init__(self, ids: pa.Array, keys: pa.Array, vectors: pa.Array) -> None:
        coded = pc.dictionary_encode(keys)
        self.ids, self.keys, codes, lengths = ids, coded.dictionary, pc.fill_null(coded.indices, -2).to_numpy(zero_copy_only=False), _lengths(vectors)
        self.blocks = []
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            own = own[np.argsort(codes[own], kind="stable")]
            for lo in range(0, len(own), BLOCK):
                part = own[lo : lo + BLOCK]
                self.blocks.append(Block(part, codes[part], _matrix(vectors, part, length) if length >= 0 else np.empty((len(part), 0)), length))


class Best:
    """The k best points of each query of a block so far, by query, score as ranked, and id. NaN is above all, null below."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.floor, self.full = k, np.full(n, -np.inf), np.zeros(n, bool)
        self.held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.last: np.ndarray | None = None

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = score > self.floor[query]
        better |= ~self.full[query]
        if self.last is not None:
            tied = np.flatnonzero(~better & (score == self.floor[query]))
            better[tied] = ids[tied] < self.last[query[tied]]
        if not better.any():
            return
        query, score, ids = query[better], score[better], ids[better]
        if self.held is not None:
            query, score, ids = (np.concatenate(x) for x in zip(self.held, (query, score, ids), strict=True))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(query) != 0]))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = place < self.k
        self.held = query[keep], score[keep], ids[keep]
        end = np.flatnonzero(place == self.k - 1)
        if self.last is None:
            self.last = np.empty(len(self.floor), ids.dtype)
        self.floor[query[end]], self.full[query[end]], self.last[query[end]] = score[end], True, ids[end]


def add_scored(best: Best, block: Block, matrix: np.ndarray, ids: np.ndarray, codes: np.ndarray, positive: bool = False) -> None:
    """Add points to what the block's queries have found; with `positive` those of score 0 are none, and no number is negative."""
    norm = np.linalg.norm(matrix, axis=1).max()
    # A sum of n products is off by n units of its vectors' lengths at most, and so is the sum it is compared with.
    margin = SLACK + 2 * (matrix.shape[1] + 4) * UNIT * block.norms * norm
    single = bool((margin < MOST * UNIT).all()) and not (positive and block.least * _least(matrix) < LEAST)
    scores = block.single @ _single(matrix).T if single else block.matrix @ matrix.T
    if not single and (block.nan or np.isnan(matrix).any()):
        scores[np.isnan(scores)] = np.inf
    # A query never finds itself.
    lo, hi = np.searchsorted(block.codes, codes), np.searchsorted(block.codes, codes, "right")
    for p in np.flatnonzero((hi > lo) & (codes >= 0)):
        scores[lo[p] : hi[p], p] = 0 if positive else -np.inf
    least = best.floor.copy()
    if len(ids) > best.k and not best.full.all():
        new = np.flatnonzero(~best.full)
        least[new] = np.partition(scores[new], len(ids) - best.k, axis=1)[:, len(ids) - best.k]
    least -= margin if single else SLACK
    if positive:
        least = np.maximum(least, np.finfo(np.float32).smallest_subnormal if single else np.nextafter(0, 1))
    at = np.flatnonzero(scores >= least.astype(scores.dtype)[:, None])
    found, (query, point) = scores.ravel()[at], np.divmod(at, len(ids))
    real = found > -np.inf
    if not real.all():
        at, found, query, point = at[real], found[real], query[real], point[real]
    if single and len(at) * DENSE_PAIRS > scores.size:
        found = (block.matrix @ matrix.T).ravel()[at]
    elif single:
        found = np.einsum("ij,ij->i", block.matrix[query], matrix[point])
    best.add(query, rounded(found), ids[point])


def _add_null(best: Best, block: Block, ids: np.ndarray, codes: np.ndarray) -> None:
    """Points without a score for these queries: the least ids count, a query's own left out."""
    some = np.isin(ids, np.unique(ids)[: best.k + 1])
    query, point = (x.ravel() for x in np.meshgrid(np.arange(len(block.rows)), np.flatnonzero(some), indexing="ij"))
    other = (block.codes[query] != codes[point]) | (codes[point] < 0)
    best.add(query[other], np.full(other.sum(), -np.inf), ids[point[other]])


def _search(held, k: int, kinds: tuple[pa.DataType, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = held.value
        best = [Best(len(b.rows), k) for b in asked.blocks]
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                ids, vectors = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                codes = pc.fill_null(pc.index_in(part.column(0), asked.keys), -1).to_numpy(zero_copy_only=False)
                lengths, matrices = _lengths(vectors), {}
                for b, block in zip(best, asked.blocks, strict=True):
                    if block.length not in matrices:
                        same = np.flatnonzero(lengths == block.length) if block.length >= 0 else np.empty(0, np.int64)
                        other = np.setdiff1d(np.arange(len(ids)), same)
                        matrices[block.length] = same, other, _matrix(vectors, same, max(0, block.length))
                    same, other, matrix = matrices[block.length]
                    if len(same):
                        add_scored(b, block, matrix, ids[same], codes[same])
                    if len(other):
                        _add_null(b, block, ids[other], codes[other])
        for b, block in zip(best, asked.blocks, strict=True):
            if b.held is not None:
                query, score, ids = b.held
                score = np.where(score == np.inf, np.nan, score)
                yield pa.RecordBatch.from_arrays(
                    [asked.ids.take(pa.array(block.rows[query])).cast(kinds[0]), pa.array(ids, kinds[1]), pa.array(score, mask=score == -np.inf)],
                    ["query_id", "point_id", "score"],
                )

    return run


def best_of_tasks(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, point_id, score: the k best points of each query in each task, the score rounded.

    points: point_id, v; queries: query_id, v, one pass of bounded size; v are arrays of doubles, of one length each or null. Vectors of
    other lengths than the query's and null ones have no score and come last. Ties go to the smaller point.
    """
    spark = points.sparkSession
    kind, key = dict(queries.dtypes)["query_id"], dict(points.dtypes)["point_id"]
    # The queries of one pass.
    rows = queries.select("query_id", F.col("query_id").try_cast(key).alias("key"), "v").filter("query_id IS NOT NULL").toArrow().combine_chunks()
    flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
    held = spark.sparkContext.broadcast(Asked(*flat))
    own = points.select("point_id", "v").filter("point_id IS NOT NULL").repartition(spark.sparkContext.defaultParallelism, "point_id")
    return own.mapInArrow(_search(held, k, (flat[0].type, flat[1].type)), f"query_id {kind}, point_id {key}, score double")
