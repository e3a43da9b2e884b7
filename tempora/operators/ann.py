"""Approximate top-k by cosine: coarse cells, product-quantised residuals, exact re-ranking.

A model is fitted on a bounded sample: centroids of cells, and for each few dimensions of what is left after the centroid a
book of 256 values. Every point is then coded as its cell and a byte for each book; the codes are a table by cell, and later
points are coded by the same model. A query looks into the cells nearest to it: first the very nearest, which gives it a
score to beat, then the others, which send on only what beats that. The best by code are scored again on whole vectors.

Cells and the queries that look into them are cut into shards and blocks of bounded size, so a cell that holds a third of all
points is many tasks. Nothing is dropped: every point of a probed cell is scored.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalize
from ..sources.staging import stage
from .evaluation import exact_sample
from .search import TOP_K, dense_topk, top

#: Bounds of the sample and of the model that is broadcast.
SAMPLE_ROWS, MAX_CELLS, BOOK, SUB_DIMS, ROUNDS, SEED = 20_000, 4096, 256, 2, 12, 42
#: Points for which a cell is made, as far as MAX_CELLS goes; share of true neighbours that the probed cells are to hold.
CELL_ROWS, TARGET = 500, 0.99
SHARD_ROWS, BLOCK_QUERIES, CHUNK, REFINE, FIRST_PROBES = 50_000, 2000, 256, 4, 2


@dataclass
class Model:
    """cells: one centroid a row; books: (books, values, dimensions of a book); probes: cells that a query looks into."""

    cells: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def dim(self) -> int:
        return self.cells.shape[1]

    def units(self, vectors: Iterator) -> np.ndarray:
        """Rows of length one; zeros stay zeros. What is missing at the end of a row is zero."""
        out = np.zeros((len(vectors), self.dim), np.float32)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)

    def nearest(self, units: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row, nearest first."""
        far = (self.cells**2).sum(axis=1) - 2 * units @ self.cells.T
        n = min(n, far.shape[1])
        some = np.argpartition(far, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)

    def codes(self, units: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = (units - self.cells[cells]).reshape(len(units), len(self.books), -1)
        far = [(b**2).sum(axis=1) - 2 * rest[:, k] @ b.T for k, b in enumerate(self.books)]
        return np.stack([f.argmin(axis=1) for f in far], axis=1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, cell: int) -> np.ndarray:
        """The vectors that codes of one cell stand for."""
        return self.cells[cell] + np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)

    def save(self, spark: SparkSession, path: str) -> None:
        data = io.BytesIO()
        np.savez(data, cells=self.cells, books=self.books, probes=self.probes)
        spark.createDataFrame([(bytearray(data.getvalue()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        found = np.load(io.BytesIO(bytes(spark.read.parquet(path).first().model)))
        return Model(found["cells"], found["books"], int(found["probes"]))


def _clusters(rows: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by Lloyd's rounds; a centroid without rows moves to a row drawn at random."""
    at = rows[rng.choice(len(rows), n, replace=len(rows) < n)].copy()
    for _ in range(ROUNDS):
        own = ((at**2).sum(axis=1) - 2 * rows @ at.T).argmin(axis=1)
        size = np.bincount(own, minlength=n)
        total = np.zeros_like(at)
        np.add.at(total, own, rows)
        at = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], rows[rng.integers(len(rows), size=n)]).astype(np.float32)
    return at


def fit(sample: np.ndarray, n_cells: int, k: int = TOP_K, target: float = TARGET, sub_dims: int = SUB_DIMS) -> Model:
    """A model of the sampled vectors (rows).

    probes is the least number of cells that hold a share of `target` of the true neighbours within the sample; among more points
    true neighbours lie closer, so that their cells come earlier.
    """
    rng = np.random.default_rng(SEED)
    dim = -(-sample.shape[1] // sub_dims) * sub_dims
    model = Model(np.zeros((1, dim), np.float32), np.zeros((0, 0, 0), np.float32), 1)
    rows = model.units(list(sample))
    model.cells = _clusters(rows, n_cells, rng)
    own = model.nearest(rows, 1)[:, 0]
    rest = (rows - model.cells[own]).reshape(len(rows), -1, sub_dims)
    model.books = np.stack([_clusters(np.ascontiguousarray(rest[:, b]), min(BOOK, max(1, len(rows))), rng) for b in range(rest.shape[1])])
    asked = rng.choice(len(rows), min(500, len(rows)), replace=False)
    near = rows[asked] @ rows.T
    near[np.arange(len(asked)), asked] = -np.inf
    true = np.argpartition(-near, min(k, len(rows) - 1) - (len(rows) <= k), axis=1)[:, :k]
    place = np.empty((len(asked), n_cells), np.int64)
    np.put_along_axis(place, model.nearest(rows[asked], n_cells), np.arange(n_cells)[None, :], axis=1)
    model.probes = int(np.quantile(np.take_along_axis(place, own[true], axis=1), target, method="higher")) + 1
    return model


def train(points: DataFrame, vector: str, k: int = TOP_K, sample_rows: int = SAMPLE_ROWS, target: float = TARGET) -> Model:
    """A model of point_id and vector columns, fitted on at most `sample_rows` rows; points without a vector don't count."""
    own = points.filter(F.col(vector).isNotNull()).select("point_id", F.col(vector).alias("v"))
    n = own.count()
    if not n:
        raise ValueError("an index needs points to be fitted on")
    sample = exact_sample(own, "point_id", min(1.0, sample_rows / n)).collect()  # at most sample_rows
    cells = max(1, min(MAX_CELLS, n // CELL_ROWS, len(sample) // 16))
    width = max(len(r.v) for r in sample)
    return fit(np.array([np.pad(np.asarray(r.v, np.float32), (0, width - len(r.v))) for r in sample]), cells, k, target)


def encode(points: DataFrame, vector: str, model: Model) -> DataFrame:
    """points with `cell` and `codes` in place of the vector; points without a vector are left out."""
    held = points.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("cell int, codes binary")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            units = held.value.units(b.tolist())
            cell = held.value.nearest(units, 1)[:, 0] if len(units) else np.zeros(0, int)
            codes = held.value.codes(units, cell)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes]})

    rest = [c for c in points.columns if c != vector]
    return points.filter(F.col(vector).isNotNull()).withColumn("_coded", coded(F.col(vector))).select(*rest, "_coded.cell", "_coded.codes")


def append(codes: DataFrame, path: str) -> None:
    """Add coded points to a table of cells. Large cells are spread over several tasks and files."""
    codes.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(path)


def _probed(queries: DataFrame, vector: str, held) -> DataFrame:
    """query_id, q, cell, turn: the cells that a query looks into, the nearest with turn 0."""

    @F.pandas_udf("q array<float>, cells array<int>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            units = held.value.units(b.tolist())
            yield pd.DataFrame({"q": list(units), "cells": list(held.value.nearest(units, held.value.probes).astype(np.int32)) if len(units) else []})

    own = queries.filter(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("_v")).withColumn("_p", look(F.col("_v")))
    return own.select("query_id", "_p.q", F.posexplode("_p.cells").alias("turn", "cell"))


def _scan(held, best: int) -> Callable:
    def run(key: tuple, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "point_id": [], "near": []})
        if points.empty or asked.empty:
            return empty
        codes = np.frombuffer(b"".join(points.codes), np.uint8).reshape(len(points), -1)
        rows, ids = held.value.decoded(codes, key[0]), points.point_id.to_numpy()
        out = []
        for start in range(0, len(asked), CHUNK):
            part = asked.iloc[start : start + CHUNK]
            near = np.stack(part.q.tolist()).astype(np.float32) @ rows.T
            near[part.query_id.to_numpy()[:, None] == ids[None, :]] = -np.inf
            near[near <= part.floor.to_numpy(np.float32)[:, None]] = -np.inf
            n = min(best, near.shape[1])
            at = np.argpartition(-near, n - 1, axis=1)[:, :n]
            score = np.take_along_axis(near, at, axis=1)
            q, c = np.nonzero(np.isfinite(score))
            out.append(pd.DataFrame({"query_id": part.query_id.to_numpy()[q], "point_id": ids[at[q, c]], "near": score[q, c]}))
        return pd.concat(out) if out else empty

    return run


def _candidates(codes: DataFrame, asked: DataFrame, held, best: int) -> DataFrame:
    """query_id, point_id, near: the best points by code of each query in each shard of a cell, above the query's floor."""
    # No more rows than cells, which a model bounds.
    sizes = codes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"))
    blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks"))
    plan = F.broadcast(stage(sizes.join(blocks, "cell"), "cells"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = codes.join(plan, "cell").select("cell", dealt("point_id", "shards").alias("shard"), upto("blocks").alias("block"), "point_id", "codes")
    right = asked.join(plan, "cell").select("cell", dealt("query_id", "blocks").alias("block"), upto("shards").alias("shard"), "query_id", "q", "floor")
    kinds = dict(codes.dtypes)["point_id"], dict(asked.dtypes)["query_id"]
    key = ["cell", "shard", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_scan(held, best), f"query_id {kinds[1]}, point_id {kinds[0]}, near float")


def ann_topk(codes: DataFrame, model: Model, points: DataFrame, queries: DataFrame, vector: str, k: int = TOP_K, refine: int = REFINE) -> DataFrame:
    """query_id, point_id, score, rank as `search.dense_topk` gives them, up to the neighbours that no probed cell holds.

    codes: point_id, cell, codes of the points to be searched, filtered like them; points: point_id and whole vectors, to score
    `refine * k` candidates of each query again; queries: query_id and vector. Points and queries of one id are one and don't
    find each other. Queries for which the probed cells hold fewer than k points are answered exactly. Points or
    queries without a vector are left out; a table without rows gives no rows.
    """
    spark = codes.sparkSession
    held = spark.sparkContext.broadcast(model)
    best = refine * k
    asked = stage(_probed(queries, vector, held), "probed")
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "point_id")
    cut = lambda rows: rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= best)
    own = codes.select("point_id", "cell", "codes")
    first = stage(cut(_candidates(own, asked.filter(F.col("turn") < FIRST_PROBES).withColumn("floor", F.lit(float("-inf"))), held, best)), "near-cells")
    floors = first.filter(F.col("_n") == best).select("query_id", F.col("near").alias("floor"))
    others = asked.filter(F.col("turn") >= FIRST_PROBES).join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = first.drop("_n").unionByName(_candidates(own, others, held, best)) if model.probes > FIRST_PROBES else first.drop("_n")
    found = stage(cut(found).select("query_id", "point_id"), "candidates")

    whole = points.select("point_id", l2_normalize(F.col(vector)).alias("v"))
    sought = queries.select("query_id", l2_normalize(F.col(vector)).alias("q"))
    scored = found.join(whole, "point_id").join(sought, "query_id").select("query_id", "point_id", F.round(dot(F.col("v"), F.col("q")), 6).alias("score"))
    near = stage(top(scored, k), "ann")
    served = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    short = queries.filter(F.col(vector).isNotNull()).join(served, "query_id", "left_anti").select("query_id", vector)
    if short.isEmpty():
        return near
    rest = stage(dense_topk(points.filter(F.col(vector).isNotNull()), stage(short, "short"), vector, k), "exact")
    return near.join(served, "query_id", "left_semi").unionByName(rest)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact results (query_id, point_id) that were found."""
    both = exact.select("query_id", "point_id").join(found.select("query_id", "point_id", F.lit(1).alias("hit")), ["query_id", "point_id"], "left")
    return both.agg(F.coalesce(F.sum("hit"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).first()[0]
