"""Top-k over postings by maximal impact.

Documents are packed into shards of bounded size. A shard is a row: its documents, its terms, and the postings of all terms one
after the other; the postings of one term are a block, and what a document can win by it at most is the block's maximal
impact. A query set is broadcast in passes of bounded size. For a query a shard's blocks are taken from the largest maximal
impact on: once the rest together can't lift a document over the query's k-th best score so far, no new document is looked
at, and candidates are only looked up in what is left, a term that stands everywhere among it. A shard whose blocks together
stay below that score is skipped. A task keeps k documents a query and sends on no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import Passes
from . import dense

#: Terms of a shard (a longer text is one by itself), shards of a file, which Spark reads at once, queries of a pass and their terms.
SHARD_TERMS, FILE_SHARDS, PASS_QUERIES, PASS_TERMS = 100_000, 16, 16_384, 1 << 18
#: A pass is multiplied if it has no more distinct terms and no fewer queries.
MATRIX_TERMS, MATRIX_QUERIES = 256, 64
#: Scores are ranked as rounded; sums of floats and bounds of theirs may differ by less than this.
SLACK, DIGITS = 1e-6, 6


def _pack(ids: pa.Array, lists: pa.Array, weights: pa.Array | None) -> dict:
    """A shard of documents with their lists of terms; without weights a term counts as often as it stands there."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.flatnonzero(size)
    coded = pc.dictionary_encode(lists.flatten())
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(own) + np.repeat(np.arange(len(own)), size[own])
    found, at = np.unique(key, return_inverse=True)
    weight = np.bincount(at, weights.flatten().to_numpy(zero_copy_only=False) if weights is not None else None, len(found)).astype(float)
    starts = np.searchsorted(found, np.arange(len(coded.dictionary) + 1) * len(own))
    return {
        "ids": ids.take(pa.array(own)), "sizes": size[own].astype(float), "terms": coded.dictionary, "starts": starts.astype(np.int32),
        "docs": (found % max(1, len(own))).astype(np.int32), "weights": weight, "tops": np.maximum.reduceat(weight, starts[:-1]) if len(found) else weight,
    }


def shards(docs: DataFrame, keep: tuple[str, ...] = (), limit: int = SHARD_TERMS) -> DataFrame:
    """Shards of docs: id, terms (array), and weights (array) if a term's weight isn't how often it stands there.

    A shard holds documents that are alike in the columns of `keep`; sort by them first, or shards are small. Documents without
    terms are in none. With weights, each term stands once in a document.
    """
    kind, term = dict(docs.dtypes)["id"], dict(docs.dtypes)["terms"]
    weighted = "weights" in docs.columns
    own = docs.select(*keep, "id", "terms", *(["weights"] if weighted else []))
    schema = "".join(f"`{c}` {t}, " for c, t in own.dtypes[: len(keep)])
    schema += f"ids array<{kind}>, sizes array<double>, terms {term}, starts array<int>, docs array<int>, weights array<double>, tops array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = pc.fill_null(pc.list_value_length(b.column("terms")), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // limit
            new = np.concatenate([[True], np.diff(part) != 0])
            for c in keep:
                codes = pc.dictionary_encode(b.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= np.diff(codes) != 0
            cuts = [*np.flatnonzero(new), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                s = b.slice(lo, hi - lo)
                made = _pack(s.column("id"), s.column("terms"), s.column("weights") if weighted else None)
                if len(made["ids"]):
                    rows = {c: s.column(c).slice(0, 1) for c in keep}
                    for name, values in made.items():
                        values = values if isinstance(values, pa.Array) else pa.array(values)
                        rows[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                    yield pa.RecordBatch.from_pydict(rows)

    return own.mapInArrow(run, schema)


@dataclass
class Asked:
    """A pass of queries: the terms of all, each query's terms by place and their weights, and a factor for each term."""

    terms: pa.Array
    queries: list[tuple[object, np.ndarray, np.ndarray]]
    factor: np.ndarray
    mean: float | None = None  # the mean size of documents, for BM25
    k1: float = 1.5
    b: float = 0.75

    @property
    def multiplied(self) -> bool:
        own = np.concatenate([w for _, _, w in self.queries]) if self.queries else np.zeros(0)
        return len(self.terms) <= MATRIX_TERMS and len(self.queries) >= MATRIX_QUERIES and bool((np.isfinite(own) & (own >= 0)).all())

    def blocks(self) -> list[dense.Block]:
        """The queries as rows of matrices, a column a term."""
        found = []
        for lo in range(0, len(self.queries), dense.BLOCK):
            rows = np.arange(lo, min(lo + dense.BLOCK, len(self.queries)))
            matrix = np.zeros((len(rows), len(self.terms)))
            for i, (_, terms, own) in zip(rows - lo, self.queries[lo : lo + dense.BLOCK], strict=True):
                np.add.at(matrix[i], terms, own)
            found.append(dense.Block(rows, rows, matrix, len(self.terms)))
        return found

    def impacts(self, term: int | np.ndarray, weight: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What documents of these sizes win by a term of this weight, before the query's own."""
        if self.mean is None:
            return weight * self.factor[term]
        return self.factor[term] * weight * (self.k1 + 1) / (weight + self.k1 * (1 - self.b + self.b * size / self.mean))


class _Best:
    """The k best of each query so far: scores as ranked, ids, sums."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, {}

    def floor(self, q: object) -> float:
        held = self.held.get(q)
        return held[0][-1] if held is not None and len(held[0]) >= self.k else -np.inf

    def add(self, q: object, ids: np.ndarray, sums: np.ndarray) -> None:
        ranked = np.round(sums, DIGITS)
        if q in self.held:
            ranked, ids, sums = (np.concatenate(x) for x in zip(self.held[q], (ranked, ids, sums), strict=True))
        order = np.lexsort((ids, -ranked))[: self.k]
        self.held[q] = (ranked[order], ids[order], sums[order])


def _search_shard(row: dict[str, pa.Array], asked: Asked, best: _Best, itself: bool) -> None:
    place = pc.index_in(asked.terms, row["terms"])
    at = pc.fill_null(place, -1).to_numpy(zero_copy_only=False)
    starts, docs, weight, size = (row[c].to_numpy() for c in ("starts", "docs", "weights", "sizes"))
    ids, blocks = row["ids"].to_numpy(zero_copy_only=False), {}

    def block(t: int) -> tuple[np.ndarray, np.ndarray, float]:
        if t not in blocks:
            lo, hi = starts[at[t]], starts[at[t] + 1]
            won = asked.impacts(t, weight[lo:hi], size[docs[lo:hi]])
            blocks[t] = docs[lo:hi], won, won.max()
        return blocks[t]

    for q, terms, own in asked.queries:
        here = at[terms] >= 0
        if not here.any():
            continue
        terms, own = terms[here], own[here]
        most = own * np.array([block(t)[2] for t in terms])
        order = np.argsort(-most, kind="stable")
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)
        floor = best.floor(q) - SLACK
        if rest[0] < floor:
            continue
        total, seen, i = np.zeros(len(ids)), np.zeros(len(ids), bool), 0
        while i < len(order) and rest[i] >= floor:
            d, won, _ = block(terms[order[i]])
            total[d] += own[order[i]] * won
            seen[d] = True
            i += 1
            # One document less than ranked may be the query itself.
            if i < len(order) and len(ids) > best.k + 1:
                floor = max(floor, np.partition(total, -best.k - 1)[-best.k - 1] - SLACK)
        some = np.flatnonzero(seen & (total + rest[i] >= floor))
        for j in order[i:]:
            d, won, _ = block(terms[j])
            near = np.minimum(np.searchsorted(d, some), len(d) - 1)
            hit = d[near] == some
            total[some[hit]] += own[j] * won[near[hit]]
        if not itself:
            some = some[ids[some] != q]
        some = some[total[some] > 0]
        if len(some):
            best.add(q, ids[some], total[some])


def _multiply_shard(row: dict[str, pa.Array], asked: Asked, blocks: list[dense.Block], best: list[dense.Best], place: dict | None) -> None:
    """place: where each query stands, by its id; None if queries may find themselves."""
    at = pc.fill_null(pc.index_in(row["terms"], asked.terms), -1).to_numpy(zero_copy_only=False)
    starts, docs, weight, size = (row[c].to_numpy() for c in ("starts", "docs", "weights", "sizes"))
    term = np.repeat(at, np.diff(starts))
    docs, weight, term = docs[term >= 0], weight[term >= 0], term[term >= 0]
    some, own = np.unique(docs, return_inverse=True)
    if not len(some):
        return
    matrix = np.zeros((len(some), len(asked.terms)))
    matrix[own, term] = asked.impacts(term, weight, size[docs])
    ids = row["ids"].to_numpy(zero_copy_only=False)[some]
    codes = np.array([place.get(i, -1) for i in ids.tolist()]) if place is not None else np.full(len(ids), -1)
    for lo in range(0, len(ids), dense.CHUNK):
        part = slice(lo, lo + dense.CHUNK)
        for b, block in zip(best, blocks, strict=True):
            dense.add_scored(b, block, matrix[part], ids[part], codes[part], positive=True)


def _search(held, k: int, itself: bool, kinds: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = held.value, _Best(k)
        blocks = asked.blocks() if asked.multiplied else []
        near = [dense.Best(len(b.rows), k) for b in blocks]
        place = None if itself else {q: i for i, (q, _, _) in enumerate(asked.queries)} if blocks else {}
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].values for c in ("ids", "sizes", "terms", "starts", "docs", "weights")}
                if blocks and np.isfinite(row["weights"].to_numpy()).all():
                    _multiply_shard(row, asked, blocks, near, place)
                else:
                    _search_shard(row, asked, best, itself)
        for block, b in zip(blocks, near, strict=True):
            if b.held is not None:
                query, score, ids = b.held
                names = [asked.queries[i][0] for i in block.rows[query].tolist()]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(names, kinds[0]), "point_id": pa.array(ids.tolist(), kinds[1]), "score": pa.array(score)})
        for q, (_, ids, sums) in best.held.items():
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([q] * len(ids), kinds[0]), "point_id": pa.array(ids.tolist(), kinds[1]), "score": pa.array(sums)})

    return run


def _arrow(kind: str) -> str:
    return {"bigint": "int64", "int": "int32"}.get(kind, kind)


def _statistics(own: DataFrame, terms: DataFrame) -> tuple[int, float, dict]:
    """How many documents there are, their mean size, and in how many each of `terms` (term) stands."""
    figures = own.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0.0), lambda a, x: a + x)).alias("size")).first()
    counts = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.get("starts", i + 1) - F.get("starts", i)).alias("n")))
    each = own.select(F.explode(counts).alias("x")).select("x.*")
    found = each.join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("n").alias("df")).collect()  # the terms of one pass
    n = figures.n or 0
    return n, (figures["size"] or 0.0) / max(1, n), {r.term: r.df for r in found}


def topk(own: DataFrame, queries: DataFrame, k: int, bm25: tuple[float, float] | None = None, itself: bool = False) -> DataFrame:
    """query_id, point_id, score: at least the k best documents of each query, no more than k from a task.

    own: shards, as staged; queries: id, term, weight, which must not be negative, nor those of the shards. The score is the inner
    product, or BM25 by (k1, b), where the query's weights multiply a term's part. Documents that share no term are not found;
    `itself` tells whether a query may find the document of its own id. Passes are written one by one.
    """
    spark: SparkSession = own.sparkSession
    kinds = dict(queries.dtypes)["id"], dict(own.dtypes)["ids"][len("array<") : -1]
    term = dict(own.dtypes)["terms"][len("array<") : -1]
    passes = Passes(spark, "impact")
    size = queries.agg(F.countDistinct("id").alias("n"), F.count(F.lit(1)).alias("terms")).first()
    blocks = max(1, -(-size.n // PASS_QUERIES), -(-size.terms // PASS_TERMS))
    for number in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).select("id", "term", F.col("weight").cast("double").alias("weight"))
        # The queries of one pass.
        rows = part.filter("term IS NOT NULL").groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).toArrow().combine_chunks()
        names, lists = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns)
        flat, cuts = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))[:-1]
        coded = pc.dictionary_encode(flat.field("term"))
        known = coded.dictionary.to_pylist()
        places, weights = (np.split(x.to_numpy(zero_copy_only=False), cuts) for x in (coded.indices, flat.field("weight")))
        asked = list(zip(names.to_pylist(), places, weights, strict=False))
        factor, mean = np.ones(len(known)), None
        if bm25:
            n, mean, df = _statistics(own, spark.createDataFrame([(t,) for t in known], f"term {term}"))
            count = np.array([df.get(t, 0) for t in known], float)
            factor = np.log(1 + (n - count + 0.5) / (count + 0.5))
        held = spark.sparkContext.broadcast(Asked(coded.dictionary, asked, factor, mean, *(bm25 or ())))
        arrow = tuple(_arrow(c) for c in kinds)
        found = own.select("ids", "sizes", "terms", "starts", "docs", "weights").mapInArrow(_search(held, k, itself, arrow), f"query_id {kinds[0]}, point_id {kinds[1]}, score double")
        passes.add(found)
        held.unpersist()
    return passes.rows()
