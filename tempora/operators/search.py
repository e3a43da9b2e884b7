"""Retrieval: filters, exact top-k in dense and sparse spaces, and weighted reciprocal-rank fusion."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..functions.vectors import l2_normalize
from ..sources.staging import Passes, stage
from . import dense, impact

RRF_K, TOP_K = 60, 20
#: Queries of a pass of dense search, and numbers in their vectors; half as many are meant to be in one.
QUERIES_PER_PASS, PASS_VALUES = 32_768, 1 << 21
SPACES = ("semantic", "visual", "keyword")
DEFAULT_ALPHA, DEFAULT_BETA = 0.6, 0.2


def parse_filter(text: str | None) -> dict[str, str]:
    """Conditions of a JSON object or of `key=value` pairs between commas; anything else has none."""
    if not text:
        return {}
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        pairs = (p.partition("=") for p in text.split(",") if "=" in p)
        return {k.strip(): v.strip() for k, _, v in pairs}
    return {str(k): str(v) for k, v in found.items()} if isinstance(found, dict) else {}


def matching(points: DataFrame, conditions: dict[str, str], committed: bool = True) -> DataFrame:
    """Rows that meet every condition; applied before ranking, so that Spark pushes it into the scan."""
    wanted = dict(conditions) | ({"commit_status": "committed"} if committed else {})
    tests = [F.col(k).cast("string") == F.lit(v) for k, v in wanted.items()]
    return points.filter(reduce(Column.__and__, tests)) if tests else points


def top(scored: DataFrame, k: int = TOP_K, by: str = "score") -> DataFrame:
    """The k best points of each query, ranked from 1; ties go to the smaller point. Spark cuts groups before shuffling."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "point_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dense_topk(points: DataFrame, queries: DataFrame, vector: str, k: int = TOP_K) -> DataFrame:
    """query_id, point_id, score, rank by cosine. points: point_id and vector columns; queries: query_id and vector.

    Queries are a stated set. They go to the points in passes of at most QUERIES_PER_PASS rows and PASS_VALUES numbers, a broadcast
    each, and a task keeps k rows a query before anything is shuffled (`dense`). Each pass is written before the next is planned.
    A query never finds itself. `ann.ann_topk` looks at a part of the points only.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("length")).first()
    blocks = max(1, -(-size.n // max(1, min(QUERIES_PER_PASS, PASS_VALUES // max(1, size.length or 1)) // 2)))
    own = points.select("point_id", l2_normalize(F.col(vector)).alias("v"))
    passes = Passes(points.sparkSession, "dense")
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", l2_normalize(F.col(vector)).alias("v"))
        passes.add(dense.best_of_tasks(own, block, k))
    return top(passes.rows(), k)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, weight: how often each term stands in a text."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col))).alias("term"))
    return words.groupBy("id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def sparse_topk(points: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, point_id, score, rank by the inner product; points that share no term are not found, nor a query's own.

    points: id, terms, weights (arrays, a term once a point), or shards of them as `impact.shards` makes; queries: postings. No
    weight is negative.
    """
    own = points if "ids" in points.columns else stage(impact.shards(points), "shards", impact.FILE_SHARDS)
    found = impact.topk(own, queries, k)
    return top(found.withColumn("score", F.round("score", impact.DIGITS)), k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = TOP_K, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, point_id, score, rank by BM25. docs: id, text; queries are postings, whose terms count once each.

    Texts are cut into terms once; their postings are staged in shards, from which corpus figures and scores come. Texts without
    terms are no documents.
    """
    own = stage(impact.shards(docs.select("id", terms(F.col("text")).alias("terms"))), "shards", impact.FILE_SHARDS)
    found = impact.topk(own, queries.withColumn("weight", F.lit(1.0)), k, (k1, b), itself=True)
    return top(found.withColumn("score", F.round("score", impact.DIGITS)), k)


def rrf(rank: Column) -> Column:
    return 1 / (RRF_K + rank)


def gamma(alpha: Column, beta: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - alpha - beta)


def ranked_spaces(hits: dict[str, DataFrame]) -> DataFrame:
    """query_id, point_id, space (its place in SPACES), rank, rrf over the hits of each searched space."""
    parts = [h.select("query_id", "point_id", F.lit(SPACES.index(s)).alias("space"), "rank", rrf(F.col("rank")).alias("rrf")) for s, h in hits.items()]
    return reduce(DataFrame.unionByName, parts)


def fuse(hits: dict[str, DataFrame], alpha: float = DEFAULT_ALPHA, beta: float = DEFAULT_BETA) -> DataFrame:
    """One row a query and point: the score in each space, s_total, source_flags and place.

    A space without a hit scores 0. Equal totals are placed by the first space that found the point, then by rank.
    Spaces left out of `hits` are not searched at all.
    """
    weights = F.array(F.lit(alpha), F.lit(beta), gamma(F.lit(alpha), F.lit(beta)))
    score = lambda k: F.coalesce(F.max(F.when(F.col("space") == k, F.col("rrf"))), F.lit(0.0))
    found = ranked_spaces(hits).groupBy("query_id", "point_id").agg(
        *[score(k).alias(f"s_{s}") for k, s in enumerate(SPACES)],
        F.min(F.struct("space", "rank")).alias("first"), F.array_sort(F.collect_set("space")).alias("spaces"),
    )
    total = sum((F.get(weights, F.lit(k)) * F.col(f"s_{s}") for k, s in enumerate(SPACES)), F.lit(0.0))
    found = found.withColumn("s_total", F.round(total, 8))
    names = F.array(*[F.lit(s) for s in SPACES])
    order = Window.partitionBy("query_id").orderBy(F.desc("s_total"), "first.space", "first.rank", "point_id")
    return found.select(
        "query_id", "point_id", *[F.round(f"s_{s}", 8).alias(f"s_{s}") for s in SPACES], "s_total",
        F.transform("spaces", lambda i: F.get(names, i)).alias("source_flags"), F.row_number().over(order).alias("place"),
    )


def active_spaces(hits: dict[str, DataFrame], flags: list[str] | None) -> dict[str, DataFrame]:
    """The spaces to search: all where no flag is given."""
    return {s: h for s, h in hits.items() if not flags or s in flags}


def route_spaces(confidences: dict[str, float], fallback: float = 0.4) -> list[str]:
    """Spaces whose confidence reaches the threshold; all where none does."""
    chosen = [s for s in SPACES if confidences.get(s, 0.0) >= fallback]
    return chosen or list(SPACES)


def domain_weights(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows (with domain) and their alpha, beta, gamma; defaults where the domain has none. weights: a row a domain."""
    out = rows.join(weights.select("domain", "alpha", "beta"), "domain", "left")
    out = out.withColumns({"alpha": F.coalesce("alpha", F.lit(DEFAULT_ALPHA)), "beta": F.coalesce("beta", F.lit(DEFAULT_BETA))})
    return out.withColumn("gamma", gamma(F.col("alpha"), F.col("beta")))


def lexical_rerank(candidates: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    """The default of the rerank boundary: share of the query's distinct terms that the text holds."""
    want = F.array_distinct(terms(F.col(query)))
    score = F.when(F.size(want) > 0, F.size(F.array_intersect(terms(F.col(text)), want)) / F.size(want)).otherwise(0.0)
    return candidates.withColumn("rerank_score", score)


def final_top(candidates: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best candidates of each query with final_rank: as reranked where they are, else by s_total, neighbours last."""
    score = [F.desc("rerank_score")] if "rerank_score" in candidates.columns else []
    order = Window.partitionBy("query_id").orderBy(*score, F.desc("s_total"), F.asc_nulls_last("place"), "chunk_id")
    return candidates.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= k)


def answered_query(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """queries with the text of each one's best candidate in place of its own; one without candidates is kept as it is."""
    best = final_top(candidates, 1).select("query_id", F.col("text").alias("_best"))
    return queries.join(best, "query_id", "left").withColumn("query", F.coalesce("_best", "query")).drop("_best")


def search_results(candidates: DataFrame) -> DataFrame:
    """chunk_id, text, keyframe_path, score: the rerank score, or the fused one where there is none."""
    score = F.coalesce("rerank_score", "s_total") if "rerank_score" in candidates.columns else F.col("s_total")
    return candidates.select("chunk_id", "text", "keyframe_path", score.alias("score"))
