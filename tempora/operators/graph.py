"""The timeline graph: edges, bounded hops and context expansion, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_HOPS = 5


def _edge(rows: DataFrame, kind: str, gap=None, parent=None) -> DataFrame:
    gap = F.lit(None).cast("double") if gap is None else gap
    parent = F.lit(None).cast("string") if parent is None else parent
    return rows.select("src", "dst", F.lit(kind).alias("type"), gap.alias("gap_sec"), parent.alias("parent_chunk_id"))


def nodes(chunks: DataFrame) -> DataFrame:
    """Graph nodes; missing strings are empty, a missing scene is -1, missing times are 0."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return chunks.select(
        "chunk_id", text("vid_hash"), text("domain"), text("text"), F.coalesce("start", F.lit(0.0)).alias("start_sec"), F.coalesce("end", F.lit(0.0)).alias("end_sec"),
        F.coalesce(F.col("scene_index").cast("long"), F.lit(-1)).alias("scene_index"), text("keyframe_path"), text("parent_chunk_id"),
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (*keys, "_v")]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_v").alias("_row"))
    return best.select(*keys, "_row.*")


def next_event_edges(chunks: DataFrame) -> DataFrame:
    """From each chunk to the next of its video, by start and then by ord; the gap may be negative."""
    w = Window.partitionBy("vid_hash").orderBy("start", "ord")
    rows = chunks.withColumn("dst", F.lead("chunk_id").over(w)).withColumn("later", F.lead("start").over(w)).filter("dst IS NOT NULL")
    return _edge(rows.withColumnRenamed("chunk_id", "src"), "NEXT_EVENT", gap=F.col("later") - F.col("end"))


def same_scene_edges(chunks: DataFrame) -> DataFrame:
    """From each chunk to every later one of its scene; chunks without a scene have none. A scene's size bounds its edges."""
    own = chunks.filter("scene_index >= 0")
    a = own.select("vid_hash", "scene_index", F.col("ord").alias("i"), F.col("chunk_id").alias("src"))
    b = own.select("vid_hash", "scene_index", F.col("ord").alias("j"), F.col("chunk_id").alias("dst"))
    return _edge(a.join(b, ["vid_hash", "scene_index"]).filter("i < j"), "SAME_SCENE")


def cross_pair_edges(chunks: DataFrame) -> DataFrame:
    """From the first to the second chunk of each parent."""
    own = chunks.filter("parent_chunk_id IS NOT NULL AND parent_chunk_id <> ''")
    w = Window.partitionBy("vid_hash", "parent_chunk_id").orderBy("ord")
    rows = own.withColumn("dst", F.lead("chunk_id").over(w)).withColumn("n", F.row_number().over(w)).filter("n = 1 AND dst IS NOT NULL")
    return _edge(rows.select(F.col("chunk_id").alias("src"), "dst", "parent_chunk_id"), "CROSS_SCENE_PAIR", parent=F.col("parent_chunk_id"))


def with_endpoints(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = known.select("chunk_id")
    return edges.join(ids, edges.src == ids.chunk_id, "left_semi").join(ids, edges.dst == ids.chunk_id, "left_semi")


def build(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the distinct edges between them."""
    known = nodes(chunks)
    edges = reduce(DataFrame.unionByName, [next_event_edges(chunks), same_scene_edges(chunks), cross_pair_edges(chunks)])
    return known, with_endpoints(edges, known).dropDuplicates(["src", "dst", "type"])


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"))


# A scene of n chunks has n (n - 1) / 2 edges. Kept as members with their order they are n rows, and a seed's edges are made when
# they are asked for.


def scene_members(chunks: DataFrame) -> DataFrame:
    """vid_hash, scene_index, ord, chunk_id: a row for each chunk that lies in a scene, instead of the edges between them."""
    return chunks.filter("scene_index >= 0").select("vid_hash", "scene_index", "ord", "chunk_id")


def build_compact(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their ord, and the distinct edges but those within scenes, which the nodes stand for: linear in the chunks."""
    known = nodes(chunks).join(chunks.select("chunk_id", "ord"), "chunk_id")
    return known, with_endpoints(next_event_edges(chunks).unionByName(cross_pair_edges(chunks)), known).dropDuplicates(["src", "dst", "type"])


def hop_scene(members: DataFrame, seeds: DataFrame, bidirectional: bool = False) -> DataFrame:
    """seed, chunk_id: the later chunks of each seed's scene, or all others of another ord: what `hop_once` finds by SAME_SCENE edges."""
    own = scene_members(members)
    at = seeds.select(F.col("chunk_id").alias("seed")).distinct().join(own.withColumnRenamed("chunk_id", "seed").withColumnRenamed("ord", "i"), "seed")
    later = F.col("i") != F.col("ord") if bidirectional else F.col("i") < F.col("ord")
    return at.join(own, ["vid_hash", "scene_index"]).filter(later).select("seed", "chunk_id").distinct()


def scene_edge_count(members: DataFrame) -> DataFrame:
    """type, n_edges of the edges that scenes stand for; no row where there are none. Chunks of one ord have no edge."""
    half = lambda n: n * (n - 1) / 2
    ties = scene_members(members).groupBy("vid_hash", "scene_index", "ord").agg(F.count(F.lit(1)).alias("t"))
    scenes = ties.groupBy("vid_hash", "scene_index").agg(F.sum("t").alias("n"), F.sum(half(F.col("t"))).alias("tied"))
    total = scenes.agg(F.sum(half(F.col("n")) - F.col("tied")).cast("long").alias("n_edges")).filter("n_edges > 0")
    return total.select(F.lit("SAME_SCENE").alias("type"), "n_edges")


def hops(limit: object) -> int:
    """A hop limit between 1 and 5; 1 for what is no number."""
    try:
        return max(1, min(int(limit), MAX_HOPS))
    except (TypeError, ValueError):
        return 1


def hop_temporal(edges: DataFrame, seeds: DataFrame, limit: object = 2) -> DataFrame:
    """seed, chunk_id: what is reached in one to `limit` steps of NEXT_EVENT, forward. Levels are joins, at most five."""
    step = edges.filter("type = 'NEXT_EVENT'").select("src", "dst")
    level, found = seeds.select(F.col("chunk_id").alias("seed"), "chunk_id"), []
    for _ in range(hops(limit)):
        level = level.join(step, level.chunk_id == step.src).select("seed", F.col("dst").alias("chunk_id")).distinct()
        found.append(level)
    return reduce(DataFrame.unionByName, found).distinct()


def hop_once(edges: DataFrame, seeds: DataFrame, kind: str, bidirectional: bool = False) -> DataFrame:
    """seed, chunk_id: out-neighbours by one type of edge."""
    step = edges.filter(F.col("type") == kind).select("src", "dst")
    if bidirectional:
        step = step.unionByName(step.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return step.join(seeds.select(F.col("chunk_id").alias("seed")), F.col("src") == F.col("seed")).select("seed", F.col("dst").alias("chunk_id")).distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, limit: object = 2, temporal: bool = True, spatial: bool = True, pairs: bool = True, bidirectional: bool = False, members: DataFrame | None = None) -> DataFrame:
    """seed, chunk_id: what each seed reaches by the chosen kinds of edges. members: nodes with ord that stand for edges within scenes."""
    parts = [hop_temporal(edges, seeds, limit)] if temporal else []
    parts += [hop_scene(members, seeds, bidirectional)] if spatial and members is not None else []
    parts += [hop_once(edges, seeds, kind, bidirectional) for kind, on in (("SAME_SCENE", spatial), ("CROSS_SCENE_PAIR", pairs)) if on]
    if not parts:
        return seeds.select(F.col("chunk_id").alias("seed"), "chunk_id").limit(0)
    return reduce(DataFrame.unionByName, parts).distinct()


def expand(edges: DataFrame, seeds: DataFrame, limit: object = 2, temporal: bool = True, spatial: bool = True, pairs: bool = True, bidirectional: bool = False, members: DataFrame | None = None) -> DataFrame:
    """chunk_id: neighbours of all seeds by the chosen kinds of edges, without the seeds."""
    return neighbours(edges, seeds, limit, temporal, spatial, pairs, bidirectional, members).select("chunk_id").distinct().join(seeds.select("chunk_id"), "chunk_id", "left_anti")


def node_metadata(known: DataFrame, ids: DataFrame) -> DataFrame:
    return known.join(ids.select("chunk_id").distinct(), "chunk_id")


def with_neighbours(candidates: DataFrame, edges: DataFrame, known: DataFrame, limit: object = 2) -> DataFrame:
    """Candidates, and their neighbours as further candidates of total 0; with a query_id, each query's own ones.

    Nodes with ord stand for the edges within their scenes.
    """
    members = known if "ord" in known.columns else None
    if "query_id" in candidates.columns:
        own = candidates.filter("chunk_id IS NOT NULL AND chunk_id <> ''").select("query_id", "chunk_id").distinct()
        near = neighbours(edges, own.select("chunk_id").distinct(), limit, members=members)
        reached = own.join(near.withColumnRenamed("chunk_id", "near"), F.col("chunk_id") == F.col("seed")).select("query_id", F.col("near").alias("chunk_id"))
        reached = reached.distinct().join(own, ["query_id", "chunk_id"], "left_anti")
        columns = [c for c in known.columns if c in candidates.columns and c not in ("chunk_id", "ord")]
        more = known.join(reached, "chunk_id").select("query_id", "chunk_id", *columns, F.lit(0.0).alias("s_total"))
        return candidates.unionByName(more, allowMissingColumns=True)
    seeds = candidates.filter("chunk_id IS NOT NULL AND chunk_id <> ''").select("chunk_id").distinct()
    more = node_metadata(known, expand(edges, seeds, limit, members=members)).select("chunk_id", "text", "keyframe_path", "scene_index", "parent_chunk_id", F.lit(0.0).alias("s_total"))
    return candidates.unionByName(more, allowMissingColumns=True)
