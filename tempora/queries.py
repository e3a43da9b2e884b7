"""Queries over the driver tables, by name, with the SQL that says the same.

Bindings: points are `embeddings` (elements 1-32 and 33-64 are two dense spaces, components above 0.15 a sparse one);
timelines are `conversations` and `events`; texts are `documents` and `benchmark`. Floats are rounded before they rank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import media, text, vectors
from .operators import ann, chunking, evaluation, graph, models, search, selection, signals
from .plans import commits, tracker
from .plans.engine import Engine
from .sources import sinks, staging
from .streaming import queues

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ASKED_EVERY, SPARSE_FLOOR = 20, 0.15


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Bindings -----------------------------------------------------------------------------------------------------------


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"), v.alias("embedding"), F.slice(v, 1, 32).alias("text_dense"), F.slice(v, 33, 32).alias("image_dense"),
        F.col("label").alias("domain"), F.when(F.col("vec_id") % 7 == 0, "pending").otherwise("committed").alias("commit_status"),
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).filter(F.col("point_id") % ASKED_EVERY == 0).select(F.col("point_id").alias("query_id"), "embedding", "text_dense", "image_dense", "domain")


def components(rows: DataFrame, id_col: str) -> DataFrame:
    """Sparse postings of the embeddings: components above a floor."""
    return rows.select(F.col(id_col).alias("id"), F.posexplode(vectors.doubles(F.col("embedding"))).alias("term", "weight")).filter(F.col("weight") > SPARSE_FLOOR)


def vectors_of_components(rows: DataFrame) -> DataFrame:
    """The same components as arrays: id, terms, weights."""
    above = F.filter(F.transform(vectors.doubles(F.col("embedding")), lambda x, i: F.struct(i.alias("term"), x.alias("weight"))), lambda c: c["weight"] > SPARSE_FLOOR)
    return rows.select(F.col("point_id").alias("id"), above.alias("c")).select("id", F.col("c.term").alias("terms"), F.col("c.weight").alias("weights"))


def hits(spark: SparkSession, sf_dir: str, flags: list[str] | None = None) -> dict[str, DataFrame]:
    """The hits of the spaces to search: all where no flag is given. Searches run when they are made."""
    p, q = points(spark, sf_dir), asked(spark, sf_dir)
    searches = {
        "semantic": lambda: search.dense_topk(p, q, "text_dense"),
        "visual": lambda: search.dense_topk(p, q, "image_dense"),
        "keyword": lambda: search.sparse_topk(vectors_of_components(p), components(q, "query_id")),
    }
    return {s: run() for s, run in search.active_spaces(searches, flags).items()}


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a timeline: a turn is a chunk of its video, roles are scenes, conversation and role a parent."""
    c = table(spark, sf_dir, "conversations")
    scene = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(-1)
    start = F.col("turn") * 10.0
    return c.select(
        F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").cast("string").alias("vid_hash"), F.lit("talk").alias("domain"), "text", F.col("turn").alias("ord"),
        start.alias("start"), (start + F.char_length("text") / 50.0).alias("end"), scene.alias("scene_index"), F.concat("role", F.lit(".jpg")).alias("keyframe_path"), F.concat_ws("|", "conv_id", "role").alias("parent_chunk_id"),
    )


TALK = """talk AS (SELECT conv_id || ':' || turn AS chunk_id, conv_id::VARCHAR AS vid_hash, 'talk' AS domain, text, turn AS ord, turn * 10.0::DOUBLE AS start_s,
  turn * 10.0::DOUBLE + length(text) / 50.0::DOUBLE AS end_s, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE -1 END AS scene,
  role || '.jpg' AS keyframe_path, conv_id || '|' || role AS parent FROM conversations)"""


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a timeline: a user's events in order of time, seconds from the start of 2024."""
    e = table(spark, sf_dir, "events")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 1e6
    return e.select(F.col("event_id").cast("string").alias("chunk_id"), F.col("user_id").cast("string").alias("vid_hash"), F.col("event_id").alias("ord"), start.alias("start"), start.alias("end"), "event_type", "value")


CLICKS = """clicks AS (SELECT event_id::VARCHAR AS chunk_id, user_id::VARCHAR AS vid_hash, event_id AS ord, (epoch_us(ts) - 1704067200000000) / 1e6 AS start_s, event_type, value FROM events)"""


# Search -------------------------------------------------------------------------------------------------------------


def _dense_sql(lo: int, hi: int, where: str = "TRUE") -> str:
    return f"""SELECT query_id, point_id, score, rank FROM (
  SELECT q.vec_id AS query_id, p.vec_id AS point_id, round(list_cosine_similarity(p.embedding[{lo}:{hi}]::DOUBLE[], q.embedding[{lo}:{hi}]::DOUBLE[]), 6) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(p.embedding[{lo}:{hi}]::DOUBLE[], q.embedding[{lo}:{hi}]::DOUBLE[]), 6) DESC, p.vec_id) AS rank
  FROM embeddings p, embeddings q WHERE q.vec_id % {ASKED_EVERY} = 0 AND p.vec_id <> q.vec_id AND {where}) WHERE rank <= 20"""


_SPARSE_SQL = f"""SELECT query_id, point_id, score, rank FROM (SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM (
  SELECT q.id AS query_id, p.id AS point_id, round(sum(p.w * q.w), 6) AS score FROM
    (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS t, unnest(embedding)::DOUBLE AS w FROM embeddings) p JOIN
    (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS t, unnest(embedding)::DOUBLE AS w FROM embeddings WHERE vec_id % {ASKED_EVERY} = 0) q USING (t)
  WHERE p.w > {SPARSE_FLOOR} AND q.w > {SPARSE_FLOOR} AND p.id <> q.id GROUP BY ALL)) WHERE rank <= 20"""

_SPACES_SQL = f"""spaces AS (SELECT 0 AS space, * FROM ({_dense_sql(1, 32)}) UNION ALL SELECT 1, * FROM ({_dense_sql(33, 64)}) UNION ALL SELECT 2, * FROM ({_SPARSE_SQL}))"""


def _fused_sql(alpha: float, beta: float, spaces: str) -> str:
    w = [alpha, beta, max(0.0, 1 - alpha - beta)]
    part = lambda s: f"coalesce(max(1.0::DOUBLE / (60 + rank)) FILTER (space = {s}), 0.0::DOUBLE)"
    return f"""WITH {_SPACES_SQL},
f AS (SELECT query_id, point_id, {part(0)} AS a, {part(1)} AS b, {part(2)} AS c, min(space * 1000 + rank) AS first,
  string_agg(['semantic', 'visual', 'keyword'][space + 1], ',' ORDER BY space) AS source_flags FROM spaces WHERE space IN ({spaces}) GROUP BY ALL),
t AS (SELECT *, round({w[0]}::DOUBLE * a + {w[1]}::DOUBLE * b + {w[2]!r}::DOUBLE * c, 8) AS s_total FROM f)
SELECT query_id, point_id, round(a, 8) AS s_semantic, round(b, 8) AS s_visual, round(c, 8) AS s_keyword, s_total, source_flags,
  row_number() OVER (PARTITION BY query_id ORDER BY s_total DESC, first, point_id) AS place FROM t"""


@query(_dense_sql(1, 32))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense_topk(points(spark, sf_dir), asked(spark, sf_dir), "text_dense")


@query(_dense_sql(1, 32, "p.vec_id % 7 <> 0 AND p.label = 3"))
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = search.matching(points(spark, sf_dir), search.parse_filter("domain=3"))
    return search.dense_topk(own, asked(spark, sf_dir), "text_dense")


@query(_dense_sql(33, 64))
def visual_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense_topk(points(spark, sf_dir), asked(spark, sf_dir), "image_dense")


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's answer to dense_topk: no SQL says the same, tests hold its recall against dense_topk."""
    p = points(spark, sf_dir)
    model = ann.train(p, "text_dense")
    codes = staging.stage(ann.encode(p.select("point_id", "text_dense"), "text_dense", model), "codes")
    return ann.ann_topk(codes, model, p, asked(spark, sf_dir), "text_dense")


@query("""SELECT vec_id, array_to_string(list_transform(embedding[1:32], lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding[1:32], lambda y: y::DOUBLE * y::DOUBLE))), 4)::DECIMAL(9, 4)::VARCHAR), ',') AS unit FROM embeddings""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.transform(vectors.l2_normalize(F.slice("embedding", 1, 32)), lambda x: F.round(x, 4).cast("decimal(9,4)").cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(unit, ",").alias("unit"))


@query(_SPARSE_SQL)
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.sparse_topk(vectors_of_components(points(spark, sf_dir)), components(asked(spark, sf_dir), "query_id"))


@query("""WITH d AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
tf AS (SELECT id, term, count(*)::DOUBLE AS w FROM d GROUP BY ALL), s AS (SELECT id, sum(w) AS size FROM tf GROUP BY id),
c AS (SELECT count(*) AS n, avg(size) AS mean FROM s), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
h AS (SELECT query_id, id AS point_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * w * 2.5::DOUBLE / (w + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 6) AS score
  FROM tf JOIN q USING (term) JOIN df USING (term) JOIN s USING (id), c WHERE TRUE GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM h) WHERE rank <= 20""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.bm25_topk(docs, search.postings(table(spark, sf_dir, "benchmark"), "item_id", "text"))


@query(f"WITH {_SPACES_SQL} SELECT query_id, point_id, space, rank, round(1.0::DOUBLE / (60 + rank), 8) AS rrf FROM spaces")
def rrf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_spaces(hits(spark, sf_dir)).withColumn("rrf", F.round("rrf", 8))


def _flat(fused: DataFrame) -> DataFrame:
    return fused.withColumn("source_flags", F.array_join("source_flags", ","))


@query(_fused_sql(0.6, 0.2, "0, 1, 2"))
def tri_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(search.fuse(hits(spark, sf_dir)))


@query(_fused_sql(0.6, 0.2, "0, 2"))
def tri_search_two_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(search.fuse(hits(spark, sf_dir, ["semantic", "keyword"])))


@query("""WITH w(domain, alpha, beta) AS (VALUES ('0', 0.5::DOUBLE, 0.3::DOUBLE), ('1', 0.9::DOUBLE, 0.4::DOUBLE))
SELECT vec_id AS point_id, coalesce(alpha, 0.6::DOUBLE) AS alpha, coalesce(beta, 0.2::DOUBLE) AS beta, round(greatest(0.0::DOUBLE, 1 - coalesce(alpha, 0.6::DOUBLE) - coalesce(beta, 0.2::DOUBLE)), 6) AS gamma
FROM embeddings LEFT JOIN w ON w.domain = label::VARCHAR""")
def domain_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("0", 0.5, 0.3), ("1", 0.9, 0.4)], "domain string, alpha double, beta double")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").cast("string").alias("domain"))
    return search.domain_weights(rows, known).select("point_id", "alpha", "beta", F.round("gamma", 6).alias("gamma"))


# Graph --------------------------------------------------------------------------------------------------------------

_EDGES_SQL = f"""{TALK}, edges AS (
  SELECT src, dst, 'NEXT_EVENT' AS type, round(nxt - end_s, 6) AS gap_sec, NULL::VARCHAR AS parent_chunk_id FROM (
    SELECT chunk_id AS src, lead(chunk_id) OVER w AS dst, lead(start_s) OVER w AS nxt, end_s FROM talk WINDOW w AS (PARTITION BY vid_hash ORDER BY start_s, ord)) WHERE dst IS NOT NULL
  UNION ALL SELECT a.chunk_id, b.chunk_id, 'SAME_SCENE', NULL, NULL FROM talk a JOIN talk b ON a.vid_hash = b.vid_hash AND a.scene = b.scene AND a.ord < b.ord WHERE a.scene >= 0
  UNION ALL SELECT a.chunk_id, b.chunk_id, 'CROSS_SCENE_PAIR', NULL, parent FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY ord) AS n FROM talk) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY ord) AS n FROM talk) b USING (parent) WHERE a.n = 1 AND b.n = 2)"""
_SEEDS_SQL = "seeds AS (SELECT chunk_id FROM talk WHERE ord = 1)"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk(spark, sf_dir).filter("ord = 1").select("chunk_id")


def _round_gap(edges: DataFrame) -> DataFrame:
    return edges.withColumn("gap_sec", F.round("gap_sec", 6))


@query(f"""WITH {CLICKS} SELECT * FROM (SELECT chunk_id AS src, lead(chunk_id) OVER w AS dst, 'NEXT_EVENT' AS type, round(lead(start_s) OVER w - start_s, 6) AS gap_sec, NULL::VARCHAR AS parent_chunk_id
FROM clicks WINDOW w AS (PARTITION BY vid_hash ORDER BY start_s, ord)) WHERE dst IS NOT NULL""")
def next_event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_gap(graph.next_event_edges(clicks(spark, sf_dir)))


@query(f"WITH {_EDGES_SQL} SELECT * FROM edges WHERE type = 'SAME_SCENE'")
def same_scene_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.same_scene_edges(talk(spark, sf_dir))


@query(f"WITH {_EDGES_SQL} SELECT * FROM edges WHERE type = 'CROSS_SCENE_PAIR'")
def cross_scene_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cross_pair_edges(talk(spark, sf_dir))


@query(f"WITH {_EDGES_SQL} SELECT type, count(*) AS n_edges FROM edges GROUP BY type")
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir)
    return graph.edge_counts(graph.build_compact(rows)[1]).unionByName(graph.scene_edge_count(rows))


@query(f"WITH {_EDGES_SQL} SELECT DISTINCT src, dst, type, gap_sec, parent_chunk_id FROM edges")
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_gap(graph.build(talk(spark, sf_dir))[1])


@query(f"""WITH RECURSIVE {CLICKS}, step AS (SELECT * FROM (SELECT chunk_id AS src, lead(chunk_id) OVER (PARTITION BY vid_hash ORDER BY start_s, ord) AS dst FROM clicks) WHERE dst IS NOT NULL),
walk AS (SELECT src AS seed, dst AS chunk_id, 1 AS n FROM step WHERE src::BIGINT % {ASKED_EVERY} = 0 UNION ALL SELECT seed, dst, n + 1 FROM walk JOIN step ON chunk_id = src WHERE n < 3)
SELECT DISTINCT seed, chunk_id FROM walk""")
def hop_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clicks(spark, sf_dir)
    return graph.hop_temporal(graph.next_event_edges(rows), rows.filter(F.col("ord") % ASKED_EVERY == 0), 3)


@query(f"WITH {_EDGES_SQL}, {_SEEDS_SQL} SELECT DISTINCT src AS seed, dst AS chunk_id FROM edges WHERE type = 'SAME_SCENE' AND src IN (FROM seeds)")
def hop_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hop_scene(talk(spark, sf_dir), _seeds(spark, sf_dir))


@query(f"WITH {_EDGES_SQL}, {_SEEDS_SQL} SELECT DISTINCT src AS seed, dst AS chunk_id FROM edges WHERE type = 'CROSS_SCENE_PAIR' AND src IN (FROM seeds)")
def hop_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hop_once(graph.cross_pair_edges(talk(spark, sf_dir)), _seeds(spark, sf_dir), "CROSS_SCENE_PAIR")


_EXPAND_SQL = f"""WITH {_EDGES_SQL}, {_SEEDS_SQL}, one AS (SELECT dst FROM edges WHERE type = 'NEXT_EVENT' AND src IN (FROM seeds)),
around AS (SELECT DISTINCT dst AS chunk_id FROM (FROM one UNION ALL SELECT dst FROM edges WHERE type = 'NEXT_EVENT' AND src IN (FROM one) UNION ALL SELECT dst FROM edges WHERE type <> 'NEXT_EVENT' AND src IN (FROM seeds)) WHERE dst NOT IN (FROM seeds))"""


@query(f"{_EXPAND_SQL} SELECT chunk_id FROM around")
def expand_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir)
    return graph.expand(graph.build_compact(rows)[1], _seeds(spark, sf_dir), 2, members=rows)


@query(f"""{_EXPAND_SQL} SELECT chunk_id, text, keyframe_path, length(text)::DOUBLE AS s_total FROM talk WHERE chunk_id IN (FROM seeds)
UNION ALL SELECT chunk_id, text, keyframe_path, 0.0::DOUBLE FROM talk WHERE chunk_id IN (FROM around)""")
def graph_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir)
    known, edges = graph.build_compact(rows)
    found = rows.filter("ord = 1").select("chunk_id", "text", "keyframe_path", F.char_length("text").cast("double").alias("s_total"))
    return graph.with_neighbours(found, edges, known, 2).select("chunk_id", "text", "keyframe_path", "s_total")


# Chunking -----------------------------------------------------------------------------------------------------------


def _scenes(rows: DataFrame, seconds: float, gap: float = 0.0) -> DataFrame:
    """Scenes of equal length over each video, with a gap before each next one."""
    last = rows.groupBy("vid_hash").agg(F.floor(F.max("start") / seconds).cast("int").alias("n"))
    s = last.select("vid_hash", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("scene_index"))
    return s.select("vid_hash", "scene_index", (F.col("scene_index") * seconds).alias("start_sec"), ((F.col("scene_index") + 1) * seconds - gap).alias("end_sec"))


@query(f"""WITH {CLICKS}, last AS (SELECT vid_hash, floor(max(start_s) / 21600)::INT AS n FROM clicks GROUP BY vid_hash),
scenes AS (SELECT vid_hash, i AS scene, i * 21600.0::DOUBLE AS a, (i + 1) * 21600.0::DOUBLE - 600 AS b FROM (SELECT vid_hash, unnest(range(n + 1)) AS i FROM last)),
ends AS (SELECT vid_hash, max(b) AS b, max(scene) AS scene FROM scenes GROUP BY vid_hash)
SELECT c.chunk_id, coalesce(min(s.scene), CASE WHEN any_value(c.start_s) >= any_value(e.b) THEN any_value(e.scene) END, 0)::INT AS scene_index
FROM clicks c LEFT JOIN scenes s ON s.vid_hash = c.vid_hash AND c.start_s >= s.a AND c.start_s < s.b JOIN ends e ON e.vid_hash = c.vid_hash GROUP BY c.chunk_id""")
def scene_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clicks(spark, sf_dir)
    return chunking.scene_at(rows, _scenes(rows, 21600.0, 600.0), F.col("start"), ["vid_hash", "chunk_id"]).select("chunk_id", "scene_index")


@query("""SELECT user_id::VARCHAR AS vid_hash, event_type AS scene_index, min_by(event_id || '.jpg', event_id) AS keyframe_path FROM events GROUP BY ALL""")
def scene_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clicks(spark, sf_dir).select("vid_hash", F.col("event_type").alias("scene_index"), "ord", F.concat("chunk_id", F.lit(".jpg")).alias("keyframe_path"))
    return chunking.scene_keyframes(rows)


@query("""SELECT doc_id AS chunk_id, round(coalesce(list_sum(embedding::DOUBLE[]), 0.0::DOUBLE), 4) AS total, coalesce(len(embedding), 64)::INT AS dim FROM labels LEFT JOIN embeddings ON vec_id = doc_id""")
def image_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("image_dense"))
    rows = chunking.align_images(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")), images, 64)
    return rows.select("chunk_id", F.round(vectors.total(vectors.doubles(F.col("image_dense"))), 4).alias("total"), F.size("image_dense").alias("dim"))


_WORDS_SQL = """words AS (SELECT conv_id, turn, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))"""


@query(f"""WITH {_WORDS_SQL}, n AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.!?…]+') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence_no FROM words)
SELECT conv_id, turn, sentence_no, string_agg(trim(word), ' ' ORDER BY i) FILTER (trim(word) <> '') AS text, min(i) * 0.5::DOUBLE AS "start", max(i) * 0.5::DOUBLE + 0.4::DOUBLE AS "end" FROM n GROUP BY ALL HAVING text <> ''""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("i", "word"))
    w = w.withColumns({"start": F.col("i") * 0.5, "end": F.col("i") * 0.5 + 0.4})
    return chunking.sentences(w, ["conv_id", "turn"])


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of conversations: a turn takes five seconds and a sentence every second of it; scenes last 12 s."""
    s = sentence_split(spark, sf_dir)
    start = F.col("turn") * 20.0 + F.col("sentence_no") * 2.0
    return s.select(F.col("conv_id").cast("string").alias("vid_hash"), (F.col("turn") * 10000 + F.col("sentence_no")).alias("ord"), F.trim("text").alias("text"), start.alias("start"), (start + 1.5).alias("end"))


_SPOKEN_SQL = f"""{_WORDS_SQL}, n AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.!?…]+') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS k FROM words),
s0 AS (SELECT conv_id, turn, k, string_agg(trim(word), ' ' ORDER BY i) FILTER (trim(word) <> '') AS text FROM n GROUP BY ALL HAVING text <> ''),
s1 AS (SELECT conv_id::VARCHAR AS vid, turn * 10000 + k AS ord, trim(text) AS text, turn * 20.0::DOUBLE + k * 2.0::DOUBLE AS a, turn * 20.0::DOUBLE + k * 2.0::DOUBLE + 1.5::DOUBLE AS b FROM s0),
s2 AS (SELECT *, floor(a / 13)::INT AS f, least(floor((b - 1e-6::DOUBLE) / 13)::INT, floor(max(a) OVER (PARTITION BY vid) / 13)::INT) AS l, row_number() OVER (PARTITION BY vid ORDER BY a, ord) AS r FROM s1 WHERE text <> ''),
fold AS (
  SELECT vid, r, ord, text, a, b, f, l, f <> l AS crosses, 1 AS no, CASE WHEN f <> l THEN 0 ELSE length(text) END AS chars, CASE WHEN f <> l THEN NULL ELSE a END AS since, CASE WHEN f <> l THEN NULL ELSE f END AS scene FROM s2 WHERE r = 1
  UNION ALL
  SELECT s.vid, s.r, s.ord, s.text, s.a, s.b, s.f, s.l, s.f <> s.l,
    CASE WHEN s.f <> s.l OR p.scene IS NULL OR s.f <> p.scene OR p.chars + length(s.text) > 400 OR s.a - p.since > 15 THEN p.no + 1 ELSE p.no END,
    CASE WHEN s.f <> s.l THEN 0 WHEN p.scene IS NULL OR s.f <> p.scene OR p.chars + length(s.text) > 400 OR s.a - p.since > 15 THEN length(s.text) ELSE p.chars + length(s.text) END,
    CASE WHEN s.f <> s.l THEN NULL WHEN p.scene IS NULL OR s.f <> p.scene OR p.chars + length(s.text) > 400 OR s.a - p.since > 15 THEN s.a ELSE p.since END,
    CASE WHEN s.f <> s.l THEN NULL ELSE s.f END
  FROM fold p JOIN s2 s ON s.vid = p.vid AND s.r = p.r + 1)"""
_CUT_SQL = """cut AS (SELECT *, (f + 1) * 13.0::DOUBLE AS e, least(greatest(1, floor(length(text) * ((f + 1) * 13.0::DOUBLE - a) / (b - a))::INT), greatest(length(text) - 1, 1)) AS at_ FROM fold WHERE crosses)"""


@query(f"""WITH RECURSIVE {_SPOKEN_SQL}, {_CUT_SQL}
SELECT vid AS vid_hash, no AS chunk_no, 0 AS part, string_agg(text, ' ' ORDER BY a, ord) AS text, round(min(a), 3) AS "start", round(max_by(b, r), 3) AS "end", min(f) AS scene_index, count(*) AS sentence_count, 1 AS weight FROM fold WHERE NOT crosses GROUP BY vid, no
UNION ALL SELECT vid, no, 1, CASE WHEN trim(substr(text, 1, at_)) = '' THEN text ELSE trim(substr(text, 1, at_)) END, round(a, 3), round(e, 3), f, 1, 2 FROM cut
UNION ALL SELECT vid, no, 2, CASE WHEN trim(substr(text, at_ + 1)) = '' THEN text ELSE trim(substr(text, at_ + 1)) END, round(e, 3), round(b, 3), l, 1, 0 FROM cut""")
def adaptive_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spoken(spark, sf_dir)
    out = chunking.chunks(rows, _scenes(rows, 13.0))
    return out.select("vid_hash", "chunk_no", "part", "text", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "scene_index", F.col("sentence_count").cast("long").alias("sentence_count"), "weight")


@query("""WITH t AS (SELECT *, least(greatest(1, floor(length(text) * 0.3::DOUBLE)::INT), greatest(length(text) - 1, 1)) AS p FROM conversations)
SELECT conv_id, turn, CASE WHEN trim(substr(text, 1, p)) = '' THEN trim(text) ELSE trim(substr(text, 1, p)) END AS part_a, CASE WHEN trim(substr(text, p + 1)) = '' THEN trim(text) ELSE trim(substr(text, p + 1)) END AS part_b FROM t""")
def cross_scene_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = chunking.split_at(F.col("text"), F.lit(0.0), F.lit(10.0), F.lit(3.0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", a.alias("part_a"), b.alias("part_b"))


# Payloads, frames and sound -----------------------------------------------------------------------------------------


@query("""SELECT d.doc_id::VARCHAR AS chunk_id, md5(text) AS text_md5, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, 'unknown') AS domain, lang AS category, 'pending' AS commit_status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def payload_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("vid_hash"), "text", F.col("lang").alias("category"))
    meta = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vid_hash"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("domain"))
    out = commits.payload(d, meta)
    return out.select("chunk_id", F.md5("text").alias("text_md5"), "domain", "category", "commit_status")


@query("SELECT event_id, event_type IN ('view', 'purchase') OR value > 60 AS keep FROM events")
def info_frame_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = signals.informative(F.array("event_type"), F.col("value"), ("view", "purchase"), 60.0)
    return table(spark, sf_dir, "events").select("event_id", keep.alias("keep"))


@query("""WITH r AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding[1:64], lambda x: x::DOUBLE * x::DOUBLE)) / 64 + 1e-12::DOUBLE) AS r, list_max(list_transform(embedding[1:64], lambda x: abs(x::DOUBLE))) AS peak FROM embeddings)
SELECT vec_id, round(r, 6) AS rms, r < 0.12::DOUBLE AS skipped, CASE WHEN r < 0.12::DOUBLE THEN 'rms_below_epsilon' END AS reason, round(peak, 6) AS peak FROM r""")
def rms_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 64).alias("samples"))
    peak = F.array_max(F.transform(vectors.doubles(F.col("samples")), F.abs))
    return signals.rms_gate(rows, "samples", 0.12).select("vec_id", F.round("rms", 6).alias("rms"), "skipped", "reason", F.round(peak, 6).alias("peak"))


@query("""SELECT vec_id, round(list_sum(list_transform(list_zip(embedding[1:32], embedding[33:60]), lambda p: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, p[1]::DOUBLE - p[2]::DOUBLE))) [1:28]), 5) AS total FROM embeddings""")
def residual_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = vectors.residual(F.slice("embedding", 1, 32), F.slice("embedding", 33, 28))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.total(left), 5).alias("total"))


TAGS = ["speech", "music", "applause", "engine", "rain", "crowd", "silence", "laughter"]


@query(f"""WITH e AS (SELECT vec_id, generate_subscripts(embedding[1:8], 1) AS i, exp(5 * unnest(embedding[1:8])::DOUBLE) AS x FROM embeddings),
p AS (SELECT vec_id, i, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS n FROM p)
SELECT vec_id, string_agg({TAGS!r}[i] || '=' || round(p, 4)::DECIMAL(5, 4)::VARCHAR, ',' ORDER BY n) AS tags FROM r WHERE n <= 3 GROUP BY vec_id""")
def audio_tags_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform(vectors.doubles(F.slice("embedding", 1, 8)), lambda x: x * 5)
    tags = F.transform(signals.top_tags(logits, TAGS), lambda t: F.concat(t["label"], F.lit("="), t["score"].cast("decimal(5,4)").cast("string")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(tags, ",").alias("tags"))


# Selection ----------------------------------------------------------------------------------------------------------


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("query_id"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("turn").alias("ord"), "text", F.round(F.char_length("text") % 97 + F.col("turn") / 1000, 3).alias("score"),
        (F.col("turn") % 3 == 0).alias("is_cross_scene_subchunk"), F.col("turn").cast("double").alias("start_sec"),
    )


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) * CASE WHEN turn % 3 = 0 THEN 2 ELSE 1 END AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY round(length(text) % 97 + turn / 1000.0::DOUBLE, 3) DESC, conv_id || ':' || turn) AS r FROM conversations),
f AS (SELECT conv_id, turn, r, cost <= 1600 AS taken, CASE WHEN cost <= 1600 THEN cost ELSE 0 END AS used FROM c WHERE r = 1
  UNION ALL SELECT c.conv_id, c.turn, c.r, f.used + c.cost <= 1600, CASE WHEN f.used + c.cost <= 1600 THEN f.used + c.cost ELSE f.used END FROM f JOIN c ON c.conv_id = f.conv_id AND c.r = f.r + 1)
SELECT conv_id AS query_id, conv_id || ':' || turn AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY r) - 1 AS score_rank, row_number() OVER (PARTITION BY conv_id ORDER BY turn, r) - 1 AS time_rank FROM f WHERE taken""")
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.greedy_pack(_candidates(spark, sf_dir), 400).select("query_id", "chunk_id", F.col("score_rank").cast("long").alias("score_rank"), F.col("time_rank").cast("long").alias("time_rank"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    weight = F.when(F.col("event_type").isin("click", "purchase"), 2).otherwise(1)
    return e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("item_id"), F.col("event_id").alias("ord"), weight.alias("weight"), (F.round("value", 2) - 5 + F.col("event_id") / 1e7).alias("value"))


_ITEMS_SQL = """i AS (SELECT user_id AS q, event_id AS id, CASE WHEN event_type IN ('click', 'purchase') THEN 2 ELSE 1 END AS w, round(value, 2) - 5 + event_id / 1e7 AS v FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY q, w ORDER BY v DESC, id) AS n FROM i WHERE v > 0),
k AS (SELECT q, j, coalesce((SELECT sum(v) FROM r WHERE r.q = u.q AND w = 2 AND n <= j), 0) + coalesce((SELECT sum(v) FROM r WHERE r.q = u.q AND w = 1 AND n <= 4 - 2 * j), 0) AS v FROM (SELECT DISTINCT q FROM i) u, (VALUES (0), (1), (2)) AS t(j)),
b AS (SELECT q, max(v) AS v, min_by(j, -v) AS j FROM k GROUP BY q)"""


@query(f"WITH {_ITEMS_SQL} SELECT q AS query_id, round(v, 4)::DOUBLE AS total_value FROM b")
def knapsack_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.knapsack(_items(spark, sf_dir)).select("query_id", F.round("total_value", 4).alias("total_value"))


@query(f"WITH {_ITEMS_SQL} SELECT q AS query_id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER ((w = 2 AND n <= j) OR (w = 1 AND n <= 4 - 2 * j)), '') AS item_ids FROM b LEFT JOIN r USING (q) GROUP BY q".replace("b LEFT JOIN r USING (q)", "b LEFT JOIN (SELECT q, id, w, n FROM r) r USING (q)"))
def knapsack_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.knapsack(_items(spark, sf_dir)).select("query_id", F.array_join("item_ids", ",").alias("item_ids"))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS have, list_distinct(regexp_extract_all(lower(first_value(text) OVER (PARTITION BY conv_id ORDER BY turn)), '[a-z0-9]+')) AS want FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(want) > 0 THEN len(list_intersect(have, want)) / len(want) ELSE 0 END::DOUBLE, 6) AS rerank_score FROM t""")
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("query", F.first("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return search.lexical_rerank(c).select("conv_id", "turn", F.round("rerank_score", 6).cast("double").alias("rerank_score"))


@query("""SELECT conv_id AS query_id, md5(string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn)) AS context_md5 FROM conversations WHERE text <> '' GROUP BY conv_id""")
def context_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "query_id")
    return selection.context(rows, "turn", "\n---\n").select("query_id", F.md5("context").alias("context_md5"))


# Evaluation ---------------------------------------------------------------------------------------------------------

_SCORES_SQL = "s AS (SELECT event_id, 1 / (1 + exp(-(value - 20) / 20)) AS a, 1 / (1 + exp(-(event_id % 50 - 20) / 10.0::DOUBLE)) AS b, 1 / (1 + exp(-(user_id % 30 - 10) / 8.0::DOUBLE)) AS c FROM events)"
_VERDICT_SQL = "CASE WHEN least(a, b) > 0.7::DOUBLE AND c > 0.7::DOUBLE THEN 'pass' WHEN least(a, b, c) < 0.4::DOUBLE THEN 'fail' ELSE 'deep_queue' END"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vectors.sigmoid
    e = table(spark, sf_dir, "events")
    return e.select("event_id", s((F.col("value") - 20) / 20).alias("score_relevance"), s((F.col("event_id") % 50 - 20) / F.lit(10.0)).alias("score_ground"), s((F.col("user_id") % 30 - 10) / F.lit(8.0)).alias("score_answer_relevance"))


@query(f"WITH {_SCORES_SQL} SELECT event_id, round(a, 4) AS score_relevance, round(b, 4) AS score_ground, round(c, 4) AS score_answer_relevance, {_VERDICT_SQL} AS verdict FROM s")
def verdict_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.tier1(_scores(spark, sf_dir))


@query(f"WITH {_SCORES_SQL}, v AS (SELECT {_VERDICT_SQL} AS v FROM s) SELECT count(*) FILTER (v = 'pass') AS pass, count(*) FILTER (v = 'fail') AS fail, count(*) FILTER (v = 'deep_queue') AS deep_queue FROM v")
def verdict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.verdict_counts(evaluation.tier1(_scores(spark, sf_dir)))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'no score' ELSE 'Fine. [RESULT]  ' || (event_id % 6) || ' end' END AS reply FROM events), s AS (SELECT event_id, coalesce(try_cast(regexp_extract(reply, '\\[RESULT\\]\\s*(\\d)', 1) AS INT), 1) AS score FROM r)
SELECT event_id, score, CASE WHEN score >= 4 THEN 'pass' ELSE 'fail' END AS tier2_verdict FROM s""")
def judge_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("event_id") % 3 == 0, "no score").otherwise(F.concat(F.lit("Fine. [RESULT]  "), (F.col("event_id") % 6).cast("string"), F.lit(" end")))
    score = text.judge_score(reply)
    return table(spark, sf_dir, "events").select("event_id", score.alias("score"), F.when(score >= 4, "pass").otherwise("fail").alias("tier2_verdict"))


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    results = c.filter("turn = 0").select(F.concat(F.lit("\t"), "text").alias("query"), "conv_id")
    answers = c.filter("turn = 1").select("conv_id", F.col("text").alias("answer"))
    kf = lambda k: F.concat(F.lit("kf"), ((F.col("conv_id") + k) % 4).cast("string"))
    results = results.join(answers, "conv_id", "left").select("query", "answer", F.array(F.lit(None).cast("string"), kf(0), kf(1), kf(2)).alias("keyframes"))
    truth = c.filter("turn = 0").select(F.col("conv_id").alias("ord"), F.concat(F.lit("  "), "text").alias("query"), F.concat(F.lit("kf"), (F.col("conv_id") % 3).cast("string")).alias("expected_keyframe"), F.col("text").alias("expected_answer"))
    return results, truth


@query(r"""WITH n AS (SELECT conv_id, turn, text, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k FROM conversations),
q AS (SELECT * FROM n WHERE turn = 0), a AS (SELECT conv_id, k FROM n WHERE turn = 1),
t AS (SELECT k, max(conv_id) AS id FROM q GROUP BY k),
m AS (SELECT q.conv_id, t.id, list_position(['kf' || (q.conv_id % 4), 'kf' || ((q.conv_id + 1) % 4), 'kf' || ((q.conv_id + 2) % 4)], 'kf' || (t.id % 3)) AS p,
  list_distinct(list_filter(string_split(q.k, ' '), lambda x: x <> '')) AS want, list_distinct(list_filter(string_split(coalesce(a.k, ''), ' '), lambda x: x <> '')) AS got FROM q JOIN t USING (k) LEFT JOIN a ON a.conv_id = q.conv_id)
SELECT count(*) AS matched_queries, (SELECT count(*) FROM q) AS total_ground_truth, round(avg(CASE WHEN coalesce(p, 0) > 0 THEN 1 ELSE 0 END::DOUBLE), 4) AS keyframe_hit_rate,
  round(avg(CASE WHEN coalesce(p, 0) > 0 THEN 1.0::DOUBLE / p ELSE 0 END), 4) AS mean_reciprocal_rank, round(avg(len(list_intersect(got, want)) / len(want)), 4) AS mean_answer_overlap FROM m""")
def gt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ground_truth_metrics(*_results(spark, sf_dir))


@query(f"""WITH {_SPACES_SQL}, s AS (SELECT query_id, point_id, coalesce(max(1.0::DOUBLE / (60 + rank)) FILTER (space = 0), 0) AS a, coalesce(max(1.0::DOUBLE / (60 + rank)) FILTER (space = 1), 0) AS b, coalesce(max(1.0::DOUBLE / (60 + rank)) FILTER (space = 2), 0) AS c FROM spaces GROUP BY ALL),
g AS (SELECT round(i * 0.1::DOUBLE, 3) AS alpha, round(j * 0.1::DOUBLE, 3) AS beta FROM range(11) t(i), range(11) u(j) WHERE i + j <= 10),
r AS (SELECT alpha, beta, query_id, point_id, row_number() OVER (PARTITION BY alpha, beta, query_id ORDER BY round(alpha * a + beta * b + greatest(0.0::DOUBLE, 1 - alpha - beta) * c, 10) DESC, point_id) AS n FROM s, g),
h AS (SELECT alpha, beta, query_id, min(n) AS n FROM r JOIN embeddings p ON p.vec_id = point_id JOIN embeddings q ON q.vec_id = query_id WHERE p.label = q.label GROUP BY ALL)
SELECT alpha, beta, round(avg(coalesce(1.0::DOUBLE / n, 0)), 5) AS mean_mrr FROM (SELECT alpha, beta, vec_id AS query_id FROM g, embeddings WHERE vec_id % {ASKED_EVERY} = 0) LEFT JOIN h USING (alpha, beta, query_id) GROUP BY ALL""")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.ranked_spaces(hits(spark, sf_dir)).join(points(spark, sf_dir).select("point_id", F.col("domain").alias("key")), "point_id")
    targets = asked(spark, sf_dir).select("query_id", F.col("domain").alias("expected"))
    return evaluation.grid_mrr(found, targets, evaluation.grid(spark))


@query(f"WITH m AS ({SQL['grid_search']}) SELECT alpha, beta, mean_mrr, round(greatest(0.0::DOUBLE, 1 - alpha - beta), 3) AS gamma FROM m ORDER BY mean_mrr DESC, alpha, beta LIMIT 1")
def grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_weights(grid_search(spark, sf_dir))


@query("SELECT conv_id, turn FROM conversations ORDER BY md5('42:' || conv_id || ':' || turn), conv_id || ':' || turn LIMIT (SELECT greatest(1, floor(count(*) * 0.1::DOUBLE)::BIGINT) FROM conversations)")
def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("id"))
    return evaluation.exact_sample(rows, "id", 0.1).select("conv_id", "turn")


# State, commits, identity -------------------------------------------------------------------------------------------

_LATEST_SQL = """l AS (SELECT user_id, event_id % 3 AS phase, max_by(CASE event_type WHEN 'purchase' THEN 'committed' WHEN 'error' THEN 'failed' ELSE 'processing' END, event_id) AS status, max(event_id) AS updated FROM events GROUP BY ALL)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "committed").when(F.col("event_type") == "error", "failed").otherwise("processing")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("vid_hash"), (F.col("event_id") % 3).cast("int").alias("phase"), status.alias("status"), F.col("event_id").alias("updated_at"), F.lit(None).cast("string").alias("error_message"))


@query(f"WITH {_LATEST_SQL} SELECT user_id::VARCHAR AS vid_hash, phase::INT AS phase, CASE WHEN status = 'committed' THEN status ELSE 'failed' END AS status, CASE WHEN status <> 'committed' THEN 'rolled_back_by_resume_phase' END AS error_message FROM l")
def tracker_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.resumed(tracker.latest(_log(spark, sf_dir))).select("vid_hash", "phase", "status", "error_message")


@query(f"WITH {_LATEST_SQL} SELECT user_id::VARCHAR AS vid_hash, status, row_number() OVER (ORDER BY updated) AS place FROM l WHERE phase = 1 AND status <> 'committed'")
def tracker_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracker.incomplete(tracker.latest(_log(spark, sf_dir)), 1)
    # As many rows as videos that are not finished.
    return rows.withColumn("place", F.row_number().over(Window.orderBy("updated_at"))).select("vid_hash", "status", "place")


@query("""WITH p AS (SELECT event_id, user_id, event_id % 4 AS attempt FROM events), c AS (SELECT user_id, max(event_id % 4) AS attempt FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT event_id AS point_id, CASE WHEN c.attempt IS NOT NULL THEN 'committed' ELSE 'pending' END AS commit_status, NOT coalesce(c.attempt IS NOT NULL OR p.attempt > l.attempt, TRUE) AS purge
FROM p LEFT JOIN c USING (user_id, attempt) LEFT JOIN (SELECT user_id, attempt FROM c) l USING (user_id)""")
def commit_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), F.col("user_id").alias("vid_hash"), (F.col("event_id") % 4).alias("attempt"), "event_type")
    done = e.filter("event_type = 'purchase'").select("vid_hash", "attempt").distinct()
    return commits.with_status(e, done).select("point_id", "commit_status", "purge")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("o_orderkey"))
    return tracker.not_done(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("""SELECT doc_id, md5(text || '|SIZE=' || strlen(text) || '|DUR=' || printf('%.3f', n_chars / 15.0::DOUBLE) || '|') AS vid_hash FROM documents WHERE strlen(text) > 0""")
def vid_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("text").cast("binary")
    named = media.content_id(content, F.octet_length(content).cast("long"), F.col("n_chars") / 15.0)
    return table(spark, sf_dir, "documents").select("doc_id", named.alias("vid_hash")).filter("vid_hash IS NOT NULL")


@query("""WITH r AS (SELECT doc_id, lang, n_chars, NULL::INT AS quality, source, text, NULL::INT AS toxic FROM documents UNION ALL SELECT doc_id, NULL, NULL, quality, NULL, NULL, toxic FROM labels),
n AS (SELECT count(doc_id) AS a, count(lang) AS b, count(n_chars) AS c, count(quality) AS d, count(source) AS e, count(text) AS f, count(toxic) AS g FROM r)
SELECT unnest(range(7)) AS place, unnest(['doc_id', 'lang', 'n_chars', 'quality', 'source', 'text', 'toxic']) AS column_name, unnest([a, b, c, d, e, f, g]) AS filled FROM n""")
def export_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.sinks import csv_columns

    both = table(spark, sf_dir, "documents").unionByName(table(spark, sf_dir, "labels"), allowMissingColumns=True)
    report = csv_columns(both)
    filled = report.agg(*[F.count(c).alias(c) for c in report.columns])
    return filled.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in report.columns])).alias("place", "x")).select(F.col("place").cast("long").alias("place"), "x.*")


# Items, provenance, judged answers -----------------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id AS query_id, turn AS ord, conv_id || ':' || turn AS chunk_id, conv_id || '|' || role AS parent, role = 'user' AS pair, text, role || '.jpg' AS path, CASE WHEN turn % 2 = 0 THEN length(text)::DOUBLE END AS s FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, pair, CASE WHEN pair THEN parent ELSE chunk_id || '|' || ord END ORDER BY ord) AS n FROM c),
p AS (SELECT conv_id || '|user' AS parent, text AS other, 'other.jpg' AS second FROM conversations WHERE turn = 1)
SELECT query_id, CASE WHEN pair THEN f.parent ELSE chunk_id END AS item_id, ord, CASE WHEN pair THEN 2 ELSE 1 END::INT AS weight, coalesce(s, 1.0::DOUBLE) AS value, md5(trim(concat_ws(' ', text, other))) AS text_md5, concat_ws(',', path, second) AS keyframe_paths
FROM f LEFT JOIN p ON pair AND f.parent = p.parent WHERE n = 1""")
def knapsack_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("ord"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.concat_ws("|", "conv_id", "role").alias("parent_chunk_id"), (F.col("role") == "user").alias("is_cross_scene_subchunk"), "text",
        F.concat("role", F.lit(".jpg")).alias("keyframe_path"), F.when(F.col("turn") % 2 == 0, F.char_length("text").cast("double")).alias("rerank_score"), F.lit(1.0).alias("s_total"),
    )
    partners = c.filter("turn = 1").select(F.concat("conv_id", F.lit("|user")).alias("parent_chunk_id"), "text", F.lit("other.jpg").alias("keyframe_path"))
    out = selection.knapsack_items(rows, partners)
    return out.select("query_id", "item_id", "ord", "weight", "value", F.md5("text").alias("text_md5"), F.array_join("keyframe_paths", ",").alias("keyframe_paths"))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that the knapsack takes, each event lasting a second."""
    items = _items(spark, sf_dir)
    picks = selection.knapsack(items).select("query_id", F.explode(F.col("item_ids").cast("array<bigint>")).alias("item_id"))
    at = F.col("item_id").cast("double")
    own = items.select("query_id", "item_id", "weight", F.round("value", 2).alias("value"), at.alias("start_sec"), (at + 1).alias("end_sec"), F.concat("item_id", F.lit(".jpg")).alias("keyframe_path"))
    return own.join(picks, ["query_id", "item_id"])


_TAKEN = "b JOIN (SELECT q, id, w, n, v FROM r) r USING (q) WHERE (w = 2 AND n <= j) OR (w = 1 AND n <= 4 - 2 * j)"


@query(f"WITH {_ITEMS_SQL} SELECT q AS query_id, id AS chunk_id, id + 0.5::DOUBLE AS timestamp, id || '.jpg' AS keyframe_path, w::INT AS weight_used FROM {_TAKEN}")
def trake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.trake(_selected(spark, sf_dir)).drop("knapsack_value")


@query(f"WITH {_ITEMS_SQL} SELECT q AS query_id, sum(w)::BIGINT AS slots_used FROM {_TAKEN} GROUP BY q")
def slots_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).groupBy("query_id").agg(F.sum("weight").alias("slots_used"))


@query("SELECT conv_id AS query_id, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5 FROM conversations WHERE text <> '' GROUP BY conv_id")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "query_id")
    return selection.context(rows, "turn", " ").select("query_id", F.md5("context").alias("text_md5"))


_WORDS_OF = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g')), ' '), lambda x: x <> ''))"
_RECALL = "CASE WHEN len({1}) > 0 THEN len(list_intersect({0}, {1})) / len({1}) ELSE 0 END::DOUBLE"
_TRIAD_SQL = f"""t AS (SELECT conv_id, max(text) FILTER (turn = 0) AS q, max(text) FILTER (turn = 1) AS c, max(text) FILTER (turn = 2) AS a FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, q, {_WORDS_OF.format("q")} AS wq, {_WORDS_OF.format("c")} AS wc, {_WORDS_OF.format("a")} AS wa FROM t),
s AS (SELECT conv_id, q, {_RECALL.format("wc", "wq")} AS a, {_RECALL.format("wc", "wa")} AS b, {_RECALL.format("wa", "wq")} AS c FROM w)"""
_JUDGE_SQL = "greatest(1, least(5, floor((a + b + c) / 3 * 5)::INT + 1))"


def _asked_and_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turn(0).alias("query"), turn(1).alias("context"), turn(2).alias("answer"))


@query(f"WITH {_TRIAD_SQL} SELECT conv_id, round(a, 6) AS score_relevance, round(b, 6) AS score_ground, round(c, 6) AS score_answer_relevance, {_JUDGE_SQL}::INT AS tier2_score FROM s")
def triad_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.triad(_asked_and_answered(spark, sf_dir))
    scores = [F.round(c, 6).alias(c) for c in ("score_relevance", "score_ground", "score_answer_relevance")]
    return rows.select("conv_id", *scores, models.judge().alias("tier2_score"))


@query(f"""WITH {_SCORES_SQL}, d AS (SELECT round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c FROM s WHERE {_VERDICT_SQL} = 'deep_queue'), j AS (SELECT {_JUDGE_SQL} AS score FROM d)
SELECT count(*) AS judged, count(*) FILTER (score >= 4) AS passed, count(*) FILTER (score < 4) AS failed FROM j""")
def tier2_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.tier2_counts(evaluation.tier2(evaluation.tier1(_scores(spark, sf_dir)), models.judge()))


@query(f"WITH {_TRIAD_SQL} SELECT md5(q) AS query_md5, round(a, 4) AS score_relevance, round(b, 4) AS score_ground, round(c, 4) AS score_answer_relevance, {_VERDICT_SQL} AS verdict FROM s WHERE q IS NOT NULL")
def eval_queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue is logged twice and drained after each: the second run takes only what is new."""
    top = staging.scratch(spark, "queue")
    rows = _asked_and_answered(spark, sf_dir).filter("query IS NOT NULL")
    for half in (0, 1):
        sinks.append_jsonl(rows.filter(F.col("conv_id") % 2 == half).select("query", "context", "answer"), f"{top}/queue")
        queues.evaluate_queue(spark, f"{top}/queue", f"{top}/report", f"{top}/checkpoint")
    return spark.read.parquet(f"{top}/report").select(F.md5("query").alias("query_md5"), "score_relevance", "score_ground", "score_answer_relevance", "verdict")


_DEEP_SQL = f"WITH {_TRIAD_SQL}, d AS (SELECT q, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c FROM s WHERE q IS NOT NULL AND NOT (least(a, b) > 0.7 AND c > 0.7))"


def _evaluated(spark: SparkSession, sf_dir: str, times: int) -> Engine:
    engine = Engine(spark, staging.scratch(spark, "evaluated"))
    engine.log(_asked_and_answered(spark, sf_dir).filter("query IS NOT NULL"))
    for _ in range(times):
        engine.evaluate_queue(1.0, low=0.0)  # whatever does not pass is borderline: few of these rows lie between the usual thresholds
    return engine


@query(f"{_DEEP_SQL} SELECT md5(q) AS query_md5, {_JUDGE_SQL}::INT AS tier2_score, CASE WHEN {_JUDGE_SQL} >= 4 THEN 'pass' ELSE 'fail' END AS tier2_verdict FROM d")
def deep_queue_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the judge says of the rows that the first tier passed on."""
    rows = _evaluated(spark, sf_dir, 1).read("reports/tier2")
    return rows.select(F.md5("query").alias("query_md5"), "tier2_score", "tier2_verdict")


@query(f"""{_DEEP_SQL} SELECT 'reports/tier1' AS name, count(*) AS n_rows FROM s WHERE q IS NOT NULL
UNION ALL SELECT 'deep_queue', count(*) FROM d UNION ALL SELECT 'reports/tier2', count(*) FROM d""")
def evaluate_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both reports and of the deep queue after a second run over the same queue: as many as after one."""
    engine = _evaluated(spark, sf_dir, 2)
    count = lambda rows, name: rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"))
    deep = spark.read.schema("query string").json(engine.path("deep_queue"))
    both = count(engine.read("reports/tier1"), "reports/tier1").unionByName(count(engine.read("reports/tier2"), "reports/tier2"))
    return both.unionByName(count(deep, "deep_queue"))


# Names, thresholds, committed points -----------------------------------------------------------------------------------


@query(f"""WITH {TALK}, m AS (SELECT chunk_id, scene, (start_s + end_s) / 2 AS mid, CASE WHEN ord % 3 > 0 THEN (ord % 3 * 10)::DOUBLE ELSE 25.0::DOUBLE END AS fps FROM talk)
SELECT chunk_id, round(mid, 3) AS timestamp, printf('scene_%04d_f%d.jpg', scene, floor(mid * fps)::INT) AS keyframe FROM m""")
def keyframe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid, frame = media.mid_frame(F.col("start"), F.col("end"), F.col("ord") % 3 * 10)
    return talk(spark, sf_dir).select("chunk_id", F.round(mid, 3).alias("timestamp"), media.keyframe_name(F.col("scene_index"), frame).alias("keyframe"))


@query("""SELECT event_id, CASE WHEN event_id % 101 / 100.0::DOUBLE >= 0.55::DOUBLE THEN 'verified' WHEN event_id % 101 / 100.0::DOUBLE >= 0.3::DOUBLE THEN 'partial' ELSE 'unsupported' END AS certificate,
  CASE WHEN value < 20 THEN 0.45::DOUBLE ELSE 0.6::DOUBLE END AS ocr_threshold FROM events""")
def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    certified = media.certificate(F.col("event_id") % 101 / F.lit(100.0))
    threshold = media.ocr_threshold(F.col("value"), F.lit(20.0), F.lit(0.45), F.lit(0.6))
    return table(spark, sf_dir, "events").select("event_id", certified.alias("certificate"), threshold.alias("ocr_threshold"))


@query("""WITH c AS (SELECT user_id, max(event_id % 4) AS attempt FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id AS vid_hash, count(*) AS n_points FROM events JOIN c USING (user_id) WHERE event_id % 4 = attempt GROUP BY user_id""")
def committed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("vid_hash"), (F.col("event_id") % 4).alias("attempt"), "event_type")
    return commits.committed_counts(e, e.filter("event_type = 'purchase'").select("vid_hash", "attempt"))


@query("""WITH p AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak FROM embeddings),
n AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN peak > 0 THEN x::DOUBLE / peak ELSE x::DOUBLE END) AS v FROM p)
SELECT vec_id, round(list_sum(v), 4) AS total, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS peak FROM n""")
def peak_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors.peak_normalize(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.total(v), 4).alias("total"), F.round(F.array_max(F.transform(v, F.abs)), 6).alias("peak"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
