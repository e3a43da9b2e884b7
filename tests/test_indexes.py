"""The indexes against exact answers: dense cells, postings by impact, and the chunker on long timelines."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora import queries as own
from tempora.functions import vectors
from tempora.operators import ann, chunking, dense, impact, search
from tempora.plans.engine import Engine
from tempora.sources import staging

SPOKEN = "vid_hash string, ord long, text string, start double, end double"


# Dense ------------------------------------------------------------------------------------------------------------------


def clustered(n: int, dim: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(40, dim))[rng.integers(40, size=n)] + 0.5 * rng.normal(size=(n, dim))


def points_of(spark, rows, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v], i % 3) for i, v in enumerate(rows)], "point_id long, v array<float>, part int")


def exact(spark, p, q, k=20):
    return search.dense_topk(p, q, "v", k)


@pytest.fixture(scope="module")
def indexed(spark):
    p = points_of(spark, clustered(6000, 16, 1)).cache()
    model = ann.fit(np.array([r.v for r in p.limit(3000).collect()]), 24)
    return p, model


def asked_of(p):
    return p.filter("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "v")


def test_recall_of_the_index_and_of_points_that_come_later(spark, indexed, tmp_path):
    p, model = indexed
    assert 1 < model.probes < 24
    path = f"file://{tmp_path}/codes"
    ann.append(ann.encode(p.select("point_id", "v"), "v", model), path)
    more = points_of(spark, clustered(2000, 16, 2), 100_000)
    ann.append(ann.encode(more.select("point_id", "v"), "v", model), path)
    both, q = p.unionByName(more), asked_of(p.unionByName(more))
    got = ann.ann_topk(spark.read.parquet(path), model, both, q, "v")
    assert ann.recall(got, exact(spark, both, q)) >= 0.95
    assert got.filter("point_id >= 100000").count() > 0 and got.filter("query_id = point_id").isEmpty()
    assert got.groupBy("query_id").count().filter("count <> 20").isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scores_are_exact(spark, indexed):
    p, model = indexed
    codes, q = ann.encode(p.select("point_id", "v"), "v", model), asked_of(p)
    got = {(r.query_id, r.point_id): r.score for r in ann.ann_topk(codes, model, p, q, "v").collect()}
    want = {(r.query_id, r.point_id): r.score for r in exact(spark, p, q, 200).collect()}
    assert got and all(want[k] == s for k, s in got.items() if k in want)


def test_too_few_points_in_the_probed_cells_are_answered_exactly(spark, indexed):
    p, model = indexed
    few = p.filter("point_id < 60 AND part = 0")
    codes, q = ann.encode(few.select("point_id", "v"), "v", model), asked_of(p).limit(10)
    got, want = ann.ann_topk(codes, model, few, q, "v"), exact(spark, few, q)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() >= 190


def test_shards_and_blocks_of_a_hot_cell_change_nothing(spark, indexed, monkeypatch):
    p, model = indexed
    codes, q = ann.encode(p.select("point_id", "v"), "v", model), asked_of(p)
    whole = sorted(map(tuple, ann.ann_topk(codes, model, p, q, "v").collect()))
    for name, value in (("SHARD_ROWS", 37), ("BLOCK_QUERIES", 5), ("CHUNK", 3)):
        monkeypatch.setattr(ann, name, value)
    assert sorted(map(tuple, ann.ann_topk(codes, model, p, q, "v").collect())) == whole


def test_index_of_odd_vectors(spark, tmp_path):
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(50)] + [(90, [0.0, 0.0, 0.0]), (91, None), (92, [0.0, 1.0, 0.0])]
    p = spark.createDataFrame(rows, "point_id long, v array<float>")
    model = ann.train(p, "v", 5)
    model.save(spark, f"file://{tmp_path}/model")
    again = ann.Model.load(spark, f"file://{tmp_path}/model")
    assert np.array_equal(again.cells, model.cells) and np.array_equal(again.books, model.books) and again.probes == model.probes
    codes = ann.encode(p, "v", again)
    assert codes.count() == 52
    q = p.select(F.col("point_id").alias("query_id"), "v")
    got = ann.ann_topk(codes, again, p, q, "v", 5)
    assert ann.recall(got, exact(spark, p.filter("v IS NOT NULL"), q.filter("v IS NOT NULL"), 5)) >= 0.9 and got.filter("query_id = 91 OR point_id = 91").isEmpty()
    assert ann.ann_topk(codes.limit(0), again, p.limit(0), q, "v", 5).count() == 0
    with pytest.raises(ValueError, match="points"):
        ann.train(p.limit(0), "v")


def test_dense_passes_are_staged(spark, monkeypatch):
    p = points_of(spark, clustered(300, 8, 3))
    q = asked_of(p)
    want = sorted(map(tuple, exact(spark, p, q, 3).collect()))
    monkeypatch.setattr(search, "QUERIES_PER_PASS", 8)
    got = exact(spark, p, q, 3)
    assert sorted(map(tuple, got.collect())) == want and "Union" not in got._jdf.queryExecution().executedPlan().toString()


def pairwise(p, q, k):
    """Dense search as a join of all pairs."""
    own = p.select("point_id", vectors.l2_normalize(F.col("v")).alias("v"))
    pairs = own.join(q.select("query_id", vectors.l2_normalize(F.col("v")).alias("q")), F.col("point_id") != F.col("query_id"))
    return search.top(pairs.select("query_id", "point_id", (F.round(vectors.dot(F.col("v"), F.col("q")), 6) + 0.0).alias("score")), k)


@pytest.mark.parametrize("name", [False, True])
def test_dense_search_equals_all_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(dense, "CHUNK", 50)
    monkeypatch.setattr(dense, "BLOCK", 7)
    rng = random.Random(5)
    rows = [[float(rng.randint(-1, 2)) for _ in range(4)] for _ in range(400)] + [[0.0, 1.0, 1.0, 0.0]] * 200
    rows += [None] * 60 + [[0.0] * 4, [1.0, float("nan"), 0.0, 1.0], [1.0, None, 0.0, 1.0], [1.0, 2.0], [], [1e-9, 0.0, 0.0, 0.0]]
    order = list(range(len(rows)))
    rng.shuffle(order)
    p = spark.createDataFrame([(i, rows[i]) for i in [*order, 40, 41]] + [(None, [1.0] * 4)], "point_id long, v array<float>")
    if name:
        p = p.withColumn("point_id", F.concat(F.lit("é"), F.col("point_id").cast("string")))
    some = F.regexp_replace(F.col("point_id").cast("string"), "é", "").cast("long")
    q = p.filter((some % 20 == 0) | (some >= 600)).select(F.col("point_id").alias("query_id"), "v")
    key = lambda r: (str(r.query_id), r["rank"])
    for k in (3, 30):
        got, want = (sorted(f(p, q, k).select("query_id", "point_id", "score", "rank").collect(), key=key) for f in (lambda *a: exact(spark, *a), pairwise))
        assert list(map(repr, got)) == list(map(repr, want))
    assert exact(spark, p.limit(0), q).count() == 0 and exact(spark, p, q.limit(0)).count() == 0


def test_dense_search_looks_at_few_pairs(monkeypatch):
    """After the first chunk a pair costs a comparison: what is sorted stays near k rows a query, also where many points are equal."""
    rng, added = np.random.default_rng(3), []
    points, asked = rng.normal(size=(20_000, 8)), rng.normal(size=(64, 8))
    points[::3] = points[0]
    pa_lists = lambda m: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * 8, m.ravel())
    held = dense.Asked(pa.array(-1 - np.arange(64)), pa.array(-1 - np.arange(64)), pa_lists(asked))
    add = dense.Best.add
    monkeypatch.setattr(dense.Best, "add", lambda self, query, score, ids: (added.append(len(query)), add(self, query, score, ids)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(20_000)), pa_lists(points)], ["point_id", "v"])
    out = list(dense._search(SimpleNamespace(value=held), 5, (pa.int64(), pa.int64()))([batch]))
    assert sum(b.num_rows for b in out) == 64 * 5 and sum(added) < 64 * 20_000 / 20


def test_registered_index_query(spark):
    sf = "/root/testdata/sf0.01"
    got, want = own.queries()["ann_topk"](spark, sf), own.queries()["dense_topk"](spark, sf)
    assert got.count() == want.count() and ann.recall(got, want) >= 0.95


# Postings ---------------------------------------------------------------------------------------------------------------


def test_files_hold_few_shards(spark, monkeypatch):
    """Spark reads thousands of rows of a file at once, and a shard is a row of megabytes."""
    monkeypatch.setattr(impact, "FILE_SHARDS", 2)
    staged = []
    monkeypatch.setattr(search, "stage", lambda *a: staged.append(staging.stage(*a)) or staged[-1])
    docs = spark.range(6).coalesce(1).select("id", F.concat(F.lit("x"), "id", F.expr("repeat(' the', 100000)")).alias("text"))
    got = search.bm25_topk(docs, search.postings(spark.createDataFrame([(7, "x3")], "item_id long, text string"), "item_id", "text"), 2)
    assert [r.point_id for r in got.collect()] == [3] and staged[0].count() == 6
    assert all(spark.read.parquet(f).count() <= 2 for f in staged[0].inputFiles())


def texts(seed: int, n: int = 300) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    rows = [(i, " ".join(["the"] + [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(rng.randrange(0, 60))])) for i in range(n)]
    return [*rows, (n, ""), (n + 1, None), (n + 2, "the " * 3000), (n + 3, rows[0][1])]


def brute_inner(docs: list, asked: list, k: int) -> list:
    from collections import Counter

    own_counts, out = {i: Counter((t or "").split()) for i, t in docs}, []
    for q, t in asked:
        want = Counter((t or "").split())
        scored = [(sum(n * c[w] for w, n in want.items()), i) for i, c in own_counts.items() if i != q]
        best = sorted((-s, i) for s, i in scored if s > 0)[:k]
        out += [(q, i, float(-s), r + 1) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("limit", [7, 100_000])
def test_postings_by_impact_find_what_a_full_scan_finds(spark, limit):
    rows = texts(4)
    docs = spark.createDataFrame(rows, "id long, text string").select("id", F.filter(F.split("text", " "), lambda w: w != "").alias("terms"))
    asked = [r for r in rows if r[0] % 20 == 0]
    q = search.postings(spark.createDataFrame(asked, "id long, text string"), "id", "text")
    got = search.sparse_topk(impact.shards(docs, limit=limit), q, 7)
    assert sorted((r.query_id, r.point_id, r.score, r["rank"]) for r in got.collect()) == brute_inner(rows, asked, 7)


def test_passes_of_queries_change_nothing(spark, monkeypatch):
    rows = texts(5)
    docs = spark.createDataFrame(rows, "id long, text string")
    q = search.postings(docs.filter("id % 20 = 0"), "id", "text")
    want = sorted(map(tuple, search.bm25_topk(docs, q, 5).collect()))
    monkeypatch.setattr(impact, "PASS_QUERIES", 4)
    assert sorted(map(tuple, search.bm25_topk(docs, q, 5).collect())) == want and want


def test_a_task_sends_no_more_than_k_a_query(spark):
    rows = texts(6, 2000)
    docs = spark.createDataFrame(rows, "id long, text string").select("id", F.split("text", " ").alias("terms"))
    q = spark.createDataFrame([(-1, "the", 1.0), (-2, "w1", 2.0)], "id long, term string, weight double")
    found = impact.topk(staging.stage(impact.shards(docs.repartition(3), limit=50), "shards").repartition(3), q, 4)
    assert found.count() <= 3 * 4 * 2
    assert [(r.query_id, r.score) for r in search.top(found, 1).orderBy("query_id").collect()][-1] == (-1, 3000.0)


def test_queries_without_known_terms_find_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    q = spark.createDataFrame([(7, "zz", 1.0)], "id long, term string, weight double")
    assert search.bm25_topk(docs, q).count() == 0 and search.bm25_topk(docs.limit(0), q).count() == 0 and search.bm25_topk(docs, q.limit(0)).count() == 0


def test_engine_answers_by_stored_postings_and_codes(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e")
    spoken = spark.createDataFrame([(v, i, f"{w} number {i}", i * 20.0, i * 20.0 + 4) for v, w in (("v", "goal"), ("u", "rice")) for i in range(12)], SPOKEN)
    scenes = spark.createDataFrame([("v", 0, 0.0, 900.0), ("u", 0, 0.0, 900.0)], "vid_hash string, scene_index int, start_sec double, end_sec double")
    frames = spark.createDataFrame([], "vid_hash string, scene_index int, ord int, keyframe_path string")
    meta = spark.createDataFrame([("v", "d"), ("u", "d")], "vid_hash string, domain string")
    engine.ingest(spoken, scenes, frames, meta)
    assert engine.model() is None
    engine.build_index()
    engine.ingest(spoken.filter("vid_hash = 'v'"), scenes, frames, meta, attempt=2)  # a later attempt hides the first one's points everywhere
    q = spark.createDataFrame([("q", "goal number 3")], "query_id string, query string")
    rows = lambda **more: sorted((r.point_id, r.s_total) for r in engine.search(q, "d", **more).collect())
    assert rows() == rows(approximate=True) and len(rows()) >= 20
    only = engine.search(q, "d", filter_meta="vid_hash=u", approximate=True)
    assert only.count() == 12 and only.filter("text LIKE 'goal%'").isEmpty()
    narrow = engine.search(q, "d", filter_meta="sentence_count=1", approximate=True)
    assert narrow.count() == len(rows())
    assert "text" not in engine.read("postings").columns
    points = engine.read("postings").filter("attempt = 2")
    assert points.select("vid_hash").distinct().collect()[0][0] == "v"


# Chunks -----------------------------------------------------------------------------------------------------------------


def loop(rows: list, max_chars: int, max_seconds: float) -> list[tuple]:
    """vid, ord, chunk_no of placed sentences, by one walk through each video."""
    out, state = [], {}
    for vid, ord_, start, _, text, a, b in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        no, chars, since, scene = state.get(vid, (0, 0, None, None))
        if a != b:
            no, chars, since, scene = no + 1, 0, None, None
        elif scene != a or chars + len(text) > max_chars or start - since > max_seconds:
            no, chars, since, scene = no + 1, len(text), start, a
        else:
            chars += len(text)
        state[vid] = (no, chars, since, scene)
        out.append((vid, ord_, no))
    return sorted(out)


PLACED = "vid_hash string, ord long, start double, end double, text string, first_scene int, last_scene int"


@pytest.mark.parametrize(("max_chars", "block_rows", "scenes"), [(12, 1, 1), (40, 7, 1), (40, 64, 9), (400, 512, 3)])
def test_chunks_of_blocks_are_those_of_one_walk(spark, max_chars, block_rows, scenes):
    rng = random.Random(max_chars + block_rows)
    rows = []
    for v in range(4):
        t = 0.0
        for i in range(rng.choice([1, 3, 300, 700])):
            t += rng.choice([0.0, 0.1, 0.3, 2.0, 5.1, 16.0])
            scene = int(t // 200) % scenes
            rows.append((f"v{v}", i, t, t + 1, "x" * rng.choice([1, 1, 2, 5, max_chars, max_chars + 9]), scene, scene + (rng.random() < 0.03)))
    got = chunking.chunk_numbers(spark.createDataFrame(rows, PLACED), max_chars, 15.0, block_rows)
    assert sorted((r.vid_hash, r.ord, r.chunk_no) for r in got.collect()) == loop(rows, max_chars, 15.0)


def test_one_long_scene_is_entered_by_doubling(spark):
    """Ways into blocks that never meet: only composing them tells where chunks open."""
    rows = [("v", i, float(i) * 5.0, float(i) * 5.0 + 1, "xx", 0, 0) for i in range(1000)]  # four sentences a chunk, blocks of thirteen
    got = chunking.chunk_numbers(spark.createDataFrame(rows, PLACED), 12, 15.0, 13)
    assert sorted((r.vid_hash, r.ord, r.chunk_no) for r in got.collect()) == loop(rows, 12, 15.0)


def test_no_sentences_no_chunks(spark):
    assert chunking.chunk_numbers(spark.createDataFrame([], PLACED)).count() == 0


def test_time_limits_are_differences(spark):
    """20.1 - 5.1 is above 15 in floats, though 5.1 + 15 is 20.1."""
    rows = [("v", 0, 5.1, 6.0, "a", 0, 0), ("v", 1, 20.1, 21.0, "b", 0, 0), ("w", 0, 5.0, 6.0, "a", 0, 0), ("w", 1, 20.0, 21.0, "b", 0, 0)]
    got = chunking.chunk_numbers(spark.createDataFrame(rows, PLACED))
    assert sorted((r.vid_hash, r.ord, r.chunk_no) for r in got.collect()) == loop(rows, 400, 15.0) == [("v", 0, 1), ("v", 1, 2), ("w", 0, 1), ("w", 1, 1)]


# Graph ------------------------------------------------------------------------------------------------------------------


def test_scenes_as_members_give_the_edges_between_their_chunks(spark):
    from tempora.operators import graph

    rng = random.Random(8)
    rows = [(f"c{i}", f"v{i % 3}", float(i), float(i) + 1, rng.choice([-1, 0, 1, 2]), rng.randrange(12), None, "t", f"k{i}", "d") for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, vid_hash string, start double, end double, scene_index int, ord int, parent_chunk_id string, text string, keyframe_path string, domain string")
    edges = graph.same_scene_edges(chunks)
    known, compact = graph.build_compact(chunks)
    seeds = chunks.filter("ord < 6")
    for both in (False, True):
        want = sorted(map(tuple, graph.hop_once(edges, seeds, "SAME_SCENE", both).collect()))
        assert sorted(map(tuple, graph.hop_scene(known, seeds, both).collect())) == want and want
    assert graph.scene_edge_count(known).first().n_edges == edges.count()
    full = graph.build(chunks)[1]
    a = graph.expand(full, seeds.limit(3), 2)
    assert sorted(map(tuple, graph.expand(compact, seeds.limit(3), 2, members=known).collect())) == sorted(map(tuple, a.collect()))
    assert compact.count() < 60 and graph.scene_edge_count(known.limit(0)).count() == 0


# Many queries of few terms ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("itself", [False, True])
def test_many_queries_of_few_terms_are_multiplied(monkeypatch, itself):
    """Every query looked at each shard by itself, which took a task queries times shards passes over all documents of a shard."""
    monkeypatch.setattr(impact, "_search_shard", None)
    monkeypatch.setattr(dense, "BLOCK", 32)
    monkeypatch.setattr(dense, "CHUNK", 50)
    rng = np.random.default_rng(3)
    n, terms, k = 300, 40, 7
    weights = np.round(rng.random((n, terms)), 1) * (rng.random((n, terms)) < 0.1)
    weights[: n // 3] = weights[n // 3 : 2 * (n // 3)]  # ties
    weights[0, 0], weights[1, 0] = 1e-25, 1e-25  # far below single precision once multiplied
    lists = [np.flatnonzero(w) for w in weights]
    made = impact._pack(pa.array(range(n)), pa.array(lists), pa.array([w[at] for w, at in zip(weights, lists, strict=True)]))
    columns = {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for c, v in made.items()}
    queries = [(q, lists[q], weights[q][lists[q]]) for q in range(0, n, 3)]
    asked = impact.Asked(pa.array(range(terms)), queries, np.ones(terms))
    out = list(impact._search(SimpleNamespace(value=asked), k, itself, ("int64", "int64"))(iter([pa.RecordBatch.from_pydict(columns)])))
    found = {}
    for b in out:
        for q, p, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            found.setdefault(q, []).append((-s, p))
    products = weights @ weights.T
    for q, _, _ in queries:
        rows = [(-round(products[q, p], 6) + 0.0, p) for p in range(n) if products[q, p] > 0 and (itself or p != q)]
        want = sorted(rows)[:k]
        got = sorted(found.get(q, []))
        assert [p for _, p in got] == [p for _, p in want]
        assert np.allclose([s for s, _ in got], [s for s, _ in want])


def test_dense_search_scores_vectors_of_any_length(monkeypatch):
    """Products in single precision lose no point, whatever the vectors' lengths, and scores are those in double."""
    rng = np.random.default_rng(4)
    for scale in (1.0, 300.0, 1e25):
        points, asked = rng.normal(size=(500, 32)) * scale, rng.normal(size=(40, 32)) * scale
        points[100:200] = points[:100] * (1 + 1e-9)
        block, best = dense.Block(np.arange(40), np.arange(40), asked, 32), dense.Best(40, 10)
        for lo in range(0, 500, 100):
            dense.add_scored(best, block, points[lo : lo + 100], np.arange(lo, lo + 100), np.full(100, -1))
        query, score, ids = best.held
        products = dense.rounded(asked @ points.T)
        for q in range(40):
            want = sorted((-products[q, p], p) for p in range(500))[:10]
            assert np.allclose(score[query == q], [-s for s, _ in want], rtol=1e-12)
            if scale == 1.0:
                assert ids[query == q].tolist() == [p for _, p in want]
