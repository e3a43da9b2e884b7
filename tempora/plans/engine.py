"""The engine: ingest, search, evaluate and tune over tables in one folder.

points/ (append-only), postings/ (their terms in shards), codes/ and model/ (the dense index, once it is built), commits/ (the
manifest), nodes/, edges/, tracker/, queue/ and reports/ lie below the root.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import terms
from ..operators import ann, chunking, evaluation, graph, impact, models, search, selection
from ..sources import readers
from ..sources.sinks import append_jsonl
from ..sources.staging import stage
from ..streaming import queues
from . import commits
from .tracker import Tracker, not_done

TOP_K = search.TOP_K
#: Columns of the evaluation reports.
TIER1 = f"{readers.LOGGED}, {queues.JUDGED}"
TIER2 = f"{TIER1}, tier2_score int, tier2_verdict string"
#: What the dense index keeps of a point beside its code.
INDEXED = ("point_id", "vid_hash", "attempt", "domain")
PHASES = {0: (), 1: (0,), 2: (0, 1), 3: (), 4: ()}


def phase_plan(run_phase: str | None, query: str | None = None) -> list[int]:
    """Phases in order: all of ingestion, one with what it needs, or search where there is only a query."""
    if run_phase is None:
        return [3] if query else []
    if run_phase == "all":
        return [0, 1, 2]
    phase = int(run_phase)
    return [*PHASES[phase], phase]


@dataclass
class Engine:
    spark: SparkSession
    root: str
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @property
    def tracker(self) -> Tracker:
        return Tracker(self.spark, self.path("tracker"))

    def ingest(self, spoken: DataFrame, scenes: DataFrame, keyframes: DataFrame, meta: DataFrame, attempt: int | None = None, build_graph: bool = True, images: DataFrame | None = None, image_encoder=None, text_encoder=models.HashingEncoder) -> DataFrame:
        """Chunk, encode and publish the videos of `spoken`; returns the number of visible points of each.

        Videos that the tracker has as committed are left out unless an attempt is named. A video without any chunk is marked as failed
        and does not hold up the others. images: vid_hash, keyframe_path, image_dense, a row a keyframe; without them an image_encoder
        (see `models`) makes them; a chunk without one has no image vector. One caller ingests at a time.
        """
        return self.publish(self.chunk(spoken, scenes, keyframes, attempt is not None), meta, attempt, build_graph, images, image_encoder, text_encoder)

    def chunk(self, spoken: DataFrame, scenes: DataFrame, keyframes: DataFrame, again: bool = False) -> DataFrame:
        """Phases 0 and 1: find out what is left to do, and chunk it."""
        done = self.tracker.states().filter((F.col("phase") == 2) & (F.col("status") == "committed"))
        left = spoken if again else not_done(spoken, done, "vid_hash")
        videos = left.select("vid_hash").distinct()
        self.tracker.mark_all(videos, 1, "processing")
        chunking.chunks(left, scenes, keyframes).write.mode("overwrite").parquet(self.path("chunks"))
        chunks = self.read("chunks")
        made = chunks.select("vid_hash").distinct()
        self.tracker.mark_all(made, 1, "committed")
        self.tracker.mark_all(not_done(videos, made, "vid_hash"), 1, "failed", "no chunks")
        return chunks

    def publish(self, chunks: DataFrame, meta: DataFrame, attempt: int | None = None, build_graph: bool = True, images: DataFrame | None = None, image_encoder=None, text_encoder=models.HashingEncoder) -> DataFrame:
        """Phase 2: points and graph of the chunks are appended under a new attempt, then committed at once.

        A video of which an encoder fails on a text or an image is marked as failed with the reason, and its chunks that failed go
        to dead_letters/; the other videos are committed. The next ingestion tries failed videos again.
        """
        self.tracker.mark_all(chunks.select("vid_hash").distinct(), 2, "processing")
        rows = commits.payload(chunks, meta).withColumn("_image_error", F.lit(None).cast("string"))
        if images is None and image_encoder is not None:
            images = models.encode(chunking.with_keyframe(rows).select("vid_hash", "keyframe_path").distinct(), "keyframe_path", "image_dense", image_encoder, "_image_error")
        if images is None:
            rows = rows.withColumn("image_dense", F.lit(None).cast("array<float>"))
        else:
            failed = F.col("_image_error") if "_image_error" in images.columns else F.lit(None).cast("string").alias("_image_error")
            own = images.select("vid_hash", "keyframe_path", F.col("image_dense").cast("array<float>").alias("image_dense"), failed)
            rows = rows.drop("_image_error").join(own, ["vid_hash", "keyframe_path"], "left")
        number = commits.claim(self.spark, self.path("attempts"), max(attempt or 0, self.next_attempt()))
        rows = commits.point_id(models.encode(rows, "text", "text_dense", text_encoder, "_text_error")).withColumn("attempt", F.lit(number))
        rows = stage(rows.withColumn("_error", F.coalesce("_text_error", "_image_error")).drop("_text_error", "_image_error"), "encoded")
        lost = rows.filter("_error IS NOT NULL")
        failed = lost.groupBy("vid_hash").agg(F.min_by("_error", F.struct("start", "chunk_id")).alias("error_message"))
        if not failed.isEmpty():
            letters = lost.select("vid_hash", "chunk_id", "attempt", "text", "keyframe_path", F.col("_error").alias("error"), F.current_timestamp().alias("failed_at"))
            letters.write.mode("append").parquet(self.path("dead_letters"))
            self.tracker.mark_all(failed, 2, "failed")
            rows = rows.join(failed.select("vid_hash"), "vid_hash", "left_anti")
        rows = rows.drop("_error")
        videos = rows.select("vid_hash").distinct()
        if videos.isEmpty():
            return self.spark.createDataFrame([], "vid_hash string, n_points long")
        commits.write_points(rows, self.path("points"))
        # What follows reads what was written, so that nothing is encoded twice.
        own = self.points().filter(F.col("attempt") == number)
        self.add_postings(own)
        model = self.model()
        if model is not None:
            ann.append(ann.encode(own.select(*INDEXED, "text_dense"), "text_dense", model), self.path("codes"))
        if build_graph:
            known, edges = graph.build_compact(own.withColumn("ord", F.col("chunk_no") * 3 + F.col("part")))
            ends = known.select(F.col("chunk_id").alias("src"), "vid_hash")
            known.withColumn("attempt", F.lit(number)).write.mode("append").parquet(self.path("nodes"))
            edges.join(ends, "src").withColumn("attempt", F.lit(number)).write.mode("append").parquet(self.path("edges"))
        commits.commit(self.path("commits"), own.select("vid_hash", "attempt").distinct())
        self.tracker.mark_all(videos, 2, "committed")
        return commits.committed_counts(self.points(), self.read("commits"))

    def next_attempt(self) -> int:
        """Above every attempt that has left points or a commit, so that what a lost writer left is never seen.

        Several writers may be told the same number; `commits.claim` gives it to one of them.
        """
        found = 0
        for name in ("points", "commits"):
            try:
                found = max(found, self.read(name).agg(F.max("attempt")).first()[0] or 0)
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return found + 1

    def add_postings(self, rows: DataFrame) -> None:
        """Terms of points, in shards of one video each, so that a commit shows or hides them with the video's points."""
        own = rows.select("domain", "vid_hash", "attempt", F.col("point_id").alias("id"), terms(F.col("text")).alias("terms"))
        made = impact.shards(own.sort("domain", "vid_hash", "attempt", "id"), ("domain", "vid_hash", "attempt"))
        made.write.option("maxRecordsPerFile", impact.FILE_SHARDS).mode("append").partitionBy("domain").parquet(self.path("postings"))

    def model(self) -> ann.Model | None:
        """The dense index's model; None where no index was built."""
        try:
            return ann.Model.load(self.spark, self.path("model"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def build_index(self) -> ann.Model:
        """Fit the dense index on a sample of what is visible and code all points; later ones are coded as they are published.

        Building again replaces the codes first and then the model; until then a search may miss neighbours, but none are wrong.
        """
        model = ann.train(self.visible(), "text_dense")
        codes = ann.encode(self.points().select(*INDEXED, "text_dense"), "text_dense", model)
        codes.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(self.path("codes"))
        model.save(self.spark, self.path("model"))
        return model

    def keyword_hits(self, own: DataFrame, conditions: dict[str, str], queries: DataFrame, k: int) -> DataFrame:
        """Hits by terms. Where the conditions are on whole videos the stored postings answer; else the matching texts are cut into terms."""
        asked = search.postings(queries, "query_id", "query")
        if set(conditions) <= {"domain", "vid_hash"}:
            return search.sparse_topk(search.matching(commits.visible(self.read("postings"), self.read("commits")), conditions), asked, k)
        docs = own.select(F.col("point_id").alias("id"), terms(F.col("text")).alias("terms"))
        return search.sparse_topk(docs, asked, k)

    def semantic_hits(self, own: DataFrame, conditions: dict[str, str], asked: DataFrame, k: int, approximate: bool) -> DataFrame:
        model = self.model() if approximate else None
        if model is None:
            return search.dense_topk(own, asked, "text_dense", k)
        codes = commits.visible(self.read("codes"), self.read("commits"))
        whole = set(conditions) <= {"domain", "vid_hash"}
        codes = search.matching(codes, conditions) if whole else codes.join(own.select("point_id"), "point_id", "left_semi")
        return ann.ann_topk(codes, model, own, asked, "text_dense", k)

    def points(self) -> DataFrame:
        # Points of earlier versions have no image_dense.
        return self.spark.read.option("mergeSchema", True).parquet(self.path("points"))

    def graph(self, name: str) -> DataFrame:
        """Nodes or edges of each video's last commit; a video's graph is appended with its points, others stay as they are."""
        # Nodes of earlier versions have no ord; their edges within scenes are stored.
        rows = self.spark.read.option("mergeSchema", True).parquet(self.path(name))
        return commits.visible(rows, self.read("commits")).drop("attempt", "commit_status")

    def visible(self) -> DataFrame:
        return commits.visible(self.points(), self.read("commits"))

    def search(self, queries: DataFrame, domain: str, filter_meta: str | None = None, k: int = search.TOP_K, flags: list[str] | None = None, use_graph: bool = False, hop_limit: object = 2, approximate: bool = False) -> DataFrame:
        """Fused candidates of each query. queries: query_id, query, and image_dense where images are to be searched.

        A query's image vector is given, since it must lie in the space of the points' own; rows without one are not searched there.
        `approximate` asks the dense index, where one was built.
        """
        alpha, beta = self.weights.get(domain, (search.DEFAULT_ALPHA, search.DEFAULT_BETA))
        conditions = search.parse_filter(filter_meta) | {"domain": domain}
        own = search.matching(self.visible(), conditions)
        asked = models.encode(queries, "query", "text_dense")
        spaces = {"semantic": self.semantic_hits(own, conditions, asked, k, approximate), "keyword": self.keyword_hits(own, conditions, queries, k)}
        if "image_dense" in queries.columns and "image_dense" in own.columns:
            seen = F.col("image_dense").isNotNull()
            spaces["visual"] = search.dense_topk(own.filter(seen), queries.filter(seen), "image_dense", k)
        fused = search.fuse(search.active_spaces(spaces, flags), alpha, beta)
        found = fused.join(own.select("point_id", "chunk_id", "parent_chunk_id", "is_cross_scene_subchunk", "text", "keyframe_path", F.col("start").alias("start_sec"), F.col("end").alias("end_sec"), "scene_index"), "point_id")
        if not use_graph:
            return found
        return graph.with_neighbours(found, self.graph("edges"), self.graph("nodes"), hop_limit)

    def best(self, found: DataFrame, k: int) -> DataFrame:
        """The k best of each query's rows, in order: as reranked, or as fused with neighbours in the graph last."""
        return search.final_top(found, k).orderBy("query_id", "final_rank")

    def rerank(self, candidates: DataFrame, queries: DataFrame, tokens: int = selection.TOKENS) -> DataFrame:
        scored = search.lexical_rerank(candidates.join(queries, "query_id")).withColumn("score", F.col("rerank_score"))
        return selection.greedy_pack(scored, tokens)

    def answer(self, candidates: DataFrame, max_images: int = selection.SLOTS) -> DataFrame:
        """query_id, answer, total_value, item_ids: the chosen context and the default generator's answer."""
        rows = candidates.withColumn("ord", F.row_number().over(search.Window.partitionBy("query_id").orderBy(F.desc("s_total"), "chunk_id")))
        rows = rows if "rerank_score" in rows.columns else rows.withColumn("rerank_score", F.lit(None).cast("double"))
        items = selection.knapsack_items(rows)
        chosen = selection.knapsack(items, max_images)
        picked = items.join(chosen.select("query_id", F.explode("item_ids").alias("item_id")), ["query_id", "item_id"])
        used = picked.groupBy("query_id").agg(F.sum("weight").alias("slots_used"))
        return chosen.join(used, "query_id", "left").withColumn("slots_used", F.coalesce("slots_used", F.lit(0))).join(models.answer(picked), "query_id", "left")

    def provenance(self, candidates: DataFrame, chosen: DataFrame) -> DataFrame:
        """query_id, trake: the chosen items' chunk, time and image, in order of value."""
        rows = candidates if "rerank_score" in candidates.columns else candidates.withColumn("rerank_score", F.lit(None).cast("double"))
        pair = F.coalesce(F.col("parent_chunk_id") != "", F.lit(False)) & F.coalesce("is_cross_scene_subchunk", F.lit(False))
        rows = rows.withColumn("item_id", F.when(pair, F.col("parent_chunk_id")).otherwise(F.col("chunk_id")))
        rows = rows.withColumns({"weight": F.when(pair, 2).otherwise(1), "value": F.coalesce("rerank_score", "s_total", F.lit(0.0))})
        first = search.Window.partitionBy("query_id", "item_id").orderBy("start_sec", "chunk_id")
        rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
        picked = rows.join(chosen.select("query_id", F.explode("item_ids").alias("item_id")), ["query_id", "item_id"])
        told = selection.trake(picked)
        item = F.struct((-F.col("knapsack_value")).alias("order"), F.struct(*[c for c in told.columns if c != "query_id"]).alias("x"))
        return told.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]).alias("trake"))

    def components(self, queries: DataFrame, domain: str, k: int = TOP_K) -> DataFrame:
        """query_id, point_id, key, space, rrf of every searched space, retrieved once for all weights; the key is the keyframe."""
        conditions = {"domain": domain}
        own = search.matching(self.visible(), conditions)
        asked = models.encode(queries, "query", "text_dense")
        spaces = {"semantic": self.semantic_hits(own, conditions, asked, k, False), "keyword": self.keyword_hits(own, conditions, queries, k)}
        return search.ranked_spaces(spaces).join(own.select("point_id", F.col("keyframe_path").alias("key")), "point_id")

    def ground_truth(self, results: DataFrame, truth: DataFrame) -> DataFrame:
        return evaluation.ground_truth_metrics(results, truth)

    def log(self, rows: DataFrame) -> None:
        """Queue query, context and answer for evaluation, and the keyframes where rows have them."""
        append_jsonl(rows.select("query", "context", "answer", *(["keyframes"] if "keyframes" in rows.columns else [])), self.path("queue"))

    def evaluate_queue(self, rate: float = 0.1, low: float = evaluation.LOW, high: float = evaluation.HIGH) -> tuple[DataFrame, DataFrame]:
        """Judge what is new in the queue, then what is new in the deep queue; the rows of this run of either report.

        Both queues are streams with checkpoints of their own below the root, so that no run takes a row twice.
        """
        at = self.path
        if not self.has("queue"):
            return self._batches("reports/tier1", TIER1, []), self._batches("reports/tier2", TIER2, [])
        first = queues.judge_queue(self.spark, at("queue"), at("reports/tier1"), at("deep_queue"), at("checkpoints/queue"), rate, low, high)
        second = queues.drain_deep_queue(self.spark, at("deep_queue"), at("reports/tier2"), at("checkpoints/deep_queue")) if first or self.has("deep_queue") else []
        return self._batches("reports/tier1", TIER1, first), self._batches("reports/tier2", TIER2, second)

    def _batches(self, name: str, schema: str, numbers: list[int]) -> DataFrame:
        paths = [f"{self.path(name)}/batch={n}" for n in numbers]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def has(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def evaluate(self, rows: DataFrame, rate: float = 0.1, low: float = evaluation.LOW, high: float = evaluation.HIGH) -> tuple[DataFrame, DataFrame]:
        """Judged rows of an exact sample: all with their verdict, and the borderline ones with the judge's."""
        sample = evaluation.exact_sample(rows.withColumn("_id", F.md5(F.concat_ws("|", "query", "answer"))), "_id", rate).drop("_id")
        first = evaluation.tier1(models.triad(sample), low, high)
        return first, evaluation.tier2(first, models.judge())

    def tune(self, parts: DataFrame, targets: DataFrame, step: float = evaluation.STEP):
        """The best weights over the grid; retrieval is done once, in parts."""
        parts = parts.persist()
        try:
            best = evaluation.best_weights(evaluation.grid_mrr(parts, targets, evaluation.grid(self.spark, step))).collect()
        finally:
            parts.unpersist()
        return self.spark.createDataFrame(best, "alpha double, beta double, mean_mrr double, gamma double")
