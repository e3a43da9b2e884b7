"""Logged answers through both queues, by the engine and by the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import evaluation
from tempora.plans import cli
from tempora.plans.engine import Engine

from .test_operators import _match


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "query string, context string, answer string")


BORDERLINE = ("a b c d", "a b x x", "a b c")


def test_both_queues_are_drained_once(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e")
    count = lambda: tuple(x.count() for x in engine.evaluate_queue(1.0))
    assert count() == (0, 0)  # no queue yet
    engine.log(_rows(spark, ("a b", "a b c", "a b"), ("q", "none", "x"), BORDERLINE))
    assert count() == (3, 1)
    assert count() == (0, 0)
    engine.log(_rows(spark, BORDERLINE, ("z", "z", "z")).withColumn("keyframes", F.array(F.lit("k.jpg"))))
    first, second = engine.evaluate_queue(1.0)
    assert sorted(r.verdict for r in first.collect()) == ["deep_queue", "pass"] and [r.keyframes for r in second.collect()] == [["k.jpg"]]
    assert engine.read("reports/tier1").count() == 5 and engine.read("reports/tier2").count() == 2
    assert {r.tier2_verdict for r in engine.read("reports/tier2").collect()} <= {"pass", "fail"}


def test_a_batch_that_is_run_again_replaces_its_rows(spark, tmp_path):
    """A run is lost after its reports are written and before its checkpoint is."""
    engine = Engine(spark, f"file://{tmp_path}/e")
    engine.log(_rows(spark, BORDERLINE, ("z", "z", "z")))
    engine.evaluate_queue(1.0)
    for name in (tmp_path / "e" / "checkpoints" / "queue" / "commits").iterdir():
        name.unlink()
    first, _ = engine.evaluate_queue(1.0)
    assert first.count() == 2 and engine.read("reports/tier1").count() == 2


def test_ground_truth_finds_the_keyframes_of_logged_answers(spark, tmp_path, capsys):
    root, given = f"file://{tmp_path}/e", f"file://{tmp_path}/in"
    for name, rows in zip(("spoken", "scenes", "keyframes", "meta"), _match(spark, 3), strict=True):
        rows.write.parquet(f"{given}/{name}")
    told = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert cli.main(["--root", root, "--run_phase", "all", "--input_dir", given]) == 0
    told()
    assert cli.main(["--root", root, "--query", "goal", "--domain", "sport", "-tr"]) == 0
    (answer,) = told()
    shown = [t["keyframe_path"] for t in answer["trake"]]
    truth = [{"query": "Goal", "expected_keyframe": shown[1], "expected_answer": answer["answer"]}, {"query": "never asked", "expected_keyframe": "x", "expected_answer": "x"}]
    (tmp_path / "truth.json").write_text(json.dumps(truth))
    evaluate = ["--root", root, "--run_phase", "4", "--eval_sample_rate", "1", "--ground_truth_path", f"file://{tmp_path}/truth.json"]
    assert cli.main(evaluate) == 0
    tier1, _, figures = told()
    assert sum(tier1.values()) == 1 and figures["matched_queries"] == 1 and figures["total_ground_truth"] == 2
    assert figures["keyframe_hit_rate"] == 1.0 and figures["mean_reciprocal_rank"] == 0.5 and figures["mean_answer_overlap"] == 1.0
    assert cli.main(evaluate) == 0
    tier1, tier2, again = told()
    assert sum(tier1.values()) == 0 and tier2["judged"] == 0 and again == figures


class Fussy:
    """An encoder that refuses some texts."""

    def __call__(self, texts):
        import numpy as np

        if any("refused" in t for t in texts):
            raise ValueError("no such word")
        return np.ones((len(texts), 4), np.float32)


class Patient(Fussy):
    def __call__(self, texts):
        return super().__call__([t.replace("refused", "") for t in texts])


def test_a_text_that_an_encoder_refuses_holds_up_its_own_video_alone(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e")
    spoken, scenes, frames, meta = _match(spark, 3)
    spoken = spoken.withColumn("text", F.when((F.col("vid_hash") == "v1") & (F.col("ord") == 1), "refused text.").otherwise(F.col("text")))
    engine.ingest(spoken, scenes, frames, meta, text_encoder=Fussy)
    states = {r.vid_hash: (r.status, r.error_message) for r in engine.tracker.states().filter("phase = 2").collect()}
    assert states == {"v0": ("committed", None), "v1": ("failed", "ValueError: no such word"), "v2": ("committed", None)}
    assert {r.vid_hash for r in engine.visible().select("vid_hash").distinct().collect()} == {"v0", "v2"}
    (letter,) = engine.read("dead_letters").collect()
    assert (letter.vid_hash, letter.text, letter.error) == ("v1", "refused text.", "ValueError: no such word")
    engine.ingest(spoken, scenes, frames, meta, text_encoder=Patient)  # tries what failed, and nothing else
    assert engine.read("points").groupBy("vid_hash").count().filter("count <> 2").isEmpty()
    assert engine.tracker.is_committed("v1", 2) and engine.visible().select("vid_hash").distinct().count() == 3


def test_a_keyframe_that_an_encoder_refuses_fails_its_video(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e")
    spoken, scenes, frames, meta = _match(spark, 2)
    frames = frames.withColumn("keyframe_path", F.when(F.col("vid_hash") == "v1", F.concat("keyframe_path", F.lit("-refused"))).otherwise(F.col("keyframe_path")))
    engine.ingest(spoken, scenes, frames, meta, image_encoder=Fussy)
    assert engine.visible().select("vid_hash").distinct().collect()[0].vid_hash == "v0"
    assert engine.visible().filter("size(image_dense) = 4").count() == 2
    assert engine.tracker.record("v1", 2).status == "failed"


def test_writers_never_share_an_attempt(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tempora.plans import commits

    folder = f"file://{tmp_path}/attempts"
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: commits.claim(spark, folder, 3), range(12)))
    assert sorted(got) == list(range(3, 15))
    assert commits.claim(spark, folder, 40) == 40


def test_two_publications_of_one_video_leave_one_visible(spark, tmp_path):
    one, two = (Engine(spark, f"file://{tmp_path}/e") for _ in range(2))
    spoken, scenes, frames, meta = _match(spark, 1)
    chunks = one.chunk(spoken, scenes, frames)
    one.next_attempt = two.next_attempt = lambda: 1  # both have looked before either wrote
    one.publish(chunks, meta, build_graph=False)
    two.publish(chunks, meta, build_graph=False)
    assert sorted(r.attempt for r in one.read("points").select("attempt").distinct().collect()) == [1, 2]
    assert one.visible().count() == chunks.count() and one.visible().select("attempt").distinct().first().attempt == 2


def test_the_grid_looks_at_a_query_once(spark):
    """Candidates were repeated and ranked for each of the 66 points of the grid."""
    rng = random.Random(5)
    parts = [(q, p, s, 1 / (60 + rng.randint(1, 4)), p % 4) for q in range(9) for p in rng.sample(range(30), 12) for s in range(3) if rng.random() < 0.6]
    targets = [(q, x) for q in range(11) for x in ({q % 4, 3} if q % 2 else {q % 4})] + [(1, 1), (2, None)]
    rows = spark.createDataFrame(parts, "query_id long, point_id long, space int, rrf double, key int")
    grid = evaluation.grid(spark, 0.25)
    made = evaluation.grid_mrr(rows, spark.createDataFrame(targets, "query_id long, expected int"), grid)
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.alpha, r.beta): r.mean_mrr for r in made.collect()}
    assert len(got) == grid.count()
    for (a, b), mean in got.items():
        total = 0.0
        for q in range(11):
            scores = {}
            for x, p, s, r, _ in parts:
                if x == q:
                    scores[p] = scores.get(p, 0.0) + r * (a, b, max(0.0, 1 - a - b))[s]
            order = sorted(scores, key=lambda p: (-round(scores[p], 10), p))
            total += next((1 / (i + 1) for i, p in enumerate(order) if (q, p % 4) in targets), 0.0)
        assert mean == pytest.approx(total / 11, abs=1.1e-5)
