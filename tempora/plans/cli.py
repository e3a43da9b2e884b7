"""Command line: the engine's parameters.

Flag names and defaults are the interface and are fixed. Detectors and transcribers run elsewhere: ingestion reads their tables
from `--input_dir`, the folders spoken, scenes, keyframes and meta in Parquet or JSON.
"""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, search
from ..sources import config, readers, sinks
from .engine import Engine, phase_plan

INPUTS = {
    "spoken": "vid_hash string, ord long, text string, start double, end double",
    "scenes": "vid_hash string, scene_index int, start_sec double, end_sec double",
    "keyframes": "vid_hash string, scene_index int, ord int, keyframe_path string",
    "meta": "vid_hash string, domain string",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tempora", description="Ingest, search, evaluate and tune time-aligned content on Spark.")
    ops = p.add_argument_group("operations")
    ops.add_argument("--root", required=True, help="folder that driver and executors share")
    ops.add_argument("--run_phase", choices=["all", "0", "1", "2", "3", "4"])
    ops.add_argument("--resume_phase", type=int)
    ops.add_argument("--input_dir", help="folder with the tables spoken, scenes, keyframes, meta")
    ops.add_argument("--input_format", choices=["parquet", "json"], default="parquet")
    ops.add_argument("--meta_path", help="metadata file whose domain counts where --domain is not given")
    ops.add_argument("--domain")
    ops.add_argument("--build_graph", action="store_true")
    ops.add_argument("--build_index", action="store_true", help="fit the dense index on what is committed and code all points")
    ops.add_argument("--settings_path", help="settings file on the driver with the domains' weights")
    s = p.add_argument_group("search")
    s.add_argument("--query")
    s.add_argument("-s", "--search_only", action="store_true")
    s.add_argument("-qa", "--question_answer", action="store_true", help="ask again with the best text as the query")
    s.add_argument("-t", "--top_k", type=int, default=20)
    s.add_argument("-f", "--filter_meta")
    s.add_argument("--approximate", action="store_true", help="search the dense index, where one was built, instead of all points")
    s.add_argument("--use_graph", action="store_true")
    s.add_argument("--hop_limit", default="2")
    s.add_argument("-rr", "--rerank", action="store_true")
    s.add_argument("--max_context_images", type=int, default=4)
    t = p.add_argument_group("tuning")
    t.add_argument("--tune_weights", action="store_true")
    t.add_argument("--target_kf", help="pairs of query and keyframe as JSON, or a path to them")
    t.add_argument("--save_domain", help="write the best weights to the settings under this domain")
    e = p.add_argument_group("evaluation")
    e.add_argument("--eval_sample_rate", type=float, default=0.1)
    e.add_argument("--deep_eval_threshold_low", type=float, default=0.4)
    e.add_argument("--deep_eval_threshold_high", type=float, default=0.7)
    e.add_argument("--ground_truth_path")
    o = p.add_argument_group("output")
    o.add_argument("-tr", "--trake_mode", action="store_true", help="answers with chunk, time and keyframe of what they rest on")
    o.add_argument("-outcsv", "--export_csv", action="store_true", help="also write the result as CSV below the root")
    return p


def resolve_domain(spark: SparkSession, given: str | None, meta_path: str | None) -> str:
    """The named domain, else that of the metadata file; an error where neither says."""
    found = given or (readers.metadata(spark, meta_path).select("domain").first() or [None])[0] if given or meta_path else None
    if not found:
        raise SystemExit("a domain is needed: --domain, or --meta_path of a file that names one")
    return found


def _input(spark: SparkSession, folder: str, name: str, kind: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/{name}"
    return spark.read.schema(INPUTS[name]).format(kind).load(path)


def _ingest(engine: Engine, phases: list[int], a: argparse.Namespace) -> None:
    spark = engine.spark
    tables = {name: _input(spark, a.input_dir, name, a.input_format) for name in INPUTS}
    if phases == [0]:
        print(json.dumps({"videos": tables["spoken"].select("vid_hash").distinct().count()}))
        return
    chunks = engine.chunk(tables["spoken"], tables["scenes"], tables["keyframes"])
    if 2 in phases:
        counts = engine.publish(chunks, tables["meta"], build_graph=a.build_graph)
        chunks = counts
    print(json.dumps({"videos": chunks.select("vid_hash").distinct().count()}))


def _show(rows: DataFrame, engine: Engine, name: str, a: argparse.Namespace) -> None:
    if a.export_csv:
        sinks.write_csv(rows, engine.path(f"reports/{name}-{time.strftime('%Y%m%d-%H%M%S')}"))
    for row in rows.toJSON().collect():  # at most top_k rows, or one for the one query
        print(row)


def _search(engine: Engine, a: argparse.Namespace) -> None:
    spark = engine.spark
    domain = resolve_domain(spark, a.domain, a.meta_path)
    q = spark.createDataFrame([("q", a.query)], "query_id string, query string")
    look = lambda asked: engine.search(asked, domain, a.filter_meta, a.top_k, use_graph=a.use_graph, hop_limit=a.hop_limit, approximate=a.approximate)
    # One query, its answer or at most top_k rows: kept as they are, or each use would plan and run the search again.
    held = lambda rows: spark.createDataFrame(rows.collect(), rows.schema)
    found = look(q)
    if a.question_answer:
        q = held(search.answered_query(q, found).select("query_id", "query"))
        found = look(q)
    found = engine.rerank(found, q) if a.rerank else found
    best = held(engine.best(found, a.top_k))
    if a.search_only:
        shown = best.withColumn("score", F.coalesce("rerank_score", "s_total") if "rerank_score" in best.columns else F.col("s_total"))
        return _show(shown.orderBy("final_rank").select("chunk_id", "text", "keyframe_path", "score", "place"), engine, "search", a)
    answer = held(engine.answer(best, a.max_context_images))
    traced = held(answer.join(engine.provenance(best, answer), "query_id", "left"))
    answer = traced if a.trake_mode else answer
    told = F.array_join(F.collect_list("text"), "\n").alias("context")
    shown = traced.withColumn("keyframes", F.transform("trake", lambda t: t["keyframe_path"]))
    engine.log(shown.join(q, "query_id").join(best.groupBy("query_id").agg(told), "query_id"))
    return _show(answer, engine, "answer", a)


def _evaluate(engine: Engine, a: argparse.Namespace) -> None:
    spark = engine.spark
    first, second = engine.evaluate_queue(a.eval_sample_rate, a.deep_eval_threshold_low, a.deep_eval_threshold_high)
    _show(evaluation.verdict_counts(first), engine, "tier1", a)
    _show(evaluation.tier2_counts(second), engine, "tier2", a)
    if a.ground_truth_path:
        _show(engine.ground_truth(readers.logged(spark, engine.path("queue")), readers.ground_truth(spark, a.ground_truth_path)), engine, "ground-truth", a)


def _tune(engine: Engine, a: argparse.Namespace) -> None:
    targets = evaluation.target_pairs(engine.spark, a.target_kf or "[]").select(F.md5("query").alias("query_id"), "query", F.col("expected_keyframe").alias("expected"))
    queries = targets.select("query_id", "query").distinct()
    best = engine.tune(engine.components(queries, resolve_domain(engine.spark, a.domain, a.meta_path), a.top_k), targets.drop("query"))
    row = best.first()
    if a.save_domain:
        if not a.settings_path:
            raise SystemExit("--save_domain needs --settings_path")
        settings = config.load(a.settings_path) if os.path.exists(a.settings_path) else {}
        config.save(a.settings_path, config.with_weights(settings, a.save_domain, row.alpha, row.beta))
    _show(best, engine, "weights", a)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    phases = phase_plan(a.run_phase, a.query)
    ingesting = [p for p in phases if p < 3]
    if (ingesting or a.build_graph) and not a.input_dir:
        raise SystemExit("the command line does not ingest without --input_dir, the tables of detectors and transcribers")
    spark = SparkSession.builder.appName("tempora").getOrCreate()
    weights = {}
    if a.settings_path and a.domain and os.path.exists(a.settings_path):
        weights[a.domain] = config.weights_of(config.load(a.settings_path), a.domain)
    engine = Engine(spark, a.root, weights)
    if a.resume_phase is not None:
        print(json.dumps({"rolled_back": engine.tracker.resume(a.resume_phase)}))
    if ingesting:
        _ingest(engine, ingesting, a)
    if a.build_index:
        model = engine.build_index()
        print(json.dumps({"cells": len(model.cells), "probes": model.probes}))
    if a.tune_weights:
        _tune(engine, a)
    if 3 in phases:
        if not a.query:
            raise SystemExit("searching needs --query")
        _search(engine, a)
    if 4 in phases:
        _evaluate(engine, a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
