"""The pipeline's run and the queries without SQL over a small folder of tables, against brute force."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as driver
import corpus_pipeline as pipeline
from tempora.llm import bpe, toxicity

from .cases import documents, frame, prose
from .test_models import base_by_brute_force
from .test_native_dedup import norm
from .test_text_dedup import leaks_by_brute_force, near_groups

FIRST = lambda row: (row[0] is None, row[0] or 0)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Folder, rows, items: odd documents, toxic ones, and texts that hold a benchmark item."""
    rng = random.Random(8)
    items = [(k, prose(rng, n, 3000)) for k, n in enumerate((9, 20, 30))] + [(7, None), (8, "")]
    rows, labels = documents(), []
    for k in range(320):
        own = prose(rng, rng.randrange(20, 90)).split()
        for _ in range(3 if k % 8 == 0 else 0):
            own.insert(rng.randrange(len(own)), rng.choice(("moron!", "Stupid", f"vilstem{rng.randrange(30)}")))
        rows.append((1000 + k, " ".join(own)))
        labels.append((1000 + k, 1, int(k % 8 == 0)))
    rows += [(2000 + k, f"{prose(rng, 40)} {items[k % 3][1]} {prose(rng, 40)}") for k in range(9)]
    labels += [(None, 1, 1), (5000, 0, 1)]
    top = str(tmp_path_factory.mktemp("world"))
    frame(spark, rows).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, rows, items


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_run_matches_brute_force(spark, world, library):
    top, rows, items = world
    docs = spark.read.parquet(f"{top}/documents.parquet")
    labels = spark.read.parquet(f"{top}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    left = [(r.doc_id, r.text) for r in scored if r.score < toxicity.THRESHOLD]
    gone = Counter(r.doc_id for r in scored if r.score >= toxicity.THRESHOLD)
    planted = {1000 + k for k in range(0, 320, 8)}
    assert len(planted & set(gone)) >= 0.9 * len(planted) and len(set(gone) - planted) <= 10

    firsts = {}
    for row in sorted(left, key=FIRST):
        firsts.setdefault(norm(row[1]), row)
    left = list(firsts.values())
    left = [min((left[k] for k in group), key=FIRST) for group in near_groups(left, 0.8)]
    bad = {i for i, _, _ in leaks_by_brute_force(left, items)}
    assert bad >= {2000 + k for k in range(9)} - set(gone)
    want = Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in left if i not in bad)

    out = pipeline.run(spark, top)
    assert out.columns == ["doc_id", "source", "lang", "ids", "n_tokens", "decodes"]
    got = out.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(r.decodes and r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_the_columns_and_take_empty_tables(spark, world):
    top, _, _ = world
    docs = frame(spark, [])
    for name, f in pipeline.STAGES[:-1]:
        out = f(spark, docs, top)
        assert out.columns == docs.columns and out.collect() == [], name
    assert pipeline.STAGES[-1][1](spark, docs, top).collect() == []


def test_lm_query_matches_brute_force(spark, world):
    top, rows, _ = world
    got = driver.queries()["op1_maxent_lm"](spark, top).collect()
    assert base_by_brute_force(rows) == sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
    assert all(r.score < 0 for r in got)


def test_decontamination_query_matches_brute_force(spark, world):
    top, rows, items = world
    got = {(r.doc_id, r.item_id, r.edits) for r in driver.queries()["op2_decontamination"](spark, top).collect()}
    assert got == leaks_by_brute_force(rows, items) and len(got) >= 9


def test_toxicity_query_scores_every_row(spark, world):
    top, rows, _ = world
    got = driver.queries()["op3_toxicity"](spark, top).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((i, held(i)) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    known = [(r.doc_id % 8 == 0, r.predicted) for r in got if r.held_out and r.doc_id is not None and 1000 <= r.doc_id < 1320]
    assert sum(p for toxic, p in known if toxic) >= 0.9 * sum(toxic for toxic, _ in known)
    assert sum(p for toxic, p in known if not toxic) <= 2


def test_bpe_query_matches_the_library(spark, world, library):
    top, rows, _ = world
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode())] += 1
    got = driver.queries()["op10_byte_bpe"](spark, top).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_the_dictionary_that_passes_through_the_driver_is_small(spark, world, monkeypatch):
    top, rows, _ = world
    sizes, own = [], bpe.Bpe.dictionary
    monkeypatch.setattr(bpe.Bpe, "dictionary", lambda self, docs, text_col, size: sizes.append(size) or own(self, docs, text_col, size))
    out = pipeline.encode(spark, frame(spark, rows[:20]), top)
    assert out.filter("decodes").count() == len(rows[:20])
    assert len(sizes) == 1 and sizes[0] <= 100_000
