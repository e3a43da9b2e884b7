import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tempora.llm import lm, toxicity

from .cases import documents, frame, prose


def base_by_brute_force(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted((i is None, i or 0, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 4)) for i, t in rows)


def test_lm_counts_and_base_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "DICTIONARY", 60)  # so that most words take the way of rare ones
    rows = documents()
    got = lm.score_held_out(frame(spark, rows)).collect()
    want = base_by_brute_force(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want


def test_lm_probabilities_sum_to_one_and_beat_the_base(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(f"{'ab'[k % 2]}{(rng.randrange(40) if j % 2 else 7)}" for j in range(60))) for k in range(300)]
    model, _ = lm.train(frame(spark, docs).filter(~lm.held_out(F.col("doc_id"))))
    ranks = np.array([0, 3, 1, 2], np.int32)
    slots = lm.features(model.vocabulary.symbols(ranks, model.head), np.arange(4))
    classes = np.exp(model.log_classes(slots)).sum(axis=1)
    inside = np.exp(model.inner).sum(axis=1)
    assert np.allclose(classes, 1, atol=1e-4)
    assert np.allclose(inside, len(np.unique(model.classes)), atol=1e-3)
    got = lm.score_held_out(frame(spark, docs)).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b + 100


def test_lm_of_nothing(spark):
    assert lm.score_held_out(frame(spark, [])).collect() == []


def toxic_world(spark, n=600):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(n):
        toxic = k % 8 == 0
        words = prose(rng, rng.randrange(20, 120)).split()
        for _ in range(max(3, len(words) // 25) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(("moron!", "Stupid", f"vilstem{rng.randrange(50)}")))
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    docs += [(n, None), (n + 1, ""), (None, "no id"), (n + 2, "x" * 20000), (3, docs[3][1])]
    labels += [(None, 1, 1), (5, 1, None), (10**6, 0, 1), (3, 1, 0)]
    return docs, frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, docs, labels = toxic_world(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).select("doc_id", "score", toxicity.held_out(F.col("doc_id")).alias("held_out")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    known = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    hit = [r for r in known if r.doc_id % 8 == 0]
    assert sum(r.score >= 0.3 for r in hit) >= 0.9 * len(hit)
    assert sum(r.score >= 0.3 for r in known if r.doc_id % 8) <= 0.02 * len(known)
    assert set(toxicity.without_toxic(docs, labels).columns) == set(docs.columns)


def test_labels_of_held_out_rows_are_never_read(spark):
    _, docs, labels = toxic_world(spark, 200)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.voters == b.voters and np.allclose(a.weights, b.weights)


def test_correlated_voters_share_their_vote():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.3
    one, other = (np.where(y, rng.random(2000) < 0.8, rng.random(2000) < 0.05) for _ in range(2))
    votes = np.stack([one, one, other], axis=1).astype(float)
    counts = np.stack([~y, y], axis=1).astype(float)
    q, rate, discount, prior = toxicity.label_model(votes, counts, np.ones(2000), 0.3)
    assert discount[0] < 0.7 < discount[2] and abs(prior - 0.3) < 0.05
    assert abs(rate[1, 2] - 0.8) < 0.1 and ((q > 0.5) == y).mean() > 0.95


def test_toxicity_without_labels(spark):
    _, docs, labels = toxic_world(spark, 50)
    scores = {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()}
    assert len(scores) == 1
    assert toxicity.score(frame(spark, []), toxicity.fit(frame(spark, []), labels)).collect() == []


def test_a_class_is_scored_without_the_others_being_normalised():
    """Scoring took the logarithms of all classes, and looked each word up twice to find those beyond the dictionary."""
    rng = np.random.default_rng(2)
    words = [f"w{i}".encode() for i in range(30)]
    model = lm.Model(lm.Vocabulary(words), np.arange(30, 0, -1), 465, 30, 20, rng.integers(0, 5, 20).astype(np.int32), 6, rng.normal(size=(64, 6)).astype(np.float32), rng.normal(size=6).astype(np.float32))
    slots, target = rng.integers(0, 64, (500, 4)), rng.integers(0, 6, 500)
    every = model.log_classes(slots)
    assert np.allclose(model.log_class(slots, target), every[np.arange(500), target], atol=1e-5)
    assert np.allclose(model.shares(slots), np.exp(every), atol=1e-6)
    docs = [[b"w1", b"new", lm.END], [lm.END], [b"w2"], [b"new", b"w29", b"other"]]
    ranks, place = model.vocabulary.ranks(docs)
    assert lm._tails(docs, ranks, np.flatnonzero(place == 0), 30) == [[b"new", lm.END], [lm.END], [], [b"new", b"other"]]
