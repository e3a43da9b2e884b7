"""The n-gram join, importance resampling and spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora.llm import importance, minhash, prefix_join, spelling
from tempora.llm.common import in_slices

from .cases import documents, frame, prose, words

UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}


# The n-gram join -----------------------------------------------------------------------------------------------------


def shingles(text, n=4):
    w = words(text, lower=True)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(rows, percent=85):
    """Per row (id, set size, smallest id of its component), all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                above[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def found(spark, rows, **more):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in prefix_join.similar_groups(frame(spark, rows), **more).collect()), key=repr)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_join_of_odd_rows(spark):
    assert found(spark, documents(11)) == groups(documents(11))


def test_join_at_the_threshold_and_chains(spark):
    rng = random.Random(12)
    rows, chain = [], prose(rng, 150, 10**6)
    for i in range(12):  # each like the one before, the ends unlike
        rows.append((100 + i, chain))
        chain = edited(rng, chain, 3)
    for i in range(30):
        base = prose(rng, rng.randrange(20, 200), 10**6)
        rows += [(1000 + 10 * i + k, edited(rng, base, k)) for k in range(6)]
    # 17 of 20 shingles are 85 of 100; 16 of 19 are less.
    w = [f"q{i}" for i in range(40)]
    rows += [(1, " ".join(w[:23])), (2, " ".join(w[:20])), (3, " ".join(w[3:22]))]
    got = found(spark, rows)
    assert got == groups(rows)
    assert (2, 17, 1) in got


@pytest.mark.parametrize(("few", "nodes"), [(2, 5), (8, 512)])
def test_join_of_hot_passages_and_large_groups(spark, monkeypatch, few, nodes):
    rng = random.Random(13)
    passage, base = prose(rng, 40, 10**6), prose(rng, 90, 10**6)
    rows = [(i, passage + prose(rng, rng.randrange(1, 60), 30)) for i in range(60)]
    rows += [(100 + i, edited(rng, base, rng.randrange(1, 5))) for i in range(60)]
    rows += [(200 + i, passage) for i in range(20)] + [(300 + i, " ".join(passage.split()[: 10 + i])) for i in range(31)]
    monkeypatch.setattr(prefix_join, "FEW", few)
    monkeypatch.setattr(prefix_join, "BLOCK_NODES", nodes)
    assert found(spark, rows) == groups(rows)


def test_the_order_of_shingles_never_changes_the_result(spark, monkeypatch):
    """Sixteen counters, which all shingles share."""
    rows = documents(14)[:70]
    monkeypatch.setattr(prefix_join, "COUNTERS", 16)
    monkeypatch.setattr(prefix_join, "FAN", 2)
    assert found(spark, rows) == groups(rows)


def test_counters_hold_every_shingle_of_every_document(spark):
    rows = [r for r in documents(15) if r[0] is not None]
    seen = frame(spark, rows).repartition(7).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = seen.mapInPandas(prefix_join._counted(4), "doc_id long, node binary, size long, chunk int, part int, counts binary")
    assert prefix_join.counters(counted).sum() == sum(len(shingles(t)) for _, t in rows)


def test_filters_lose_no_pair():
    """The least overlap, prefixes and positions by their definitions, for all sizes up to 60."""
    import numpy as np

    for a in range(1, 61):
        for b in range(a, 61):
            need = next((o for o in range(a + 1) if 100 * o >= 85 * (a + b - o)), None)
            least = -(-(a + b) * 85 // 185)
            assert need is None and least > a or need == least
            if need is not None:
                assert prefix_join.prefix_size(np.array([b]), 85)[0] >= b - need + 1 and prefix_join.prefix_size(np.array([a]), 85)[0] >= a - need + 1


def test_join_of_no_rows_and_huge_ids(spark):
    assert found(spark, []) == []
    rows = [(2**62 + 1, "a b c d e"), (2**62 + 3, "a b c d e"), (None, "a b c d e"), (None, "x y")]
    assert found(spark, rows) == groups(rows)


def test_components_are_those_of_minhash():
    assert prefix_join.components is minhash.components


# Importance ----------------------------------------------------------------------------------------------------------


def runs(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER_TO_LOWER))


def features(text, n):
    w = runs(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def resampled(rows, target, n=1, buckets=10_000, min_words=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in features(x, n)), Counter(bucket(f) for x in target for f in features(x, n))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    scored = []
    for doc_id, x in rows:
        own = features(x, n)
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        scored.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(runs(x)) >= min_words))
    able = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    drawn = able[: percent * len(able) // 100]
    out = [(*r[:4], i + 1) for i, r in enumerate(drawn)]
    return sorted(out + [(*r[:4], None) for r in able[len(drawn) :] + [r for r in scored if not r[4]]], key=repr)


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (3, 50, 37)])
def test_resampling_matches_brute_force(spark, n, buckets, percent):
    rows, target = documents(16), [t for _, t in documents(17)][:30] + [None, ""]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame(spark, rows), bench, n=n, buckets=buckets, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled(rows, target, n, buckets, percent=percent)


def test_resampling_of_little(spark):
    bench = spark.createDataFrame([], "text string")
    assert importance.resample(frame(spark, []), bench).count() == 0
    rows = [(1, "one two"), (2, None), (None, "a " * 25), (3, "Ä ß straße 12 " * 10)]
    got = importance.resample(frame(spark, rows), bench, percent=50)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled(rows, [], percent=50)


def test_resampling_moves_towards_the_target(spark):
    rng = random.Random(18)
    near, far = [f"near{i}" for i in range(200)], [f"far{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(near if i % 2 else far) for _ in range(40))) for i in range(400)]
    bench = spark.createDataFrame([(" ".join(near),)], "text string")
    drawn = importance.resample(frame(spark, rows), bench).filter("rank IS NOT NULL")
    assert drawn.count() == 40 and drawn.filter("doc_id % 2 = 0").count() == 0


def test_ranks_go_on_over_partitions(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("score")).repartition(13)
    placed, total = importance.ranked(rows, F.desc("score"), F.asc("id"))
    got = [r.id for r in placed.orderBy("place").collect()]
    assert total == 5000 and got == sorted(range(5000), key=lambda i: (-(i * 7919 % 1000), i))
    assert placed.agg(F.min("place"), F.max("place"), F.countDistinct("place")).first()[:] == (1, 5000, 5000)


def test_resampling_runs_no_python(spark):
    docs = frame(spark, documents(16))
    plan = importance.resample(docs, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


# Spelling ------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def spelt(rows, min_count=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER_TO_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= min_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(((-n[v], v) for v in near[w]), default=None) for w in n}
    form = {w: b[1] if b and -b[0] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, n[w], form[w], n[form[w]] if form[w] else None, len(near[w]), root(w)) for w in n), key=repr)


def variants(spark, rows, **more):
    got = spelling.variants(frame(spark, rows), **more).select("word", "n", "form", "form_n", "n_near", "root")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def varied_texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdéßxyz") for _ in range(rng.randrange(4, 9))) for _ in range(60)] + ["colour", "color", "Colours", "straße", "strasse", "aaaaa", "aaaaaa", "aaaaaaa"]
    rows = []
    for i in range(80):
        out = []
        for _ in range(60):
            w = base[int(rng.paretovariate(0.6)) % len(base)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("xyß") + w[k + 1 :]))
            out.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice((" ", "-", "9")).join(out)))
    return [*rows, (None, "colour colour"), (81, None), (82, ""), (83, "z" * 300 + " " + "z" * 299), (84, "z" * 300), (85, "z" * 300), rows[0], rows[0]]


@pytest.mark.parametrize(("shard_chars", "pass_bytes"), [(1_000_000, 24_000_000), (200, 1)])
def test_variants_match_brute_force(spark, shard_chars, pass_bytes):
    rows = varied_texts(19)
    got = variants(spark, rows, shard_chars=shard_chars, pass_bytes=pass_bytes)
    assert got == spelt(rows) and sum(r[2] is not None for r in got) > 20


def test_automaton_finds_every_neighbour_once():
    rng = random.Random(20)
    vocabulary = sorted({"".join(rng.choice("ab\U0001f389") for _ in range(rng.randrange(1, 8))) for _ in range(700)})
    trie = spelling.Trie(vocabulary, [1] * len(vocabulary))
    asked = [*vocabulary[::3], "a", "", "zzzz"]
    who, word = spelling.neighbours(trie, asked)
    pairs = list(zip(who.tolist(), word.tolist(), strict=True))
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(i, k) for i, w in enumerate(asked) for k, v in enumerate(vocabulary) if one_edit(w, v)}


def test_states_in_small_batches_change_nothing(monkeypatch):
    vocabulary = sorted({f"{a}{b}{c}" for a in "abcd" for b in "abcd" for c in "abcd"})
    trie = spelling.Trie(vocabulary, [1] * len(vocabulary))
    want = [x.tolist() for x in spelling.neighbours(trie, vocabulary)]
    monkeypatch.setattr(spelling, "BATCH_STATES", 5)
    assert [x.tolist() for x in spelling.neighbours(trie, vocabulary)] == want and len(want[0]) == 64 * 9


def test_chains_of_forms_end_at_their_root(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(37)] + [("x", "w030")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w037" for w, _ in chain}


def test_no_words_no_variants(spark):
    assert variants(spark, []) == [] and variants(spark, [(1, None), (2, "a bc 12")]) == []


def test_batches_are_looked_at_in_slices():
    seen = []

    def run(parts):
        for b in parts:
            seen.append(len(b))
            yield b

    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])
    ids = [2**60 + 1, None, *range(2500)]
    batch = pa.RecordBatch.from_pydict({"id": ids, "text": ["a"] * len(ids)}, schema)
    out = list(in_slices(run, schema)([batch]))
    assert seen == [1000, 1000, 502] and [i for b in out for i in b.column(0).to_pylist()] == ids


def test_ngram_join_slices_texts(spark, monkeypatch):
    """No function of the join is given a whole batch of texts."""
    rows = []
    monkeypatch.setattr(prefix_join, "in_slices", lambda run, schema: rows.append(schema.names) or in_slices(run, schema, 2))
    docs = spark.createDataFrame([(i, "a b c d e f g h i j" if i % 2 else f"x{i} b c d e") for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in prefix_join.similar_groups(docs).collect()}
    assert got == {i: 1 if i % 2 else i for i in range(20)} and len(rows) == 3


def test_the_filter_of_wanted_rows_leaves_copies_where_they_are(spark):
    """It went by the text alone, so that all copies of a wanted text were shuffled; and it let through one other row in sixteen to thirty-two."""
    rows = spark.range(20000).select("id", F.xxhash64("id").alias("key"))
    wanted = rows.filter("id % 20 = 0").select(F.col("key").alias("_row"))
    found = {r.id for r in prefix_join.seen_in(rows, "key", wanted).collect()}
    assert found >= set(range(0, 20000, 20)) and len(found) < 1000 + 19000 / 50


def test_pairs_are_verified_on_the_sets_that_they_name(spark, tmp_path):
    """All sets were shuffled to each join that looks pairs up."""
    sets = spark.range(20000).select("id", F.sequence(F.col("id") % 7, F.col("id") % 7 + 99).alias("shingles"))
    spark.createDataFrame([(k, k + 7 if k % 2 else k + 3) for k in range(0, 400, 5)], "a long, b long").write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    own = {r.id for r in prefix_join.sets_of(pairs.select("a"), sets).select("id").collect()}
    assert own >= set(range(0, 400, 5)) and len(own) < 80 + 20000 / 50
    found = prefix_join.verified(pairs, sets, 95)
    assert {(r.a, r.b) for r in found.collect()} == {(k, k + 7) for k in range(5, 400, 10)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") >= 2
