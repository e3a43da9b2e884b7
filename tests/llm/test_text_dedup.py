from collections import Counter, defaultdict

import numpy as np

from tempora.llm import decontaminate, minhash, substring_dedup
from tempora.llm.words import Hasher

from .cases import documents, frame, prose, words


def substring_by_brute_force(rows, n):
    order = sorted({(i is None, i or 0, s) for i, t in rows for s in range(len(words(t)) - n + 1)})
    at = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - n + 1):
            at[i is None, i or 0, s].add(tuple(w[s : s + n]))
    first = {}
    for place in order:
        for win in at[place]:
            first.setdefault(win, place)
    out = Counter()
    gone_at = {p for p in order if any(first[win] < p for win in at[p])}
    for i, t in rows:
        w = words(t)
        starts = [s for s in range(len(w) - n + 1) if (i is None, i or 0, s) in gone_at]
        gone = {k for s in starts for k in range(s, s + n)}
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


def test_substring_dedup_matches_brute_force(spark, monkeypatch):
    rows = documents()
    for n, block in ((20, 10**6), (5, 300), (7, 50)):
        monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
        got = substring_dedup.substring_dedup(frame(spark, rows), window=n).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == substring_by_brute_force(rows, n)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).collect() == []


def near_groups(rows, threshold):
    """Places of the rows of each class."""

    def grams(t):
        w = words(t, lower=True)
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(t) for _, t in rows]
    same = [tuple(words(t, lower=True)) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if same[a] == same[b] or (union and len(sets[a] & sets[b]) >= threshold * union):
                label[root(a)] = root(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    return list(groups.values())


def jaccard_classes(rows, threshold):
    groups = [[rows[k][0] for k in group] for group in near_groups(rows, threshold)]
    return Counter((i, min((x for x in ids if x is not None), default=None), len(ids)) for ids in groups for i in ids), len(groups)


def test_near_duplicates_match_brute_force(spark):
    rows = documents()
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    want, n = jaccard_classes(rows, 0.8)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert len([r for r in got if r.kept]) == n


def test_links_between_members_that_the_leader_does_not_link(spark, monkeypatch):
    """A chain in one bucket: each text is near the next only, and more of them than a block holds."""
    import random

    base = prose(random.Random(5), 100).split()
    rows = [(k, " ".join(base[3 * k : 3 * k + 60] if k < 13 else [f"z{k}_{j}" for j in range(30)])) for k in range(20)]
    monkeypatch.setattr(minhash, "BLOCK_NODES", 4)
    monkeypatch.setattr(minhash, "FEW", 3)
    got = minhash.near_duplicates(frame(spark, rows), bands=60, rows=2)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == jaccard_classes(rows, 0.8)[0]


def test_near_sets_of_unequal_counts_are_linked(spark):
    """A line once against the same line forty times: near as sets of shingles, far by their counts."""
    rows = []
    for k in range(20):
        body, line = (" ".join(f"{kind}{k}_{j}" for j in range(n)) for kind, n in (("w", 300), ("l", 12)))
        rows += [(2 * k, f"{body} {line}"), (2 * k + 1, f"{body} " + f"{line} " * 40)]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    want = jaccard_classes(rows, 0.8)[0]
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert all(size == 2 for _, _, size in want)


def test_bands_of_plain_sets_stand_beside_the_weighted():
    rng = np.random.default_rng(4)
    plain = rng.integers(1, 2**62, 50).astype(np.uint64)
    again = np.concatenate([plain, np.repeat(plain[:3], 30)])
    one, two, none = minhash.band_keys([plain, again, plain[:0]], 24, 5)
    assert len(one) == 24 and set(one) <= set(two) and len(two) > 24 and not len(none)


def test_keep_representatives(spark):
    rows = documents()
    df = frame(spark, rows)
    out = minhash.keep_representatives(df)
    assert out.columns == df.columns and out.count() == jaccard_classes(rows, 0.8)[1]


def test_overlaps_in_narrow_columns(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 3)
    rng = np.random.default_rng(2)
    left, right = ([np.unique(rng.integers(0, 40, n)) for n in sizes] for sizes in ((0, 5, 30), (12, 0, 1, 25)))
    assert minhash.overlaps(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert minhash.overlaps([np.zeros(0, np.int64)], [np.zeros(0, np.int64)]).tolist() == [[0]]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(1, 2**62, n).astype(np.uint64) for n in (800, 100, 100))
    sig = minhash.signatures([np.concatenate([common, a]), np.concatenate([common, b]), np.zeros(0, np.uint64)], 4000)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.03 and not sig[2].any()


def test_weights_raise_an_elements_share():
    x = np.arange(1, 11, dtype=np.uint64)
    sig = minhash.signatures([np.concatenate([x, np.full(10, 5, np.uint64)])], 4000)
    assert abs((sig[0] == 5).mean() - 11 / 20) < 0.04


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def leaks_by_brute_force(docs, items):
    strip = lambda t: [w.strip(decontaminate.PUNCTUATION.decode()) or w for w in words(t, lower=True)]
    out = set()
    for i, t in docs:
        for j, text in items:
            item, w = strip(text), strip(t)
            if j is None or not item:
                continue
            row = [0] * (len(w) + 1)
            for n, x in enumerate(item, 1):
                new = [n]
                for k, y in enumerate(w, 1):
                    new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (x != y)))
                row = new
            if min(row) <= decontaminate.bound(len(item), 0.8):
                out.add((i, j, min(row)))
    return out


def test_leaks_match_brute_force(spark):
    import random

    rng = random.Random(4)
    items = [(k, prose(rng, rng.choice((4, 9, 15, 30, 57)), 3000)) for k in range(12)] + [(90, None), (91, ""), (None, "words of no id at all")]
    docs = []
    for k in range(60):
        w, item = prose(rng, rng.randrange(1, 150), 3000).split(), words(items[k % 12][1])
        edits = rng.choice((0, 0, 1, decontaminate.bound(len(item), 0.8) // 2, len(item) // 2))
        for _ in range(edits):
            at = rng.randrange(max(1, len(item)))
            what = rng.randrange(3)
            item[at : at + (what != 0)] = [] if what == 2 else ["edited"]
        at = rng.randrange(len(w) + 1)
        docs.append((k, " ".join(w[:at] + (["(" + item[0].upper() + ","] + item[1:] if item else []) + w[at:])))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, items[4][1] + " " + items[5][1]), (0, items[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    want = leaks_by_brute_force(docs, items)
    assert got <= want
    assert {x for x in want if x[2] == 0} <= got
    assert len(got) >= 0.95 * len(want)

    left = decontaminate.without_leaks(frame(spark, docs), bench)
    bad = {(i, t) for i, t in docs for d, _, _ in got if d == i}
    assert {(r.doc_id, r.text) for r in left.collect()} >= {d for d in docs if d not in bad}
    assert not {r.doc_id for r in left.collect()} & {502}


def test_edit_distance_of_best_substring():
    h = Hasher()
    of = lambda s: h.of(s.encode().split())
    assert decontaminate.edit_distance(of("a b c d"), of("x a b c d y")) == (0, 5)
    assert decontaminate.edit_distance(of("a b c d"), of("x a c d y"))[0] == 1
    assert decontaminate.edit_distance(of("a b"), of(""))[0] == 2


def test_no_leaks_in_nothing(spark):
    bench = spark.createDataFrame([(1, "some words of a benchmark item")], "item_id long, text string")
    assert decontaminate.leaks(frame(spark, []), bench).collect() == []
    assert decontaminate.leaks(frame(spark, documents()), bench.limit(0)).collect() == []
