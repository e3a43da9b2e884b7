import hashlib
import re
from collections import Counter, defaultdict

from tempora.llm import exact_dedup, line_dedup

from .cases import documents, frame

WS = " \t\n\x0b\x0c\r"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup_matches_brute_force(spark):
    rows = documents()
    got = exact_dedup.exact_dedup(frame(spark, rows), block_bytes=16).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_blocks_of_any_size_give_the_same_groups(spark):
    rows = documents(2)
    a, b = ({(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(frame(spark, rows), block_bytes=n).collect()} for n in (7, 4096))
    assert a == b


def test_keep_first_keeps_all_columns_and_one_row_a_text(spark):
    rows = documents()
    df = frame(spark, rows)
    out = exact_dedup.keep_first(df)
    assert out.columns == df.columns
    texts = [norm(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({norm(t) for _, t in rows})


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []


def lines_by_brute_force(rows, least_chars, least_docs):
    def key(x):
        return x.strip(WS).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    seen = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k].append(i)
    top = {k: max((i for i in ids if i is not None), default=None) for k, ids in seen.items() if len(ids) >= least_docs and len(k) >= least_chars}
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_dedup_matches_brute_force(spark):
    rows = documents()
    for chars, docs, batches in ((40, 5, 3), (10, 2, 7)):
        got = line_dedup.line_dedup(frame(spark, rows), min_chars=chars, min_docs=docs, batches=batches).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == lines_by_brute_force(rows, chars, docs)


def test_rows_of_one_id_or_none_lose_their_own_lines(spark):
    stock = [f"this line is long enough to be counted, number {i}" for i in range(30)]
    texts = ["\n".join(["short", *stock[:20]]), "\n".join([*stock[10:], "short"]), "\n".join(stock[5:25] * 2)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[0]), (7, texts[2]), (9, "\n".join(stock)), (9, "")]
    got = line_dedup.line_dedup(frame(spark, rows), min_docs=2).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        (None, 21, 20, "short"), (None, 21, 20, "short"), (None, 21, 20, "short"),
        (7, 21, 20, "short"), (7, 40, 40, ""), (9, 30, 0, "\n".join(stock)), (9, 1, 0, ""),
    ], key=str)


def test_runs_hold_each_key_once_and_stay_few(spark):
    index = line_dedup.LineRuns(spark, fanout=2, buckets=2)
    total = Counter()
    for b in range(7):
        rows = [(k, -k, 10 * b + k) for k in range(b, b + 5)]
        total.update(r[0] for r in rows)
        index.absorb(spark.createDataFrame(rows, "h1 long, h2 long, id long"))
    keys = [r.h1 for run in index.runs() for r in run.collect()]
    assert len(keys) == len(set(keys)) == len(total) and len(index.runs()) <= 3
    assert {r.h1: r.n for r in index.totals().collect()} == total
    index.drop()


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_dedup(frame(spark, [])).collect() == []
