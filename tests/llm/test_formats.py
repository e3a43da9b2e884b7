import base64
import gzip
import hashlib
import random
import struct

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tempora.llm import bpe, chat, warc

from .cases import documents, frame


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = "page_id long, url string, html string, digest string, payload string, first string, key int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", "f", 1) for r in rows], PAGES)


def test_warc_round_trip(spark):
    rng = random.Random(1)
    big = "".join(rng.choice("ab\r\n\r\n\u00e9\U0001f389") for _ in range(9000))
    rows = [(5, "http://a", "<p>x</p>"), (3, "http://b", "<p>x</p>"), (9, None, big), (4, "http://\r\nc", big), (7, "u", None), (8, "u", ""), (None, "n", "<p>x</p>"), (None, "n", "only here"), (11, "r", "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\n")]
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows), segment_bytes=1000).collect()}
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = set()
    for i, _, h in rows:
        data, lead = (h or "").encode(), first.get(h or "")
        want.add((i, len(data), b32(data), "response" if i == lead else "revisit", None if i == lead else lead))
    assert got == want


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbbbb"), (4, "u", "bbbbbb")]
    got = {r.page_id: r.record_type for r in warc.round_trip(pages(spark, rows), min_revisit_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_broken_segments_are_named(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, [(1, "u", "x" * 5000), (2, "u", "y" * 5000), (3, "u", "z" * 5000)]), path, segment_bytes=1000)
    records = warc.read_records(spark, path)
    one = F.col("origin").startswith("<urn:page:1:")
    two = F.col("origin").startswith("<urn:page:2:") & (F.col("number") == 2)
    cut = records.filter(~(one & (F.col("number") == 3))).withColumn("block", F.when(two, F.substring("block", 1, 10)).otherwise(F.col("block")))
    assert {r.page_id: r.status for r in warc.reassemble(cut).collect()} == {1: "missing", 2: "length", 3: "ok"}


def archive(n, gap=": "):
    """n responses, each a gzip member of its own."""
    one = lambda i: "\r\n".join(["WARC/1.1", *(k + gap + v for k, v in (("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{i}:0>"), ("Content-Length", "9"))), "", f"A: b\r\n\r\n{i}", "", ""])
    return [gzip.compress(one(i).encode()) for i in range(n)]


def test_archives_are_read_as_far_as_they_are_whole(spark, tmp_path):
    whole, loose = archive(5), archive(2, gap=":")
    files = {"whole": b"".join(whole), "loose": b"".join(loose), "cut": b"".join(whole)[:-20], "noise": b"".join(whole[:2]) + b"no gzip", "text": gzip.compress(b"no record at all"), "empty": b""}
    short = gzip.decompress(b"".join(whole))
    files["short"] = gzip.compress(short[: len(short) - 6])
    for name, data in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(data)
    got = {}
    for name in files:
        rows = warc.reassemble(warc.read_records(spark, str(tmp_path / name))).collect()
        got[name] = (sorted(bytes(r.payload).decode() for r in rows if r.status == "ok"), sum(r.status == "archive" and r.record_type == "broken" for r in rows))
    assert got == {
        "whole": (list("01234"), 0), "loose": (list("01"), 0), "cut": (list("0123"), 1), "noise": (list("01"), 1),
        "text": ([], 1), "empty": ([], 0), "short": (list("0123"), 1),
    }


def test_members_that_end_within_pieces(monkeypatch):
    data = b"".join(archive(40))
    for piece in (1, 7, 100, len(data)):
        monkeypatch.setattr(warc, "PIECE", piece)
        assert warc.inflated(data) == (gzip.decompress(data), True)
        assert warc.inflated(data[:-1])[1] is False


def test_chunked_framing():
    for body in (b"", b"a", b"\r\n0\r\n\r\n" * 50):
        assert warc.dechunked(warc.chunked(body, 7)) == body
    assert warc.dechunked(b"5\r\nab\r\n") is None and warc.dechunked(b"zz") is None


def test_warc_of_nothing(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


CONVERSATIONS = "conv_id long, turn long, role string, text string, formatted string, loss_from int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "f", 1) for r in rows], CONVERSATIONS)


def test_chat_reads_back_what_was_said(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\<", "[", "", None, "\u00e9\U0001f389\n\n", "a" * 3000, "<s>[INST:user]\nx[/INST]</s>\n", "]\n"]
    rows = [(k, t, ("user", "assistant", "system", None, "]\n[x")[t % 5], odd[(k + t) % len(odd)]) for k in range(7) for t in range(k + 1)]
    rows += [(3, 1, "assistant", "repeated turn"), (3, 1, "assistant", "repeated turn"), (None, None, None, None), (None, 1, "assistant", "x")]
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(conversations(spark, rows))).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_no_text_makes_a_control_string(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]")]
    full = "".join(r.formatted for r in chat.format_turns(conversations(spark, rows)).collect())
    assert full.count("</s>") - full.count("\\</s>") == 2 and full.count("<s>[INST:") == 2


def test_assemble_scatters_slices():
    a, b = pa.array(["x", "", "é", "long text"]).slice(1), pa.array(["1", "2", "3"])
    assert chat.assemble(a, b, a).to_pylist() == ["1", "é2é", "long text3long text"]
    assert chat.assemble(pa.array([], pa.string())).to_pylist() == []


def test_chat_of_nothing(spark):
    assert chat.conversation_digests(chat.format_turns(conversations(spark, []))).collect() == []


@pytest.fixture(scope="module")
def coder():
    return bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_bpe_matches_the_library(spark, coder):
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    odd = ["a\u3000 b  \t c\n\n  x'll I'M don't 12345 \u00bd\u0661\u0662 \u65e5\u672c\u8a9e \U0001f389\U0001f468\u200d\U0001f469", "x" * 700 + "\u00e9" * 300, "<|endoftext|>", "\x85\u2028\ufeff \x1c", "   "]
    rng = random.Random(4)
    odd += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(100_000)), "y" * 100_000, "ab" * 128 + " " + "ab" * 129, " " * 3000 + "z", "\u00e9\u65e5" * 500]
    rows = [*documents()[:40], *((1000 + k, t) for k, t in enumerate(odd)), (2000, None), (2001, "")]
    for size in (0, 200):
        out = coder.encode(frame(spark, rows), dictionary_words=size)
        got = out.select("text", "ids", coder.decode(F.col("ids")).alias("back"), coder.id_bytes(F.col("ids")).alias("le")).collect()
        assert len(got) == len(rows)
        for r in got:
            ids = want.encode_ordinary(r.text or "")
            assert list(r.ids) == ids and bytes(r.back) == (r.text or "").encode() and bytes(r.le) == struct.pack(f"<{len(ids)}I", *ids)


def test_bpe_keeps_columns_and_replaces_its_own(spark, coder):
    docs = frame(spark, documents()[:5]).selectExpr("*", "1 AS ids", "'a' AS words", "'b' AS LONG", "2 AS folded", "3 AS texts", "4 AS ranks")
    out = coder.encode(docs, dictionary_words=10)
    assert sorted(out.columns) == sorted(docs.columns)
    assert {(r.words, r.LONG, r.folded, r.texts, r.ranks) for r in out.collect()} == {("a", "b", 2, 3, 4)}


def test_unusual_vocabularies_are_refused(coder):
    with pytest.raises(ValueError):
        bpe.merge_table({b"a": 0})
    with pytest.raises(ValueError):
        bpe.merge_table({**{bytes([b]): b for b in range(256)}, b"abc": 300})


def test_bpe_of_nothing(spark, coder):
    assert coder.encode(frame(spark, [])).collect() == []
