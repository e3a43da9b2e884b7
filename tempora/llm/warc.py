"""WARC archives: written as segmented records with chunked bodies, read back and reassembled.

Archives are written by Spark's text sink, one record a row: a record ends with two line breaks, which is the sink's
line separator; files are compressed whole. A record larger than `segment_bytes` is split into a first record and continuation records. Reading
parses each archive once into records; Spark groups segments by origin identifier, and a group is put in order by segment
number, checked against its total length and relieved of its chunked framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stage

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE, READ_RECORDS, PIECE = 16384, 4096, 4096, 256, 65536
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, kind string, number int, origin string, total long, digest string, refers_to long, page_id long, url string, block binary"
PAYLOADS = "page_id long, url string, record_type string, refers_to long, declared string, status string, payload binary"


def base32(sha1: Column) -> Column:
    """Bare upper-case base32 of a hexadecimal SHA-1: each five digits are four letters."""
    part = lambda g: F.conv(F.substring(sha1, g * 5 + 1, F.lit(5)), 16, 10).cast("int")
    letter = lambda v, k: F.substring(F.lit(BASE32), F.shiftright(v, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.concat(*[letter(part(g), k) for k in range(4)])), "")


def chunked(body: bytes, size: int) -> bytes:
    cut = (body[i : i + size] for i in range(0, len(body), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cut) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes | None:
    """The body, or None where the framing is broken."""
    out, at = [], 0
    while (end := framed.find(b"\r\n", at)) >= 0:
        try:
            size = int(framed[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        at = end + 2 + size + 2
        if framed[at - 2 : at] != b"\r\n":
            return None
        out.append(framed[end + 2 : at - 2])
    return None


def _head(fields: dict[str, object]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n").encode()


def _records(date: str, page_id: object, key: int, url: str, payload: bytes, digest: str, first: object, revisit: bool, segment: int) -> Iterator[bytes]:
    name = f"<urn:page:{page_id}:{key}>"
    common = {"WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if revisit:
        yield _head({"WARC-Type": "revisit", "WARC-Record-ID": name, "WARC-Refers-To": f"<urn:page:{first}>", "WARC-Profile": PROFILE} | common | {"Content-Length": len(HTTP)}) + HTTP
        return
    block = HTTP + chunked(payload, CHUNK_BYTES)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for n, part in enumerate(parts, 1):
        own = {"WARC-Type": "response", "WARC-Record-ID": name} | common if n == 1 else {"WARC-Type": "continuation", "WARC-Date": date, "WARC-Record-ID": f"<urn:page:{page_id}:{key}:{n}>", "WARC-Segment-Origin-ID": name}
        split = {"WARC-Segment-Number": n, "WARC-Segment-Total-Length": len(block) if n == len(parts) else None} if len(parts) > 1 else {}
        yield _head(own | split | {"Content-Length": len(part)}) + part


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record for each row of pages (page_id, url, html) below `path`.

    Of rows with equal payloads of at least `min_revisit_bytes` bytes those with the smallest page_id are responses, the
    others revisits of it; smaller payloads are all responses. Null html is empty, a null url is empty, a null id comes
    after all others. Line breaks in a url become spaces.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ").alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id")
    first = stage(rows.groupBy("sha1").agg(F.min(order).alias("first")), "first-payloads")
    rows = rows.join(first, "sha1").select(
        "page_id", F.monotonically_increasing_id().alias("key"), "url", "payload", base32(F.col("sha1")).alias("digest"), F.col("first.page_id").alias("first_id"),
        (~F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.octet_length("payload") >= min_revisit_bytes)).alias("revisit"),
    )

    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [(None if pd.isna(i) else int(i), None if pd.isna(f) else int(f)) for i, f in zip(b.page_id, b.first_id, strict=True)]
            yield pd.DataFrame({"record": [r for (i, f), k, u, p, d, again in zip(ids, b.key, b.url, b.payload, b.digest, b.revisit, strict=True) for r in _records(date, i, k, u, bytes(p), d, f, again, segment_bytes)]})

    out = rows.mapInPandas(build, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def _page(name: str | None) -> int | None:
    found = re.match(r"<urn:page:(-?\d+)", name or "")
    return int(found[1]) if found else None


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"\d{1,18}", text) else None


def inflated(content: bytes) -> tuple[bytes, bool]:
    """What can be read of a gzip file of any number of members, and whether that is all of it."""
    out, member = [], None
    for at in range(0, len(content), PIECE):
        data = content[at : at + PIECE]
        while data:
            member = member or zlib.decompressobj(wbits=31)
            try:
                out.append(member.decompress(data))
            except zlib.error:
                return b"".join(out), False
            data, member = (member.unused_data, None) if member.eof else (b"", member)
    return b"".join(out), member is None


def _parsed(content: bytes) -> Iterator[tuple]:
    """The records up to the first that is cut off or not one; from there on a record of the kind `broken` stands for the rest."""
    content, whole = inflated(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at : max(end, at)].decode(errors="replace").split("\r\n")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, name = _number(h.get("content-length")), h.get("warc-record-id")
        if end < 0 or not lines[0].startswith("WARC/") or size is None or not name or end + 4 + size > len(content):
            whole = False
            break
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        number = _number(h.get("warc-segment-number")) or 0
        total = _number(h.get("warc-segment-total-length"))
        yield (name, h.get("warc-type"), number, h.get("warc-segment-origin-id", name), total, digest, _page(h.get("warc-refers-to")), _page(name), h.get("warc-target-uri"), content[end + 4 : end + 4 + size])
        at = end + 4 + size + 4
    if not whole:
        yield (None, "broken", 0, None, None, None, None, None, None, b"")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below `path`, whose files are gzip files of one or many members.

    Of a file that is cut off or damaged the records before that place are read; one row more has the kind `broken`.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for b in batches:
            for content in b.content:
                records = _parsed(content)
                while part := list(islice(records, READ_RECORDS)):
                    yield pd.DataFrame(part, columns=names).astype({"total": "Int64", "refers_to": "Int64", "page_id": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """One row for each response or revisit, with the decoded payload of responses.

    Segments are grouped by origin identifier; `status` is ok, missing (a segment is absent), length (the total differs),
    framing (the chunked framing is broken) or archive (a row that stands for the unread rest of a damaged archive, of the
    type `broken`), and the payload is null unless it is ok.
    """
    whole = records.filter("number = 0").select("kind", "page_id", "url", "refers_to", "digest", F.array(F.struct("number", "block")).alias("parts"), F.lit(None).cast("long").alias("total"))
    split = records.filter("number > 0").groupBy("origin").agg(
        F.max(F.when(F.col("number") == 1, F.struct("kind", "page_id", "url", "refers_to", "digest"))).alias("head"),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
    ).select("head.*", "parts", "total")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, page, url, refers, digest, parts, total in b.itertuples(index=False):
                numbers = [p["number"] for p in parts]
                block = b"".join(bytes(p["block"]) for p in parts)
                payload, status = None, "ok"
                if kind == "broken":
                    status = "archive"
                elif numbers != [0] and (numbers != list(range(1, len(numbers) + 1)) or pd.isna(total)):
                    status = "missing"
                elif numbers != [0] and len(block) != total:
                    status = "length"
                elif kind == "response":
                    head, _, body = block.partition(b"\r\n\r\n")
                    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    status = "framing" if payload is None else "ok"
                out.append((page, url, kind, refers, digest, status, payload))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAYLOADS.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return whole.unionByName(split).mapInPandas(decode, PAYLOADS)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, path: str | None = None) -> DataFrame:
    """Write archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to for each row.

    The size and digest of a revisit are those of the response that it refers to.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes, segment_bytes)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            full = [None if p is None else bytes(p) for p in b.pop("payload")]
            b["payload_bytes"] = pd.array([None if p is None else len(p) for p in full], "Int64")
            b["payload_digest"] = [None if p is None else base64.b32encode(hashlib.sha1(p).digest()).decode() for p in full]
            yield b

    kinds = PAYLOADS.replace("payload binary", "payload_bytes long, payload_digest string")
    rows = reassemble(read_records(spark, path)).mapInPandas(digests, kinds)
    rows = stage(rows, "warc-payloads")
    found = rows.filter("record_type = 'response'")
    have = found.select(F.col("page_id").alias("_id"), "payload_bytes", "payload_digest").distinct()
    again = rows.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "declared")
    again = again.join(have, again.refers_to.eqNullSafe(have["_id"]) & (again.declared == have.payload_digest))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.select(*columns).unionByName(again.select(*columns))
