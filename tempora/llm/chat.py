"""Chat formatting by columnar byte assembly.

A turn becomes `<s>[INST:role]` line break, text, `[/INST]</s>` line break. Backslash, `<` and `[` inside a text (and `]`
inside a role) get a backslash before them, so no control string can come from a text and every text can be read back.
For each Arrow batch segment lengths, offsets and scatter indices are numpy arrays, and headers, contents and footers are
copied into one preallocated buffer. The loss covers the contents of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOOTER = "[/INST]</s>\n"
TURNS = "conv_id long, turn long, formatted string, loss_from long, loss_to long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
HEADER = re.compile(r"<s>\[INST:((?:[^\\\]]|\\.)*)\]\n", re.DOTALL)


def escaped(text: pa.Array, marks: str = "<[") -> pa.Array:
    for mark in "\\" + marks:
        text = pc.replace_substring(text, mark, "\\" + mark)
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and data of a string array."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def assemble(*columns: pa.Array) -> pa.Array:
    """Rowwise concatenation of string arrays in one preallocated buffer."""
    parts = [_bytes(c) for c in columns]
    lengths = np.stack([np.diff(o) for o, _ in parts], axis=1)
    starts = np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(int(starts[-1]), np.uint8)
    at = starts[:-1].reshape(lengths.shape)
    for k, (offsets, data) in enumerate(parts):
        n = lengths[:, k]
        to = np.repeat(at[:, k] - offsets[:-1], n) + np.arange(offsets[0], offsets[-1])
        out[to] = data[offsets[0] : offsets[-1]]
    ends = starts[:: lengths.shape[1]] if len(lengths) else np.zeros(1, np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(out))


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        role, text = (pc.fill_null(b.column(k), "").cast(pa.large_string()) for k in (2, 3))
        n = len(role)
        fixed = lambda s: pa.array([s], pa.large_string()).take(pa.array(np.zeros(n, np.int64)))  # noqa: B023, E731
        head = assemble(fixed("<s>[INST:"), escaped(role, "<[]"), fixed("]\n"))
        body = escaped(text)
        full = assemble(head, body, fixed(FOOTER))
        start = pc.utf8_length(head).to_numpy(zero_copy_only=False).astype(np.int64)
        own = pc.equal(role, "assistant").to_numpy(zero_copy_only=False)
        stop = np.where(own, start + pc.utf8_length(body).to_numpy(zero_copy_only=False), start)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), full.cast(pa.string()), pa.array(start), pa.array(stop.astype(np.int64))], names=["conv_id", "turn", "formatted", "loss_from", "loss_to"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row for each turn: conv_id, turn, formatted, and the code points [loss_from, loss_to) that carry the loss.

    The rows of a conversation lie together, by turn (ties by role, then text), so that their concatenation is the
    conversation's text. Null roles and texts are empty. Rows without conv_id form one conversation.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_formatted, TURNS)


class _Digest:
    """What one conversation says, read back from its formatted turns; takes a turn at a time."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, stop: int) -> None:
        head = HEADER.match(formatted)
        text = unescaped(formatted[head.end() : -len(FOOTER)])
        self.all.update(f"{unescaped(head[1])}\n{text}\n".encode())
        part = unescaped(formatted[start:stop])
        self.loss.update(part.encode())
        self.turns, self.chars, self.loss_chars = self.turns + 1, self.chars + len(formatted), self.loss_chars + len(part)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in k else pa.int64()) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)
    now: _Digest | None = None
    for b in batches:
        done = []
        for conv, _, formatted, start, stop in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or now.conv_id != conv:
                done += [now.row()] if now else []
                now = _Digest(conv)
            now.add(formatted, start, stop)
        if done:
            yield emit(done)
    if now:
        yield emit([now.row()])


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation of format_turns(); reads its rows in order and keeps one conversation's state."""
    return turns.mapInArrow(_digested, DIGESTS)
