"""The boundary to models: encoders and scorers, with deterministic defaults that run anywhere.

The defaults are lexical stand-ins, not models: an encoder hashes terms, a scorer measures their overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms, token_recall


#: How much of an exception's text is kept.
ERROR_CHARS = 500


class TextEncoder(Protocol):
    """Made once for a task; encodes a batch of texts to vectors of one length."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w.encode())
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def encode(rows: DataFrame, text: str, into: str, make: Callable[[], TextEncoder] = HashingEncoder, error: str | None = None) -> DataFrame:
    """rows with vectors; the encoder is made once for each task and takes whole Arrow batches.

    With `error`, a column of that name says why a text has no vector, and the vector is null there: a batch that fails is encoded
    text by text. Without it the encoder's exception ends the job.
    """

    @F.pandas_udf("vector array<float>, error string")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = make()

        def one(value: str) -> tuple[list | None, str | None]:
            try:
                return list(encoder([value])[0]), None
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}"[:ERROR_CHARS]

        for b in batches:
            values = b.fillna("").tolist()
            try:
                told = [(v, None) for v in encoder(values)]
            except Exception:  # noqa: BLE001
                if error is None:
                    raise
                told = [one(v) for v in values]
            yield pd.DataFrame({"vector": [v for v, _ in told], "error": [e for _, e in told]})

    out = rows.withColumn("_encoded", vectors(F.col(text))).withColumn(into, F.col("_encoded.vector"))
    return (out if error is None else out.withColumn(error, F.col("_encoded.error"))).drop("_encoded")


def sparse_terms(text: Column) -> Column:
    """term -> weight of a text: how often it stands there."""
    # Sorted, a term's occurrences lie together: their number is the distance between the places where terms change.
    own = F.array_sort(terms(text))
    heads = F.filter(F.transform(own, lambda x, i: F.when((i == 0) | (x != F.get(own, i - 1)), F.struct(x.alias("t"), i.alias("i")))), lambda h: h.isNotNull())
    ends = F.concat(F.transform(F.slice(heads, F.lit(2), F.size(heads)), lambda h: h["i"]), F.array(F.size(own)))
    pairs = F.zip_with(heads, F.slice(ends, F.lit(1), F.size(heads)), lambda h, e: F.struct(h["t"], (e - h["i"]).cast("float")))
    return F.map_from_entries(pairs)


def triad(rows: DataFrame) -> DataFrame:
    """rows (query, context, answer) with the default scores: overlap of answer, context and query."""
    recall = lambda got, want: token_recall(F.coalesce(F.col(got), F.lit("")), F.coalesce(F.col(want), F.lit("")))
    return rows.withColumns({"score_relevance": recall("context", "query"), "score_ground": recall("context", "answer"), "score_answer_relevance": recall("answer", "query")})


def judge() -> Column:
    """The default judge: one to five by the mean of the three scores."""
    mean = (F.col("score_relevance") + F.col("score_ground") + F.col("score_answer_relevance")) / 3
    return F.greatest(F.lit(1), F.least(F.lit(5), F.floor(mean * 5).cast("int") + 1))


def answer(selected: DataFrame) -> DataFrame:
    """The default generator is extractive: the text of a query's best item."""
    return selected.groupBy("query_id").agg(F.max_by("text", "value").alias("answer"))
