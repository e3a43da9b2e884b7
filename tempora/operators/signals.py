"""Frame and sound gates over label lists and sample arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import rms, softmax

#: Classes of frames that carry information, and the edge density that does.
INFO_LABELS, EDGE_DENSITY = ("laptop", "tv", "cell phone", "book"), 0.06
RMS_EPSILON, TOP_TAGS = 0.01, 3


def informative(labels: Column, density: Column, wanted: tuple[str, ...] = INFO_LABELS, least: float = EDGE_DENSITY) -> Column:
    return F.coalesce(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in wanted])), F.lit(False)) | F.coalesce(density > least, F.lit(False))


def rms_gate(rows: DataFrame, samples: str, epsilon: float = RMS_EPSILON) -> DataFrame:
    """rows with rms, skipped and the reason; silent rows need no tagger."""
    quiet = F.col("rms") < epsilon
    return rows.withColumn("rms", rms(F.col(samples))).withColumns({"skipped": quiet, "reason": F.when(quiet, "rms_below_epsilon")})


def top_tags(logits: Column, labels: list[str], k: int = TOP_TAGS) -> Column:
    """The k likeliest labels with their probability, four decimals; ties go to the earlier label."""
    names = F.array(*[F.lit(x) for x in labels])
    scored = F.transform(softmax(logits), lambda p, i: F.struct((-p).alias("order"), i.alias("i")))
    best = F.slice(F.array_sort(scored), 1, k)
    return F.transform(best, lambda t: F.struct(F.get(names, t["i"]).alias("label"), F.round(-t["order"], 4).alias("score")))
