"""Content identity and time arithmetic of media files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 1 << 20


def window_offset(size: Column) -> Column:
    """Where the middle mebibyte begins; 0 for files no larger than that."""
    return F.when(size <= WINDOW, F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor(size / 2).cast("long") - WINDOW // 2)).cast("long")


def middle_bytes(content: Column, size: Column) -> Column:
    return F.substring(content, (window_offset(size) + 1).cast("int"), F.lit(WINDOW))


def content_id(content: Column, size: Column, duration: Column) -> Column:
    """MD5 of the middle window and a tag of size and duration; empty files have none."""
    tag = F.format_string("|SIZE=%d|DUR=%.3f|", size, duration)
    return F.when(size > 0, F.md5(F.concat(middle_bytes(content, size), F.encode(tag, "utf-8"))))


def mid_frame(start: Column, end: Column, fps: Column) -> tuple[Column, Column]:
    """The middle of a scene in seconds and as a frame number; 25 frames a second where unknown."""
    mid = (start + end) / 2
    return mid, (mid * F.when(fps > 0, fps).otherwise(25.0)).cast("int")


def keyframe_name(scene: Column, frame: Column) -> Column:
    return F.format_string("scene_%04d_f%d.jpg", scene, frame)


def ocr_threshold(variance: Column, boundary: Column, low: Column, high: Column) -> Column:
    return F.when(variance < boundary, low).otherwise(high)


def certificate(score: Column, verified: float = 0.55, partial: float = 0.30) -> Column:
    return F.when(score >= verified, "verified").when(score >= partial, "partial").otherwise("unsupported")
