"""Text expressions: normal form, overlap, sentence ends, judge verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = "[a-z0-9]+"


def normalize(text: Column) -> Column:
    """Lower case, runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def token_recall(generated: Column, expected: Column) -> Column:
    """Share of the expected distinct words that were generated; 0 where none is expected."""
    want = F.array_distinct(tokens(expected))
    return F.when(F.size(want) > 0, F.size(F.array_intersect(tokens(F.coalesce(generated, F.lit(""))), want)) / F.size(want)).otherwise(0.0)


def terms(text: Column) -> Column:
    """Lexical terms: runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERMS), F.lit(0))


def ends_sentence(word: Column) -> Column:
    return F.rlike(word, F.lit("[.!?…]+"))


def judge_score(reply: Column) -> Column:
    """The digit after [RESULT]; 1 where there is none."""
    return F.coalesce(F.regexp_extract(reply, r"\[RESULT\]\s*(\d)", 1).try_cast("int"), F.lit(1))


def clamp_hops(hops: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.coalesce(hops.try_cast("int"), F.lit(1)), F.lit(5)))
