"""Toxicity by weak supervision.

Voters come from the labelled rows: a lexicon voter is a word or a word's beginning that stands out among toxic rows and
votes where it is dense enough, a pattern voter a surface trait of the text. A generative label model (two classes, voters that vote or abstain) is
fitted by expectation maximisation over the distinct vote patterns: it estimates how often each voter votes in either
class, and from the co-votes within a class how strongly voters depend on each other, so that a term and its own
beginnings do not count several times. A linear classifier (Spark ML's logistic regression) is then trained on the label
model's posteriors over the density of terms, and scores every text whole.

The fit takes at most LABELLED_ROWS labelled rows, drawn by a hash of the id; scoring and everything else covers all rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_RUN, ascii_lower, fresh, remainder
from .words import split

LABELLED_ROWS, CANDIDATES, VOTERS, MIN_SUPPORT, MIN_LOG_ODDS = 20_000, 800, 250, 3, 1.0
PREFIXES = tuple(range(3, 9))
#: Occurrences for a hundred words, of which so many are added to every text: short texts say little.
SMOOTHING, LEVELS = 100, (0.0, 0.3, 0.6, 1.0)
THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2
EDGES = r"^\p{Punct}+|\p{Punct}+$"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pattern voters: name and what it looks for. They need no labels; the label model finds out what they are worth.
PATTERNS = {"shouting": r"\b[A-Z]{5,}\b", "exclaiming": r"!{2,}", "masked": r"\b\w+[*@$#]+\w+\b"}


@dataclass
class Model:
    """Voters with what was learnt of them: terms (a beginning ends in *), then patterns (~name)."""

    voters: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = -3.0
    rates: list[tuple[float, float]] = field(default_factory=list)  # votes among clean and toxic rows
    discounts: list[float] = field(default_factory=list)
    prior: float = 0.1


def held_out(id_col: Column) -> Column:
    return remainder(id_col, FOLDS) == HELD_OUT


def _terms(text: Column) -> Column:
    """Distinct words without punctuation at their edges, and their beginnings, marked *."""
    words = F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WS_RUN), lambda w: F.regexp_replace(w, EDGES, ""))
    words = F.array_distinct(F.filter(words, lambda w: F.char_length(w) >= min(PREFIXES)))
    return F.array_distinct(F.concat(words, *[_starts(words, k) for k in PREFIXES]))


def _starts(words: Column, k: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.char_length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))


class Densities:
    """How dense each voter is in a text: occurrences for a hundred words, smoothed; 1 for a pattern that is there."""

    def __init__(self, voters: list[str]) -> None:
        self.n = len(voters)
        self.words = {v.encode(): j for j, v in enumerate(voters) if v[0] != "~" and v[-1] != "*"}
        self.starts = [(k, {v[:-1]: j for j, v in enumerate(voters) if v[-1] == "*" and len(v) == k + 1}) for k in PREFIXES]
        self.starts = [(k, t) for k, t in self.starts if t]
        self.patterns = [(re.compile(PATTERNS[v[1:]], re.ASCII), j) for j, v in enumerate(voters) if v[0] == "~"]

    def of(self, text: str | None) -> dict[int, float]:
        words = split(text, lower=True)
        found: dict[int, float] = {}
        one = 100 / (len(words) + SMOOTHING)
        for word, n in Counter(words).items():
            bare = word.strip(PUNCTUATION)
            j = self.words.get(bare)
            if j is not None:
                found[j] = found.get(j, 0.0) + n * one
            whole = bare.decode("utf-8", "replace") if self.starts else ""
            for k, table in self.starts:
                if len(whole) <= k:
                    break
                j = table.get(whole[:k])
                if j is not None:
                    found[j] = found.get(j, 0.0) + n * one
        found |= {j: 1.0 for p, j in self.patterns if p.search(text or "")}
        return found


def densities(voters: list[str]):
    """A Pandas UDF from texts to arrays of densities."""
    counter = Densities(voters)

    @F.pandas_udf("array<double>")
    def dense(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            rows = np.zeros((len(t), counter.n))
            for i, text in enumerate(t):
                for j, x in counter.of(text).items():
                    rows[i, j] = x
            yield pd.Series(list(rows))

    return dense


def _log_odds(toxic: Column, clean: Column, n1: int, n0: int) -> Column:
    return F.log((toxic + 0.5) / F.lit(n1 + 1.0)) - F.log((clean + 0.5) / F.lit(n0 + 1.0))


def label_model(votes: np.ndarray, counts: np.ndarray, seen: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Fit voters' rates in each class: (posteriors, rates, discounts, prior).

    votes: a row of 0/1 for each pattern; counts: its rows without and with label 1; seen: the rows' total. A row's label is
    one more voter, taken to be right in 95 of 100 cases; EM starts from the labels.
    """
    trust = math.log(0.95 / 0.05)
    q = (counts[:, 1] + 0.5 * prior) / (seen + 0.5)
    discount = np.ones(votes.shape[1])
    for _ in range(rounds):
        w1, w0 = q * seen, (1 - q) * seen
        rate = np.stack([(w0 @ votes + 0.02) / (w0.sum() + 2), (w1 @ votes + 0.5) / (w1.sum() + 1)])
        prior = float(np.clip(w1.sum() / seen.sum(), 1e-4, 0.5))
        centred = votes - rate[1]
        cov = (centred * w1[:, None]).T @ centred / max(w1.sum(), 1e-9)
        sd = np.sqrt(np.clip(np.diag(cov), 1e-6, None))
        near = np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(near, 1)
        discount = 1 / np.where(near > 0.2, near, 0).sum(axis=1).clip(1)
        on, off = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
        logit = math.log(prior / (1 - prior)) + (votes * on + (1 - votes) * off) @ discount
        label = trust * (counts[:, 1] - counts[:, 0]) / seen
        q = 1 / (1 + np.exp(-np.clip(logit + label, -40, 40)))
    return q, rate, discount, prior


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows that are not held out; without any of either label, the model scores every text alike.

    A document with both labels counts as toxic; labels of no id, and other labels than 0 and 1, are not read. Rows of docs
    that share a labelled id are each learnt from. Null texts are empty; very long texts are taken whole.
    """
    own = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    # At most LABELLED_ROWS pairs of numbers, so it may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("toxic").cast("int"), "text")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model()
    clean, toxic = F.sum(1 - F.col("toxic")).alias("c"), F.sum("toxic").alias("t")
    terms = rows.select("toxic", F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(clean, toxic)
    odds = _log_odds(F.col("t"), F.col("c"), n1, n0)
    terms = terms.filter((F.col("t") >= MIN_SUPPORT) & (odds >= MIN_LOG_ODDS)).orderBy(F.desc(odds * F.sqrt("t")), "term").limit(CANDIDATES)
    terms = sorted(r.term for r in terms.collect())

    # Each term votes from the level of density on at which it tells most.
    x = rows.select("toxic", F.posexplode(densities(terms)("text")).alias("j", "x")).filter("x > 0")
    level = F.explode(F.array(*[F.lit(v) for v in LEVELS])).alias("level")
    best = x.select("toxic", "j", "x", level).filter("x >= level").groupBy("j", "level").agg(clean, toxic).filter(F.col("t") >= MIN_SUPPORT)
    best = best.select("j", F.struct((odds * F.sqrt("t")).alias("gain"), "level").alias("g")).groupBy("j").agg(F.max("g").alias("g"))
    chosen = sorted((r.j, r.g.level) for r in best.orderBy(F.desc("g.gain"), "j").limit(VOTERS).collect())
    voters = [terms[j] for j, _ in chosen] + ["~" + k for k in PATTERNS]
    levels = [v for _, v in chosen] + [0.0] * len(PATTERNS)

    dense = rows.select("toxic", densities(voters)("text").alias("x")).persist()
    try:
        votes = F.zip_with("x", F.array(*[F.lit(v) for v in levels]), lambda x, at: F.when((x > 0) & (x >= at), "1").otherwise("0"))
        patterns = dense.groupBy(F.array_join(votes, "").alias("votes")).agg(clean, toxic).orderBy("votes").toPandas()  # no more rows than the sample
        matrix = np.stack([np.frombuffer(v.encode(), np.uint8) - 48 for v in patterns.votes]).astype(float)
        counts = patterns[["c", "t"]].to_numpy(float)
        q, rate, discount, prior = label_model(matrix, counts, counts.sum(axis=1), n1 / (n0 + n1))

        posterior = docs.sparkSession.createDataFrame(list(zip(patterns.votes, map(float, q), strict=True)), "votes string, q double")
        train = dense.withColumn("votes", F.array_join(votes, "")).join(F.broadcast(posterior), "votes")
        sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("q").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("q")).alias("weight")))).alias("s")
        train = train.select(array_to_vector("x").alias("features"), sides).select("features", "s.label", "s.weight").filter("weight > 1e-6")
        linear = LogisticRegression(weightCol="weight", regParam=1e-3, standardization=False, maxIter=80).fit(train)
    finally:
        dense.unpersist()
    return Model(voters, [float(w) for w in linear.coefficients], float(linear.intercept), [(float(a), float(b)) for a, b in rate.T], [float(d) for d in discount], prior)


def scorer(model: Model):
    """A Pandas UDF from texts to probabilities."""
    counter = Densities(model.voters)
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            logit = np.array([bias + sum(weights[j] * x for j, x in counter.of(text).items()) for text in t])
            yield pd.Series(1 / (1 + np.exp(-np.clip(logit, -40, 40))))

    return probability


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with the probability that a text is toxic.

    A null text is empty; an empty one has the score that the model gives to no terms at all. Texts are taken whole, and rows
    are scored each for itself, so null or repeated ids do not matter. Other columns are kept; one named as `into` is
    replaced. An empty table gives an empty result.
    """
    return docs.withColumn(into, scorer(model)(F.coalesce(F.col(text_col), F.lit(""))))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns; see `fit` and `score`."""
    (found,) = fresh(docs, "toxicity")
    return score(docs, fit(docs, labels), into=found).filter(F.col(found) < threshold).select(*docs.columns)
