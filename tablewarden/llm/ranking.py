"""Quality scores from preference pairs (Bradley-Terry), applied in built-in expressions.

A pair says that one document is better than another.  Each document has a
worth, linear in features of its whole text, and the better one of a pair wins
with probability sigmoid(worth difference): logistic regression on feature
differences without an intercept.  Documents pass when their worth reaches a
quantile of the training documents' worth, by default the share of those
labelled bad; the score puts that quantile at `cut`.

Training: about `fit_rows` labelled documents, chosen by hash of the id; where they
have more than twice as many texts, about `fit_rows` of those by hash.  Each meets `pairs` documents of the other label; only their features, 12 numbers each,
reach the driver.  Scoring is one narrow scan of the
whole table: a sum of products, without a shuffle and without Python.

Defined results: null and empty texts have all counts 0 and a score like any
other.  Without labels of both kinds every score is the share of good ones, or
0.5 without labels.  Labels of one document that disagree all count; repeated
rows count once in training and get equal scores.  Very long texts are read whole.
Empty tables give empty results.  Columns pass through, but score and predicted
(and one called __x) are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small, words

FIT_ROWS, PAIRS, ROUNDS, PENALTY = 20_000, 8, 30, 1e-2
CUT = 0.3
#: Standardised features stay within so many deviations.
CLIP = 4.0


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `__x`, the features of the whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    then = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    each = lambda a, b: a / F.greatest(b, F.lit(1))

    def of(w: Column, found: Column) -> Column:
        counts = {
            "n": F.size(w), "d": F.size(F.array_distinct(w)), "m": F.size(found), "e": F.size(F.array_distinct(found)), "c": F.length(text), "s": count(r"[#*$%&<>]"), "p": count(r"\|"), "u": count(r"\p{Lu}"),
            "i": count(r"\p{Nd}"), "b": count("[!?]"), "o": count("[.,;:]"), "a": F.length(text) - count(r"\P{L}"),
        }
        return then(F.struct(*[v.alias(k) for k, v in counts.items()]), vector)

    def vector(k: Column) -> Column:
        share = lambda a, b: each(k[a], k[b])
        x = [
            F.log1p(k["n"]), share("a", "n"), F.log1p(20 * share("s", "n")), F.log1p(20 * share("p", "n")), F.log1p(20 * share("u", "a")), F.log1p(20 * share("i", "c")),
            F.log1p(20 * share("b", "n")), share("o", "n"), share("d", "n"), 1 - share("e", "m"), F.log1p(share("n", "m")), share("a", "c"),
        ]
        return F.array(*[v.cast("double") for v in x])

    # words and lines are bound inside one expression, so that their arrays are never written into rows
    return docs.withColumn("__x", then(words(text), lambda w: then(lines, lambda found: of(w, found))))


@dataclass(frozen=True)
class Ranking:
    """worth = weights * (features, their squares), standardised; score = sigmoid(worth - bar + logit(cut))."""

    mean: list[float]
    deviation: list[float]
    weights: list[float]
    bar: float
    cut: float
    constant: float | None = None

    def worth(self, x: Column) -> Column:
        total = F.lit(0.0)
        k = len(self.mean)
        for j, (mean, deviation) in enumerate(zip(self.mean, self.deviation, strict=True)):
            z = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (F.get(x, F.lit(j)) - mean) / deviation))
            total = total + z * self.weights[j] + z * z * self.weights[k + j]
        return total

    def score(self, x: Column) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        return 1 / (1 + F.exp(-(self.worth(x) - self.bar + math.log(self.cut / (1 - self.cut)))))


def _expanded(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / deviation, -CLIP, CLIP)
    return np.hstack([z, z * z])


def bradley_terry(better: np.ndarray, worse: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """Weights that maximise the mean log-probability of the pairs, less a quadratic penalty (Newton steps)."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-d @ w))
        slope = d.T @ (1 - p) / len(d) - penalty * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _chance(*columns: str) -> Column:
    """0 to 1, by hash."""
    return F.pmod(F.xxhash64(F.lit(10), *columns), F.lit(1 << 30)) / (1 << 30)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, pairs: int = PAIRS, cut: float = CUT) -> Ranking:
    """Learn from `labels` (id, label: 1 good, 0 bad) of `docs`; rows without a label don't count."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__id is not null and __y is not null").distinct()
    scratch = Scratch(docs.sparkSession)
    known = scratch.write(known, "labelled")
    n = known.count()
    ids = known.filter(_chance("__id") < min(1.0, fit_rows / max(n, 1)))
    few = small(ids, ids.count(), 2 * fit_rows)
    texts = docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__text")).join(few, F.col("__i") == F.col("__id")).withColumn("__t", F.xxhash64("__text"))
    # a repeated row counts once, and where ids with many texts make more rows than the bound, so many of them are taken
    found = scratch.write(features(texts, "__text").groupBy("__id", "__y", "__t").agg(F.first("__x").alias("__x")), "features")
    n = found.count()
    rows = found.filter(_chance("__id", "__t") < fit_rows / n).collect() if n > 2 * fit_rows else found.collect()
    scratch.clear()
    rows.sort(key=lambda r: (r["__id"], r["__y"], r["__x"]))
    y = np.array([r["__y"] for r in rows])
    if not len(y) or y.min() == y.max():
        return Ranking([], [], [], 0.0, cut, float(y.mean()) if len(y) else 0.5)
    x = np.array([r["__x"] for r in rows])
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = _expanded(x, mean, deviation)
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    rng = np.random.default_rng(len(y))
    most = max(len(good), len(bad))
    a = np.concatenate([rng.permutation(np.resize(rng.permutation(good), most)) for _ in range(pairs)])
    b = np.concatenate([rng.permutation(np.resize(rng.permutation(bad), most)) for _ in range(pairs)])
    weights = bradley_terry(z[a], z[b])
    bar = float(np.quantile(z @ weights, len(bad) / len(y)))
    return Ranking(mean.tolist(), deviation.tolist(), weights.tolist(), bar, cut)


def score(docs: DataFrame, ranking: Ranking, *, text_col: str = "text") -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 at `cut` or more)."""
    scored = features(docs, text_col).withColumn("score", ranking.score(F.col("__x"))).drop("__x")
    return scored.withColumn("predicted", (F.col("score") >= ranking.cut).cast("int"))
