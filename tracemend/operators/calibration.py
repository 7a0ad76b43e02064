"""Calibration of confidences, with Spark's own estimators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def platt(rows: DataFrame, confidence: str, right: str) -> tuple[float, float]:
    """a and b of logistic(a * confidence + b), fitted to whether labels were right; (1, 0) for one class only."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    t = rows.select(array_to_vector(F.array(F.col(confidence).cast("double"))).alias("features"), F.col(right).cast("double").alias("label"))
    if t.select("label").distinct().count() < 2:
        return 1.0, 0.0
    m = LogisticRegression(maxIter=50, standardization=False).fit(t)
    return float(m.coefficients[0]), float(m.intercept)


def apply_platt(confidence: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(confidence * a + b)))


def isotonic(rows: DataFrame, confidence: str, right: str):
    """A fitted monotone map; transform() adds the column prediction."""
    from pyspark.ml.regression import IsotonicRegression

    t = rows.select(F.col(confidence).cast("double").alias("features"), F.col(right).cast("double").alias("label"))
    return IsotonicRegression().fit(t)


def temperature(rows: DataFrame, scores: str, truth: str, low: float = 0.05, high: float = 20.0, steps: int = 24) -> float:
    """The temperature of softmax(scores / T) with the least cross-entropy, from one pass over a grid.

    scores: an array of logits, truth: the position of the right one. 1.0 where there are under two rows.
    """
    ratio = (high / low) ** (1 / (steps - 1))
    grid = [low * ratio**i for i in range(steps)]

    def loss(t: float) -> Column:
        z = F.transform(scores, lambda s: (s - F.array_max(scores)) / t)
        return F.log(F.aggregate(z, F.lit(0.0), lambda a, s: a + F.exp(s))) - F.get(z, F.col(truth))

    got = rows.agg(F.count("*").alias("n"), *(F.avg(loss(t)).alias(f"l{i}") for i, t in enumerate(grid))).first()
    return 1.0 if got["n"] < 2 else grid[min(range(steps), key=lambda i: got[f"l{i}"])]


def softmax(scores: Column, t: float, blocked: tuple[int, ...] = ()) -> Column:
    """Probabilities at temperature t; blocked positions (pad, missing) get 0."""
    at = F.transform(scores, lambda s, i: F.when(i.isin(*blocked), 0.0).otherwise(F.exp((s - F.array_max(scores)) / t)) if blocked else F.exp((s - F.array_max(scores)) / t))
    total = F.aggregate(at, F.lit(0.0), lambda a, x: a + x)
    return F.transform(at, lambda x: x / total)
