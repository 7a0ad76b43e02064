"""Quality scores by Bradley-Terry pairwise ranking.

A document's merit is a weighted sum of features of its text; in a preference pair the better document wins with a
chance that is the logistic function of the difference in merit. The weights are learnt from pairs of labelled
documents, and documents are kept from a quantile of the labelled scores upwards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.llm.common import fields_of, map_arrow, quoted, table, text_slices

MARKS = [ord(c) for c in "!?.,;:*$%&#|@/<>{}[]()=_-'\""]
SAMPLE_ROWS = 20_000  #: labelled rows that a fit uses at most
PAIRS = 60_000  #: preference pairs drawn from them
KEEP_AT = 0.7  #: the score of the quantile from which documents are kept


def features(text: str) -> list[float]:
    """Shape, characters, words and repetition of the whole text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    seen = np.bincount(raw, minlength=256)
    words, lines = text.split(), text.split("\n")
    n, nw, nl = max(1, len(raw)), max(1, len(words)), len(lines)
    top_word = max(Counter(words).values(), default=0)
    return [
        np.log1p(n), seen[65:91].sum() / n, seen[48:58].sum() / n, seen[128:].sum() / n, seen[10] / n, seen[32] / n,
        *np.log1p(100 * seen[MARKS] / nw),
        len(set(words)) / nw, len(set(lines)) / nl, n / nw, np.log1p(nl), np.log1p(n / nl), max(map(len, words), default=0) ** 0.5,
        sum(len(w) > 1 and w.isupper() for w in words) / nw, sum(not w[-1].isalnum() for w in words) / nw,
        max(Counter(lines).values()) / nl, top_word / nw, sum(w[0].isupper() for w in words) / nw, len(set(zip(words, words[1:], strict=False))) / nw,
    ]


@dataclass
class PairwiseRanker:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float  # the merit at the chosen quantile
    spread: float

    def merit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; KEEP_AT at the cut."""
        z = (self.merit(x) - self.cut) / self.spread + np.log(KEEP_AT / (1 - KEEP_AT))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, quantile: float | None = None) -> PairwiseRanker:
    """Newton steps on the logistic loss of feature differences (better - worse).

    quantile: of the labelled merits, from which documents count as good; by default the one that errs least on the
    labelled rows. With one label only the weights are 0 and each score is KEEP_AT.
    """
    k = x.shape[1] if x.ndim == 2 else len(features(""))
    centre, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(k), np.ones(k))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return PairwiseRanker(centre, scale, np.zeros(k), 0.0, 1.0)
    draw = np.random.default_rng(1)
    z = (x - centre) / scale
    d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w = np.zeros(k)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -50, 50)))
        gradient = d.T @ (1 - p) / len(d) - ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(k), gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    merit = z @ w
    if quantile is None:
        order = np.argsort(merit, kind="stable")
        errors = np.concatenate([[0], np.cumsum(label[order])]) + (label == 0).sum() - np.concatenate([[0], np.cumsum(label[order] == 0)])
        best = np.flatnonzero(errors == errors.min())
        quantile = float(best[len(best) // 2]) / len(merit)
    return PairwiseRanker(centre, scale, w, float(np.quantile(merit, quantile)), max(1e-9, float(np.median(np.abs(merit - np.median(merit))))))


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, label, text) of at most `most` labelled documents, by a hash of the id.

    Labels other than 0 and 1 and null ids are left out; an id with several labels counts by the largest, and of rows that
    repeat an id the one with the least text counts.
    """
    some = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")  # `most` rows
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def labelled_features(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (0 or 1) of at most `most` rows of labels (doc_id, label), by a hash of the id."""
    met = labelled(docs, labels, most)

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for labels_, texts in text_slices(b["label"], b["text"]):
                yield {"label": labels_, "x": [features(t) for t in texts]}

    rows = map_arrow(met.select("label", "text"), "label int, x array<double>", each).collect()  # at most `most`
    return np.array([r["x"] for r in rows], float).reshape(len(rows), len(features(""))), np.array([r["label"] for r in rows], int)


def quality_scores(docs: DataFrame, model: PairwiseRanker, *keep: str) -> DataFrame:
    """doc_id, the columns named in `keep`, and score for each row of docs.

    A null text scores as an empty one; nulls in other columns, repeated rows and null ids are scored row by row. A kept
    column named score gives way to this one.
    """
    whole = docs.select("doc_id", "text", *(quoted(c) for c in keep if c not in ("doc_id", "text", "score")))
    fields = fields_of(whole, *(() if "text" in keep else ("text",)))

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            x = [features(t) for _, texts in text_slices(b["text"], b["text"]) for t in texts]
            yield {**b, "score": model.score(np.array(x))}

    return map_arrow(whole, f"{fields}, score double", each)


def train(docs: DataFrame, labels: DataFrame) -> PairwiseRanker:
    """A ranker from labels (doc_id, label), label 1 for the better documents; nulls and repeats as in labelled().

    Without rows of both labels the weights are 0 and each score is KEEP_AT.
    """
    return fit(*labelled_features(docs, labels))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; learns from labels that are not held out. Nulls, empties and repeats as in quality_scores."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(~held).select("doc_id", F.col("quality").alias("label"))
    scored = quality_scores(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
