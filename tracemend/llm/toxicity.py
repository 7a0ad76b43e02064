"""Toxicity scores by a counterfactual-regularised logistic classifier.

Features are words and word beginnings, chosen by how far their document frequencies differ between the labels. In
labelled texts that name a group, each group term is swapped for others, and the fit is penalised for what such a
swap changes in the score, so that naming a group is no evidence by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.llm.common import Scratch, map_arrow, table, text_slices
from tracemend.llm.quality import labelled

SAMPLE_ROWS = 20_000  #: labelled rows that a fit uses at most
FEATURES = 3000  #: features that are kept
LEAST_GAP = 3.0  #: standard errors by which the labels must differ on a feature
BUCKETS = 1 << 20  #: hash buckets of candidate features
SWAPS = 3  #: swapped copies of a labelled text

# Terms that name groups, those of a line may stand for each other.
IDENTITY = [
    "women men girls boys", "woman man girl boy", "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist atheist",
    "black white asian latino arab african european american", "gay lesbian straight bisexual transgender", "immigrants refugees natives foreigners",
    "femmes hommes filles garçons", "musulmans chrétiens juifs hindous", "noirs blancs arabes asiatiques", "immigrés réfugiés étrangers",
    "frauen männer mädchen jungen", "muslime christen juden hindus", "schwarze weiße araber asiaten", "einwanderer flüchtlinge ausländer",
    "mujeres hombres niñas niños", "musulmanes cristianos judíos hindúes", "negros blancos árabes asiáticos", "inmigrantes refugiados extranjeros",
]
GROUPS = [line.split() for line in IDENTITY]
GROUP_OF = {t: g for g in GROUPS for t in g}

tokens = re.compile(r"\w+").findall


def parts(word: str) -> list[str]:
    """A word whole and its beginnings of 4 to 7 characters."""
    return [word, *(f"{word[:k]}~" for k in range(4, min(8, len(word) + 1)))]


def swapped(words: set[str], shift: int) -> set[str]:
    """The words with each group term replaced by another of its line."""
    return {g[(g.index(w) + shift) % len(g)] if (g := GROUP_OF.get(w)) else w for w in words}


@dataclass
class SparseRows:
    """Rows of active feature numbers, end to end."""

    at: np.ndarray
    row: np.ndarray
    n: int

    @classmethod
    def of(cls, rows: list) -> SparseRows:
        return cls(np.concatenate([np.asarray(r, np.int64) for r in rows] or [np.empty(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def back(self, r: np.ndarray, k: int) -> np.ndarray:
        return np.bincount(self.at, r[self.row], k)


@dataclass
class ToxicityModel:
    numbers: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, words: set[str], known: dict[str, float]) -> float:
        """known: what each word met so far adds; features count once a text."""
        active: set[int] = set()
        for w in words:
            got = known.get(w)
            if got is None:
                got = tuple(self.numbers[p] for p in parts(w) if p in self.numbers)
                if len(known) < 400_000:
                    known[w] = got
            active.update(got)
        z = self.bias + sum(self.weights[i] for i in active)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(rows: list, pairs: list[tuple], label: np.ndarray, k: int, fairness: float = 3.0, ridge: float = 0.5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on: weighted logistic loss + ridge/n |w|^2 + fairness * mean squared swap difference.

    rows: active features of each text; pairs: active features of a text and of its swapped copy.
    """
    x, a, b = SparseRows.of(rows), SparseRows.of([p[0] for p in pairs]), SparseRows.of([p[1] for p in pairs])
    w, bias = np.zeros(k), 0.0
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    share = label.mean()
    cost = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + bias, -50, 50)))
        r = cost * (p - label) / x.n
        g = x.back(r, k) + ridge * w / x.n
        if pairs:
            d = a.times(w) - b.times(w)
            g += fairness * 2 * (a.back(d, k) - b.back(d, k)) / len(pairs)
        gb = r.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * (1 - 0.9 * t / steps)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / ((vb / (1 - 0.99**t)) ** 0.5 + 1e-8)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, fairness: float = 3.0) -> ToxicityModel:
    """A model from labels (doc_id, label); at most `most` labelled rows, by a hash of the id, are used.

    Without both labels each score is 0.5. Document frequencies are gathered by task and summed by bucket. The labelled
    texts are stored once, so that the passes over them do not read the corpus again. Nulls and repeats as in labelled().
    """
    import xxhash

    met = Scratch(docs.sparkSession, "toxicity").keep(labelled(docs, labels, most).select("label", "text"))

    def bucket(p: str) -> int:
        return xxhash.xxh3_64_intdigest(p) % BUCKETS

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        seen = np.zeros((2, BUCKETS), np.int32)
        n = [0, 0]
        for b in batches:
            for label, texts in text_slices(b["label"], b["text"]):
                for y, t in zip(label, texts, strict=True):
                    n[y] += 1
                    seen[y, list({bucket(p) for w in set(tokens(t.lower())) for p in parts(w)})] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield {"bucket": np.append(some, -1), "n0": np.append(seen[0, some], n[0]), "n1": np.append(seen[1, some], n[1])}

    counts = map_arrow(met, "bucket long, n0 long, n1 long", count).groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = counts.where("bucket = -1").first()
    if total is None or not total["n0"] or not total["n1"]:
        return ToxicityModel({}, np.zeros(0), 0.0)
    p, q = F.col("n1") / total["n1"], F.col("n0") / total["n0"]
    both = (F.col("n0") + F.col("n1")) / (total["n0"] + total["n1"])
    gap = (p - q) / F.sqrt(both * (1 - both) * (1 / total["n1"] + 1 / total["n0"]) + 1e-9)
    chosen = frozenset(r[0] for r in counts.where((F.col("bucket") >= 0) & (F.col("n0") + F.col("n1") >= 4) & (F.abs(gap) >= LEAST_GAP)).orderBy(F.abs(gap).desc(), "bucket").limit(FEATURES).collect())

    def active(words: set[str], names: dict[str, int] | None = None) -> list[str]:
        return sorted({p for w in words for p in parts(w) if bucket(p) in chosen})

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for label, texts in text_slices(b["label"], b["text"]):
                words = [set(tokens(t.lower())) for t in texts]
                yield {"label": label, "own": [active(w) for w in words], "swapped": [[active(swapped(w, s + 1)) for s in range(SWAPS)] if w & GROUP_OF.keys() else [] for w in words]}

    found = map_arrow(met, "label int, own array<string>, swapped array<array<string>>", rows).collect()  # `most` rows of chosen features
    names: dict[str, int] = {}
    for r in found:
        for p in (*r["own"], *(p for s in r["swapped"] for p in s)):
            names.setdefault(p, len(names))
    number = lambda ps: [names[p] for p in ps]
    pairs = [(number(r["own"]), number(s)) for r in found for s in r["swapped"]]
    w, bias = fit([number(r["own"]) for r in found], pairs, np.array([r["label"] for r in found]), len(names), fairness)
    return ToxicityModel(names, w, bias)


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score for each row of docs; a null text scores as an empty one, repeated rows and null ids are scored row by row."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        known: dict = {}
        for b in batches:
            for ids, texts in text_slices(b["doc_id"], b["text"]):
                yield {"doc_id": ids, "score": [model.score(set(tokens(t.lower())), known) for t in texts]}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, score double", each)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; learns from labels that are not held out. Nulls, empties and repeats as in toxicity_scores."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity_scores(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
