"""Label embeddings from co-occurrence in cases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_counts(log: DataFrame, window: int = 3) -> DataFrame:
    """(a, b, n): labels at most `window` events apart in a case, in both directions."""
    w = Window.partitionBy("case_id").orderBy("seq")
    seen = log.select("activity", F.array(*(F.lag("activity", i).over(w) for i in range(1, window + 1))).alias("before"))
    t = seen.where("activity is not null").select(F.explode("before").alias("a"), F.col("activity").alias("b")).where("a is not null")
    return t.unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("n"))


def ppmi(counts: DataFrame) -> DataFrame:
    """max(ln(n * total / (n_a * n_b)), 0) for each pair."""
    of = lambda *k: F.sum("n").over(Window.partitionBy(*k) if k else Window.partitionBy(F.lit(0)))  # noqa: E731  a row for each pair of labels
    return counts.select("a", "b", "n", F.round(F.greatest(F.log(F.col("n") * of() / (of("a") * of("b"))), F.lit(0.0)), 6).alias("ppmi"))


def embed(matrix: DataFrame, size: int) -> dict[str, np.ndarray]:
    """U * sqrt(S) of the pair matrix, a vector for each label; the matrix is labels by labels."""
    rows = matrix.select("a", "b", "ppmi").collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r["a"]], at[r["b"]]] = r["ppmi"]
    u, s, _ = np.linalg.svd(m)
    z = (u * np.sqrt(s))[:, :size]
    return {n: np.pad(z[i], (0, max(0, size - z.shape[1]))) for n, i in at.items()}


def word2vec(log: DataFrame, size: int = 8, window: int = 3, seed: int = 1) -> DataFrame:
    """Skip-gram vectors of labels, over each case's labels in order (a case's labels are one sentence)."""
    from pyspark.ml.feature import Word2Vec

    sentences = log.where("activity is not null").groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "activity"))), lambda x: x["activity"]).alias("labels"))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=1, seed=seed, inputCol="labels", outputCol="v").fit(sentences)
    return model.getVectors()
