"""Label clusters as mergeable sums, distances to them, fuzzy memberships and confidences.

A cluster is its sufficient statistics n, sum z and sum z z': sums of them merge by addition, so batches and partitions
combine freely. Scoring joins each event with the clusters, a table of one row for each label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_event():
    return Window.partitionBy("vec_id")


def sufficient(points: DataFrame) -> DataFrame:
    """(label, n, sums, squares) with element-wise sums; squares of the diagonal only. points: label, z array."""
    long = points.where("label is not null").select("label", F.posexplode("z").alias("i", "v")).groupBy("label", "i").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    return long


def covariance_cells(points: DataFrame, dims: int) -> DataFrame:
    """Population covariance for each label and pair i <= j of the first `dims` dimensions."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.transform(F.sequence(i, F.lit(dims - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"), F.get("z", i).alias("x"), F.get("z", j).alias("y")))))
    cells = points.where("label is not null").select("label", F.explode(pairs).alias("c")).select("label", "c.*")
    return cells.groupBy("label", "i", "j").agg(F.round(F.avg(F.col("x") * F.col("y")) - F.avg("x") * F.avg("y"), 6).alias("covariance"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums of two sets of sufficient statistics."""
    return a.unionByName(b).groupBy("label", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def save(stats: DataFrame, path: str) -> None:
    """Sums of clusters as a table, so that a run can go on from them."""
    stats.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def decay(stats: DataFrame, labels: list, factor: float = 0.5) -> DataFrame:
    """Statistics of some labels scaled down, so that new events count more."""
    scale = F.when(F.col("label").isin(labels), factor).otherwise(1.0)
    return stats.select("label", "i", *((F.col(c) * scale).alias(c) for c in ("n", "s", "q")))


def diagonal_distances(points: DataFrame, stats: DataFrame, epsilon: float = 1e-4, least: int = 2) -> DataFrame:
    """(vec_id, label, n, d): distance of each point to each cluster of `least` events, variances plus epsilon.

    Clusters go along as one array for each label: a row for each label meets each point.
    """
    mean, var = F.col("s") / F.col("n"), F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)
    c = stats.where(F.col("n") >= least).groupBy("label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", mean.alias("m"), (var + epsilon).alias("v")))).alias("c"))  # collects dimensions
    d = F.sqrt(F.aggregate(F.zip_with("z", "c", lambda z, c: F.pow(z - c["m"], 2) / c["v"]), F.lit(0.0), lambda s, x: s + x))
    return points.select("vec_id", "z").crossJoin(F.broadcast(c)).select("vec_id", "label", "n", d.alias("d"))  # clusters: a row for each label


def memberships(distances: DataFrame, fuzzifier: float = 2.0) -> DataFrame:
    """u = d**-k / sum of d**-k over the clusters of an event, k = 2 / (fuzzifier - 1); a zero distance takes all."""
    w = F.pow(F.greatest(F.least("d", F.lit(1e10)), F.lit(1e-10)), F.lit(-2.0 / (fuzzifier - 1)))
    return distances.select("*", (w / F.sum(w).over(by_event())).alias("u"))


def confidence(members: DataFrame, mode: str = "entropy", reliable: int = 50, least: int = 2, strength: float = 1.0) -> DataFrame:
    """(vec_id, label, u, second, confidence) of each event's best cluster (ties: the smaller label).

    entropy: u (1 - H/Hmax)**strength w; margin: (u - second) w; log_combined: logistic(ln u - strength H + ln w);
    plain: u w. H is the entropy of the memberships, Hmax = ln K (1 for one cluster), w = min(1, n / reliable).
    """
    return confidences(members, [mode], reliable, least, strength).drop("mode")


def confidences(members: DataFrame, modes: list[str], reliable: int = 50, least: int = 2, strength: float = 1.0) -> DataFrame:
    """confidence() in several modes from one aggregation: a row for each event and mode."""
    agg = members.groupBy("vec_id").agg(
        F.max(F.struct("u", (-F.col("label")).alias("early"), "label", "n")).alias("b"), F.count("*").alias("k"),
        F.sum(F.when(F.col("u") > 1e-15, -F.col("u") * F.log("u")).otherwise(0.0)).alias("h"), F.sort_array(F.collect_list("u"), asc=False).alias("us"),
    )  # collects a value for each label
    u, second = F.col("b.u"), F.coalesce(F.try_element_at("us", F.lit(2)), F.lit(0.0))
    hmax = F.when(F.col("k") > 1, F.log(F.col("k").cast("double"))).otherwise(1.0)
    w = F.when(F.col("b.n") < least, 0.0).otherwise(F.least(F.lit(1.0), F.col("b.n") / reliable))
    score = {
        "entropy": u * F.pow(F.greatest(1 - F.col("h") / hmax, F.lit(0.0)), F.lit(strength)) * w, "margin": (u - second) * w,
        "log_combined": 1 / (1 + F.exp(-(F.log(u) - strength * F.col("h") + F.log(w)))), "plain": u * w,
    }
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), score[m].alias("confidence")) for m in modes))).alias("c")
    return agg.select("vec_id", F.col("b.label").alias("label"), u.alias("u"), second.alias("second"), each).select("vec_id", "c.mode", "label", "u", "second", "c.confidence")


def class_prior(scored: DataFrame, shares: DataFrame, beta: float) -> DataFrame:
    """Confidence times ((1/K) / share)**beta, at most 1. shares: label, share."""
    k = F.count("*").over(Window.partitionBy(F.lit(0)))  # a row for each label
    factor = shares.select("label", F.pow(1.0 / k / F.col("share"), F.lit(beta)).alias("factor"))
    return scored.join(F.broadcast(factor), "label", "left").withColumn("adjusted", F.least(F.col("confidence") * F.coalesce("factor", F.lit(1.0)), F.lit(1.0))).drop("factor")


def arbitrate(cluster: Column, cluster_conf: Column, other: Column, other_conf: Column, alpha: float, alpha_other: float, near: float = 0.1, margin: float = 0.05) -> tuple[Column, Column]:
    """Label and confidence where a cluster's near-threshold decision may yield to a surer other source."""
    yields = (cluster_conf < alpha + near) & (other_conf >= alpha_other) & (other_conf > cluster_conf + margin) & (other != cluster)
    keeps = cluster_conf >= alpha
    return F.when(yields, other).when(keeps, cluster), F.when(yields, other_conf).when(keeps, cluster_conf).otherwise(F.greatest(cluster_conf, other_conf))


def top_k_agrees(members: DataFrame, proposed: DataFrame, k: int) -> DataFrame:
    """Whether a proposed label is among the k likeliest clusters of its event (ties: the smaller label)."""
    rank = F.row_number().over(by_event().orderBy(F.desc("u"), "label"))
    top = members.select("vec_id", "label", rank.alias("rank")).where(F.col("rank") <= k)
    return proposed.join(top, ["vec_id", "label"], "left").select("vec_id", "label", F.col("rank").isNotNull().cast("int").alias("agrees"))


def pair_distances(stats: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    """For each pair of clusters the mean of the two distances of one's centroid under the other's variances."""
    t = stats.select("label", "i", (F.col("s") / F.col("n")).alias("m"), (F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2) + epsilon).alias("v"))
    a, b = t.select(F.col("label").alias("a"), "i", F.col("m").alias("ma"), F.col("v").alias("va")), t.select(F.col("label").alias("b"), "i", F.col("m").alias("mb"), F.col("v").alias("vb"))
    sq = F.pow(F.col("ma") - F.col("mb"), 2)
    d = a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.sqrt(F.sum(sq / F.col("va"))).alias("x"), F.sqrt(F.sum(sq / F.col("vb"))).alias("y"))
    return d.select("a", "b", F.round((F.col("x") + F.col("y")) / 2, 4).alias("distance"))


def grid(scored: DataFrame, alphas: list[float], strengths: list[float]) -> DataFrame:
    """Precision, recall and F1 of each threshold and strength. scored: u, h, hmax, w, correct."""
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(s).alias("strength")) for a in alphas for s in strengths)))
    t = scored.select("*", cells.alias("g")).select("*", "g.*")
    sure = F.col("u") * F.pow(F.greatest(1 - F.col("h") / F.col("hmax"), F.lit(0.0)), F.col("strength")) * F.col("w") >= F.col("alpha")
    t = t.groupBy("alpha", "strength").agg(F.count_if(sure & F.col("correct")).alias("tp"), F.count_if(sure & ~F.col("correct")).alias("fp"), F.count("*").alias("n"))
    p, r = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0), F.col("tp") / F.col("n")
    return t.select("alpha", "strength", "tp", "fp", F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


# ---- full covariance: linear algebra on Arrow batches, with the clusters as one bounded broadcast


def usable(z, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of some vectors are there, `dims` wide and finite throughout, and those as a matrix."""
    fits = np.array([v is not None and len(v) == dims for v in z], bool)
    x = np.array([v for v, f in zip(z, fits, strict=True) if f], float).reshape(int(fits.sum()), dims)
    finite = np.isfinite(x).all(axis=1)
    fits[fits] = finite
    return fits, x[finite]


def full_clusters(points: DataFrame, epsilon: float = 1e-4) -> dict:
    """label -> (n, centroid, inverse covariance); one d*d matrix for each label meets on the driver.

    Vectors that are null, or hold a null or what is not finite, are in no cluster, nor are those of another width than most.
    """
    width = F.size("z")
    most = points.where("label is not null and z is not null").groupBy(width.alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()  # a row for each width
    if most is None:
        return {}
    dims = most["d"]

    def partial(batches: Iterator) -> Iterator:
        import pandas as pd

        sums: dict = {}
        for pdf in batches:
            for label, g in pdf.groupby("label"):
                _, z = usable(g["z"], dims)
                if not len(z):
                    continue
                n, s, q = sums.get(label, (0, 0.0, 0.0))
                sums[label] = (n + len(z), s + z.sum(axis=0), q + z.T @ z)
        if sums:  # a frame without rows has no type for its arrays
            yield pd.DataFrame({"label": list(sums), "n": [x[0] for x in sums.values()], "s": [x[1].tolist() for x in sums.values()], "q": [x[2].ravel().tolist() for x in sums.values()]})

    add = lambda c: F.aggregate(F.slice(c, 2, F.size(c)), c[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    parts = points.where("label is not null").select("label", "z").mapInPandas(partial, "label int, n long, s array<double>, q array<double>")
    out = {}
    for r in parts.groupBy("label").agg(F.sum("n").alias("n"), add(F.collect_list("s")).alias("s"), add(F.collect_list("q")).alias("q")).collect():
        d = len(r["s"])
        mean = np.array(r["s"]) / r["n"]
        cov = np.array(r["q"]).reshape(d, d) / r["n"] - np.outer(mean, mean) + epsilon * np.eye(d)
        cov = epsilon * np.eye(d) if r["n"] < 2 else cov
        try:
            inverse = np.linalg.inv(cov)
        except np.linalg.LinAlgError:
            inverse = np.eye(d) / epsilon
        out[r["label"]] = (r["n"], mean, inverse)
    return out


def full_distances(points: DataFrame, clusters: dict, least: int = 2) -> DataFrame:
    """(vec_id, label, n, d) under full covariances; no distance to clusters of fewer than `least` events, a null one of vectors that full_clusters would not take."""
    shared = points.sparkSession.sparkContext.broadcast({k: v for k, v in clusters.items() if v[0] >= least})

    def each(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            if not len(pdf):
                continue
            fits, z = usable(pdf["z"], next((len(mean) for _, mean, _ in shared.value.values()), 0))
            for label, (n, mean, inverse) in shared.value.items():
                d = np.full(len(pdf), np.nan)
                d[fits] = np.sqrt(np.maximum(((z - mean) @ inverse * (z - mean)).sum(axis=1), 0))
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": label, "n": n, "d": d})

    return points.select("vec_id", "z").mapInPandas(each, "vec_id long, label int, n long, d double")


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Covariance of few points, shrunk toward a multiple of the identity by the Ledoit-Wolf weight."""
    n, d = x.shape
    c = x - x.mean(axis=0)
    s = c.T @ c / n
    target = np.trace(s) / d * np.eye(d)
    spread = ((s - target) ** 2).sum()
    noise = sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / n**2
    weight = 1.0 if spread <= 0 else float(np.clip(noise / spread, 0, 1))
    return (1 - weight) * s + weight * target
