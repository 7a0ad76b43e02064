"""The decision cascade over trained sources: latents, running full covariances, a sequence classifier, calibration.

A warm-up ends where it has seen enough; its labelled events, but for a held-out tenth, train the models, and the held-out ones
calibrate their confidences. The models are stored under a version, and every later event is decided by them and by what was
known before it: clusters that all labelled events update, and the bounded count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemend.operators import autoencoder, cache, calibration, clusters, inject, prefixes, sequence
from tracemend.operators.cascade import KEPT, Gates, confident, decide
from tracemend.operators.features import FIRST_ID, MISSING, PAD
from tracemend.operators.running import sure_cut
from tracemend.schema import NORMAL, UNRECOVERED

BLOCK_ROWS = 1 << 13
CELLS = 1 << 20  #: products of vectors with themselves that a task holds at once, about
CANDIDATES = "array<struct<label:string,n:bigint,d:double>>"


# ---- clusters of all events before each


class Scatter:
    """Number, sum and sum of products of the vectors of each label, as one row of 1 + dims + dims * dims cells."""

    def __init__(self, dims: int, epsilon: float):
        self.dims, self.epsilon = dims, epsilon
        self.of: dict[str, np.ndarray] = {}

    def add(self, label: str, own: np.ndarray) -> None:
        self.of[label] = self.of[label] + own if label in self.of else own

    def distances(self, z: np.ndarray, sums: np.ndarray, least: int) -> np.ndarray:
        """Mahalanobis distances of vectors, each to the label whose sums stand in the same row; nan for fewer than `least` vectors and where there is none."""
        d = self.dims
        out = np.full(len(z), np.nan)
        sure = np.flatnonzero(sums[:, 0] >= max(least, 1))
        n, z = sums[sure, :1], z[sure]
        mean = sums[sure, 1 : d + 1] / n
        spread = sums[sure, d + 1 :].reshape(-1, d, d) / n[:, :, None] - mean[:, :, None] * mean[:, None, :]
        spread = np.where(n[:, :, None] > 1, spread, 0.0) + self.epsilon * np.eye(d)
        try:
            inverse = np.linalg.inv(spread)
        except np.linalg.LinAlgError:
            inverse = np.stack([self.inverse(m) for m in spread])
        off = z - mean
        square = np.einsum("ij,ij->i", (off[:, None, :] @ inverse)[:, 0], off)
        with np.errstate(invalid="ignore"):
            out[sure] = np.sqrt(np.where(np.isfinite(square), square, np.nan))
        return out

    def inverse(self, spread: np.ndarray) -> np.ndarray:
        try:
            return np.linalg.inv(spread)
        except np.linalg.LinAlgError:
            return np.eye(self.dims) / self.epsilon

    def through(self, codes: np.ndarray, names: list[str], z: np.ndarray, asked: np.ndarray, least: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """Label, numbers and distances for the rows that ask, at positions `asked`, under the vectors before each of them; then all rows are known. codes: of the rows' labels among `names`, -1 for none."""
        own = products(z)
        found = []
        for label in sorted({*self.of, *names}):
            rows = np.flatnonzero(codes == names.index(label)) if label in names else np.zeros(0, int)
            upto = np.cumsum(np.vstack([self.of[label] if label in self.of else np.zeros(own.shape[1]), own[rows]]), axis=0)  # one after another, as if each were added
            if len(asked):
                sums = upto[np.searchsorted(rows, asked)]
                found.append((label, sums[:, 0].astype(np.int64), self.distances(z[asked], sums, least)))
            self.of[label] = upto[-1]
        return found


def products(z: np.ndarray) -> np.ndarray:
    """1, the vector and its products with itself, in a row each."""
    return np.hstack([np.ones((len(z), 1)), z, (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)])


def running_full(events: DataFrame, least: int, epsilon: float = 1e-4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(seq, candidates) of the rows of `events` (seq, label, z, asked) that ask: distances under the full covariance of each label's vectors before the row.

    Blocks of positions of seq sum their own vectors; a window over blocks, a row for each cell of a label's matrix, adds up
    those before a block; then each block goes through its rows in order. No column stands for a label or a dimension.
    """
    dims = events.select(F.max(F.size("z"))).first()[0] or 0
    block = F.floor(F.col("seq") / block_rows).alias("block")
    cells = dims * dims + dims + 1
    most = max(1, CELLS // cells)  # rows whose products are held at once

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], np.ndarray] = {}
        for whole in batches:
            for b in (whole.slice(i, most) for i in range(0, whole.num_rows, most)):
                coded = b["label"].dictionary_encode()
                k, code, names = np.asarray(b["block"]), np.asarray(coded.indices), coded.dictionary.to_pylist()
                order = np.lexsort((code, k))  # stable: rows of a block and label stay in order
                k, code = k[order], code[order]
                cuts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (code[1:] != code[:-1])])
                own = products(autoencoder.matrix(b["z"], dims)[order])
                for at, end in zip(cuts, [*cuts[1:], len(k)], strict=True):
                    key = int(k[at]), names[code[at]]
                    held[key] = np.add.reduce(np.vstack([held[key], own[at:end]]) if key in held else own[at:end])  # row after row
        for (k, label), v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * cells, pa.int64()), pa.array([label] * cells), pa.array(range(cells), pa.int32()), pa.array(v)], names=["block", "label", "cell", "v"])

    known = events.where("label is not null").select(block, "label", "z")
    sums = known.mapInArrow(totals, "block long, label string, cell int, v double").groupBy("label", "cell", "block").agg(F.sum("v").alias("v"))
    # a label is known from its first block on, so a block needs each label's sums even where the block before it has none
    names = events.where("label is not null").select("label").distinct()  # not from `sums`, which would be made twice
    every = names.select("label", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")).join(F.broadcast(events.select(block).distinct()))  # labels times cells; a row for each block
    upto = Window.partitionBy("label", "cell").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = every.join(sums, ["label", "cell", "block"], "left").select("block", "label", "cell", F.sum("v").over(upto).alias("v")).where("v is not null")
    start = before.groupBy("block", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "v"))), lambda c: c["v"]).alias("z"))
    rows = events.select(block, F.lit(1).alias("side"), "seq", "label", "z", "asked")
    both = rows.unionByName(start.select("block", F.lit(0).alias("side"), F.lit(0).cast("long").alias("seq"), "label", "z", F.lit(False).alias("asked")))
    kind = pa.struct([("label", pa.string()), ("n", pa.int64()), ("d", pa.float64())])
    schema = pa.schema([("seq", pa.int64()), ("candidates", pa.list_(kind))])

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for whole in batches:
            block, side = np.asarray(whole["block"]), np.asarray(whole["side"])
            cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (side[1:] != side[:-1])]) if len(block) else []
            for a, z in zip(cuts, [*cuts[1:], len(block)], strict=True):
                if block[a] != now:
                    now, state = block[a], Scatter(dims, epsilon)
                if side[a] == 0:
                    b = whole.slice(a, z - a)
                    for label, own in zip(b["label"].to_pylist(), autoencoder.matrix(b["z"], cells), strict=True):
                        state.add(label, own)
                    continue
                for i in range(a, z, most):
                    b = whole.slice(i, min(most, z - i))
                    coded = b["label"].dictionary_encode()
                    asked = np.flatnonzero(b["asked"].to_numpy(zero_copy_only=False))
                    found = state.through(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), autoencoder.matrix(b["z"], dims), asked, least)
                    if len(asked):
                        yield pa.RecordBatch.from_arrays([b["seq"].take(pa.array(asked)), structs(found, len(asked))], schema=schema)

    def structs(found: list[tuple[str, np.ndarray, np.ndarray]], rows: int) -> pa.Array:
        """For each row the labels known by then, in order, with number and distance."""
        n, d = (np.array([f[i] for f in found]).reshape(-1, rows).T for i in (1, 2))
        there = n > 0
        names = pa.array([f[0] for f in found], pa.string()).take(pa.array(np.nonzero(there)[1]))
        d = d[there].astype(np.float64)
        items = pa.StructArray.from_arrays([names, pa.array(n[there].astype(np.int64)), pa.array(d, mask=np.isnan(d))], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(there.sum(axis=1))], pa.int32()), items, type=schema.field(1).type)

    return both.repartition("block").sortWithinPartitions("block", "side", "seq").mapInArrow(through, f"seq long, candidates {CANDIDATES}")


def prior_factor(candidates: str, best: str, beta: float) -> Column:
    """((1/K) / share)**beta with K the labels known so far and share that of the best one."""
    total = F.aggregate(candidates, F.lit(0).cast("long"), lambda a, c: a + c["n"])
    own = F.try_element_at(F.filter(candidates, lambda c: c["label"] == F.col(best)), F.lit(1))["n"]
    return F.coalesce(F.pow((1.0 / F.size(candidates)) / (own / total), F.lit(beta)), F.lit(1.0))


# ---- the warm-up


@dataclass
class Trained:
    """What the warm-up leaves: models, the calibration of both confidences, the labels by number."""

    coder: autoencoder.Autoencoder
    head: object  #: a classifier of Spark ML
    labels: list[str]
    cluster_scale: tuple[float, float]
    head_scale: tuple[float, float]
    end: int  #: events before this position of seq are the warm-up


def warmup_end(log: DataFrame, least: int, most: int, enough: int) -> int:
    """The position of seq at which the warm-up ends: `least` events, and then when `enough` labels are known; `most` events at the latest."""
    firsts = log.where("activity is not null").groupBy("activity").agg(F.min("seq").alias("first")).orderBy("first").limit(enough).collect()  # `enough` rows
    start = log.agg(F.min("seq")).first()[0] or 0
    known = firsts[-1]["first"] + 1 if len(firsts) == enough else start + most
    return min(max(start + least, known), start + most)


def held_out(log: DataFrame, end: int, share: float, seed: int) -> DataFrame:
    """Rows (seq) of the warm-up's labelled events that no model is trained on."""
    known = log.where((F.col("seq") < end) & F.col("activity").isNotNull()).select("seq", inject.draw(F.col("seq"), seed).alias("u"))
    return sure_cut(known, "u", "seq", int(known.count() * share)).select("seq")


def hot_prefixes(log: DataFrame, labels: list[str], width: int) -> DataFrame:
    """log with `features`, the one-hot ids of the `width` labels before, by the given numbering; unknown and missing ones share a place."""
    from pyspark.ml.functions import array_to_vector

    number = F.coalesce(*(F.when(F.col("activity") == a, F.lit(i + FIRST_ID)) for i, a in enumerate(labels)), F.lit(MISSING))
    seen = F.collect_list(number).over(prefixes.by_case().rowsBetween(-width, -1))
    ids = F.concat(F.array_repeat(F.lit(PAD), F.lit(width) - F.size(seen)), seen)
    places = F.sequence(F.lit(0), F.lit(len(labels) + FIRST_ID - 1))
    return log.withColumn("features", array_to_vector(F.flatten(F.transform(ids, lambda p: F.transform(places, lambda i: (i == p).cast("double"))))))


def proposals(rows: DataFrame, t: Trained) -> DataFrame:
    """(seq, seq_label, seq_conf) of rows with features, at the head's calibration."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    label = F.element_at(F.array(*map(F.lit, t.labels)), F.col("prediction").cast("int") + 1)
    return t.head.transform(rows.select("seq", "features")).select("seq", label.alias("seq_label"), calibration.apply_platt(F.array_max(p), *t.head_scale).alias("seq_conf"))


def fit(scratch, log: DataFrame, end: int, gates: Gates, width: int = 3, share: float = 0.1, seed: int = 7, **options) -> Trained:
    """The models of log (seq, case_id, activity, x) before `end`."""
    early = scratch.keep(log.where(F.col("seq") < end))
    held = scratch.keep(held_out(early, end, share, seed))
    known = early.where("activity is not null")
    train = scratch.keep(known.join(held, "seq", "left_anti"))
    labels = sorted(r[0] for r in train.select("activity").distinct().collect())  # the labels
    coder = autoencoder.train_labelled(train.withColumn("label", F.col("activity")), flow=0, **options)
    numbered = hot_prefixes(early, labels, width)
    position = F.coalesce(*(F.when(F.col("activity") == a, F.lit(float(i))) for i, a in enumerate(labels)))
    head = sequence.train(numbered.join(held, "seq", "left_anti").select("seq", "features", position.alias("label")), len(labels))
    out = Trained(coder, head, labels, (1.0, 0.0), (1.0, 0.0), end)
    # calibration: the held-out events under the clusters and the head of the others
    per = at_the_end(train, out, gates, known.join(held, "seq", "left_semi").select("seq", "x"))
    best = confident(per.join(known.select("seq", "activity"), "seq"), gates).withColumn("right", (F.col("best") == F.col("activity")).cast("int"))
    out.cluster_scale = scale(scratch.keep(best.select("cluster_conf", "right")), "cluster_conf")
    said = proposals(numbered.join(held, "seq"), out).join(known.select("seq", "activity"), "seq")
    logit = F.log(F.col("seq_conf") / (1 - F.col("seq_conf")))  # undoes the scale of (1, 0)
    out.head_scale = scale(scratch.keep(said.select(logit.alias("seq_conf"), (F.col("seq_label") == F.col("activity")).cast("int").alias("right"))), "seq_conf")
    return out


def at_the_end(train: DataFrame, t: Trained, gates: Gates, rows: DataFrame) -> DataFrame:
    """(seq, candidates) of rows (seq, x) under the clusters of all of `train` (activity, x)."""
    index = F.coalesce(*(F.when(F.col("activity") == a, F.lit(i)) for i, a in enumerate(t.labels)))
    made = clusters.full_clusters(autoencoder.encode(train.select(index.cast("int").alias("label"), "x"), t.coder), 1e-3)
    d = clusters.full_distances(autoencoder.encode(rows.select(F.col("seq").alias("vec_id"), "x"), t.coder), made, least=gates.n_min)
    name = F.element_at(F.array(*map(F.lit, t.labels)), F.col("label") + 1)
    return d.groupBy(F.col("vec_id").alias("seq")).agg(F.array_sort(F.collect_list(F.struct(name.alias("label"), "n", "d"))).alias("candidates"))  # the labels


def scale(rows: DataFrame, confidence: str) -> tuple[float, float]:
    """Platt's a and b; without rows of both kinds a line that leaves confidences of 0 to 1 about where they are."""
    return calibration.platt(rows, confidence, "right") if rows.select("right").distinct().count() == 2 else (4.0, -2.0)


def save(spark: SparkSession, path: str, version: int, t: Trained) -> None:
    """Models as a version below `path`; the one-row table is written last and makes the version whole."""
    t.head.write().overwrite().save(f"{path}/head/version={version}")
    c = t.coder
    coder = {"mean": c.mean.tolist(), "scale": c.scale.tolist(), "weights": [w.tolist() for w in c.weights], "biases": [b.tolist() for b in c.biases]}
    row = (json.dumps(coder), t.labels, list(t.cluster_scale), list(t.head_scale), t.end)
    spark.createDataFrame([row], "coder string, labels array<string>, cluster_scale array<double>, head_scale array<double>, ends long").coalesce(1).write.mode("overwrite").parquet(f"{path}/models/version={version}")


def load(spark: SparkSession, path: str, version: int) -> Trained:
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel

    row = spark.read.parquet(f"{path}/models/version={version}").first()
    c = json.loads(row["coder"])
    coder = autoencoder.Autoencoder(np.array(c["mean"]), np.array(c["scale"]), [np.array(w) for w in c["weights"]], [np.array(b) for b in c["biases"]])
    head = MultilayerPerceptronClassificationModel.load(f"{path}/head/version={version}")
    return Trained(coder, head, list(row["labels"]), tuple(row["cluster_scale"]), tuple(row["head_scale"]), row["ends"])


# ---- every event


def weighed(rows: DataFrame, t: Trained, gates: Gates) -> DataFrame:
    """rows with candidates, and what decide() asks of clusters, at their calibration."""
    rows = confident(rows.withColumn("candidates", F.coalesce("candidates", F.array().cast(CANDIDATES))), gates)
    sure = calibration.apply_platt(F.col("cluster_conf"), *t.cluster_scale)
    if gates.prior_beta > 0:
        sure = F.least(F.lit(1.0), sure * prior_factor("candidates", "best", gates.prior_beta))
    return rows.withColumn("cluster_conf", F.when(F.col("best").isNotNull(), sure).otherwise(0.0))


def retro(log: DataFrame, t: Trained, gates: Gates, width: int = 3, share: float = 0.1, seed: int = 7) -> DataFrame:
    """The warm-up's missing labels decided again by its models and by the clusters of its end, without counts; the columns of cascade.KEPT."""
    early = log.where(F.col("seq") < t.end)
    train = early.where("activity is not null").join(held_out(early, t.end, share, seed), "seq", "left_anti")
    gone = early.where("activity is null")
    said = proposals(hot_prefixes(early.select("seq", "case_id", "activity"), t.labels, width).where("activity is null"), t)
    rows = gone.select("seq", "case_id", "truth", "activity").join(at_the_end(train, t, gates, gone.select("seq", "x")), "seq", "left").join(said, "seq", "left")
    none = {"cache_label": "string", "cache_dom": "double", "cache_sup": "double"}
    g = replace(gates, override=None, emit=None)
    return decide(weighed(rows.select("*", *(F.lit(None).cast(k).alias(c) for c, k in none.items())), t, g), g).select(*KEPT)


def cascade(scratch, log: DataFrame, t: Trained, gates: Gates, rule: cache.Rule, width: int = 3, order: int = 2, share: float = 0.1, seed: int = 7) -> DataFrame:
    """log (seq, case_id, truth, activity, x) decided by the models and by what was known before each event; the columns of cascade.KEPT.

    Held-out events of the warm-up, chosen as in `fit`, are no part of clusters or counts.
    """
    held = held_out(log, t.end, share, seed).withColumn("out", F.lit(True))
    coded = autoencoder.encode(log.select("seq", "case_id", "truth", "activity", "x"), t.coder).join(held, "seq", "left")
    taught = F.when(F.col("out").isNull(), F.col("activity"))
    coded = scratch.keep(coded.withColumn("taught", taught).drop("out"))
    missing = F.col("activity").isNull() & (F.col("seq") >= t.end)
    found = running_full(coded.select("seq", F.col("taught").alias("label"), "z", missing.alias("asked")), gates.n_min, 1e-3)
    said = proposals(hot_prefixes(log.select("seq", "case_id", "activity"), t.labels, width).where(missing), t)
    ops = prefixes.with_prefix(coded.select("seq", "case_id", "activity", "taught"), order).select("seq", "prefix", F.col("taught").alias("activity"), missing.alias("asked"))
    asked = cache.asked(cache.arrivals(scratch, ops.where("activity is not null or asked").drop("asked")), rule)
    counted = asked.select("seq", F.col("best").alias("cache_label"), F.col("dominance").alias("cache_dom"), F.col("support").alias("cache_sup"))
    plain = coded.select("seq", "case_id", "truth", "activity")
    rows = plain.where("activity is null").join(found, "seq", "left").join(said, "seq", "left").join(counted, "seq", "left")
    out = decide(weighed(rows, t, gates), gates)
    early = F.col("seq") < t.end
    none = {"recovered": F.lit(None).cast("string"), "confidence": F.lit(0.0), "provenance": F.lit(UNRECOVERED), "step": F.lit("warm-up")}
    out = out.select(*(F.when(early, none[c]).otherwise(F.col(c)).alias(c) if c in none else F.col(c) for c in KEPT))
    # a given label is what decide() makes of it, so most events join nothing
    given = {"recovered": F.col("activity"), "confidence": F.lit(1.0), "provenance": F.lit(NORMAL), "step": F.lit("given")}
    return out.unionByName(plain.where("activity is not null").select(*(given[c].alias(c) if c in given else c for c in KEPT)))
