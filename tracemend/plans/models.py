"""Queries of the trained and streaming parts, which SQL cannot express."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.operators import autoencoder, calibration, clusters, discovery, drift, features, sequence
from tracemend.operators.graphs import Scratch
from tracemend.schema import from_events
from tracemend.streaming.snapshot import SnapshotRepair, replay


def _folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tracemend-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label (position of the true label, null where masked), x: previous labels one-hot, gap, value, time of day."""
    log = from_events(spark, sf_dir)
    names = sorted(r[0] for r in log.select("activity").where("activity is not null").distinct().collect())  # the labels
    position = F.coalesce(*(F.when(F.col("activity") == a, i) for i, a in enumerate(names)))
    width = len(names) + features.FIRST_ID
    hot = F.flatten(F.transform("prefix", lambda p: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == p).cast("double"))))
    t = features.with_ids(log).select("*", features.padded_ids(3).alias("prefix"), F.round(features.gap_hours(), 6).alias("hours"))
    x = F.concat(hot, F.array(F.col("hours"), F.coalesce("value", F.lit(0.0)), F.hour("ts") / 24.0, F.weekday("ts") / 7.0))
    return t.select(F.col("seq").alias("vec_id"), position.cast("int").alias("label"), x.alias("x"))


def sdae_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Scratch(spark, "vectors").keep(feature_vectors(spark, sf_dir))
    model = autoencoder.train(v.where("label is not null").select("x"), epochs=5)
    return autoencoder.encode(v, model)


def cluster_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: features, latent vectors, clusters, memberships, confidence, decision."""
    z = Scratch(spark, "latent").keep(sdae_encode(spark, sf_dir))  # read for the clusters and for the scores
    d = clusters.full_distances(z.where("label is null").select("vec_id", "z"), clusters.full_clusters(z.select("label", "z"), epsilon=1e-3), least=20)
    best = clusters.confidence(clusters.memberships(d), "plain")
    return best.select("vec_id", F.when(F.col("confidence") >= 0.2, F.col("label")).alias("recovered"), "confidence", F.when(F.col("confidence") >= 0.2, "RECOVERED_ML").otherwise("UNRECOVERED_ML").alias("provenance"))


def sequence_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.examples(from_events(spark, sf_dir), 3)
    classes = int(rows.agg(F.max("label")).first()[0]) + 1
    return sequence.rescue(rows, sequence.train(rows, classes), 0.2)


def platt_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("z"))
    s = clusters.confidence(clusters.memberships(clusters.diagonal_distances(p, clusters.sufficient(p))), "plain").withColumnRenamed("label", "best").join(p.select("vec_id", "label"), "vec_id")
    a, b = calibration.platt(s.withColumn("right", (F.col("best") == F.col("label")).cast("int")), "confidence", "right")
    return s.select("vec_id", "best", "confidence", calibration.apply_platt(F.col("confidence"), a, b).alias("calibrated"))


def candidate_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labels' vectors taken as unknown: what groups are found among them."""
    p = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("seq"), "label", F.col("embedding").cast("array<double>").alias("z"))
    known = p.where("label > 1").groupBy("label").agg(F.array(*(F.avg(F.get("z", F.lit(i))) for i in range(64))).alias("c")).collect()  # a row for each label
    return discovery.discover(p.where("label <= 1"), np.array([r["c"] for r in known], float), radius=1.3, least=5, persist=5, separation=0.1)


def adwin_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes in each label's values, with a step put into the later half."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = e.agg((F.max("event_id") / 2).alias("h")).first()["h"]
    t = e.select("event_type", "event_id", F.when(F.col("event_id") > half, F.col("value") + 100).otherwise(F.col("value")).alias("value"))
    return drift.detect(t, "event_type", "event_id", "value")


def stream_repair_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream in order of its ids, repaired by micro-batches."""
    folder = _folder(spark, "stream")
    target = SnapshotRepair(spark, f"{folder}/state", order=2, dominance=0.25, support=5)
    replay(from_events(spark, sf_dir).select("seq", "case_id", "activity", "truth"), target, folder)
    return target.results().drop("batch")


def xes_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of events written as XES and read again."""
    from tracemend.sources import xes

    folder = _folder(spark, "xes")
    log = from_events(spark, sf_dir).select("seq", "case_id", "activity", "ts", F.lit("complete").alias("lifecycle"), F.lit(None).cast("string").alias("resource"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("attributes"), F.create_map(F.lit("meter/value"), F.col("value").cast("string")).alias("sensors_raw"))
    xes.write_xml(log, folder)
    return xes.ordered(xes.read_xml(spark, folder)).select("seq", "case_id", "activity", F.try_element_at("attributes", F.lit("k")).alias("k"), F.try_element_at("sensors", F.lit("meter/value")).alias("value"))


QUERIES = {f.__name__: f for f in (sdae_encode, cluster_repair, sequence_rescue, platt_scaled, candidate_discovery, adwin_drift, stream_repair_snapshot, xes_round_trip)}
