"""Queries that run the events table as a stream, with SQL for what the stream must end with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.operators import clusters
from tracemend.plans.models import _folder
from tracemend.plans.oracles import EDGES, LOG, _prefixed
from tracemend.plans.repair import DIMS, with_z
from tracemend.schema import from_events
from tracemend.streaming import cases
from tracemend.streaming.snapshot import LEAST_PIECES, SnapshotClusters, SnapshotGraph, replay


def stream_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directly-follows edges that a stream ends with."""
    folder = _folder(spark, "stream")
    target = SnapshotGraph(spark, f"{folder}/state")
    replay(from_events(spark, sf_dir).select("seq", "case_id", "activity"), target, folder)
    return target.edges()


def stream_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster sums that a stream ends with, cell by cell."""
    folder = _folder(spark, "stream")
    target = SnapshotClusters(spark, f"{folder}/state")
    replay(with_z(spark, sf_dir).select("seq", "activity", "z"), target, folder)
    return target.sums().select("label", "i", "n", F.round("s", 4).alias("s"), F.round("q", 4).alias("q"))


def stream_cluster_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the unlabelled events of a stream to the clusters known before their batch: the nearest of each."""
    folder = _folder(spark, "stream")
    target = SnapshotClusters(spark, f"{folder}/state")
    replay(with_z(spark, sf_dir).select("seq", "activity", "z"), target, folder)
    best = clusters.memberships(target.distances()).groupBy("vec_id").agg(F.max_by("label", "u").alias("label"), F.round(F.max("u"), 3).alias("u"), F.count("*").alias("clusters"))
    return best.withColumnRenamed("vec_id", "seq")


def stream_case_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State by case on a stream: labels and provenances before the event, counts, age, statistics of its values."""
    folder = _folder(spark, "stream")
    log = from_events(spark, sf_dir).select("seq", "case_id", "activity", F.col("ts").cast("timestamp").alias("ts"), "value")
    log.write.parquet(f"{folder}/in")
    stream = cases.with_history(spark.readStream.schema(log.schema).parquet(f"{folder}/in"), 3)
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return out.select("seq", "case_id", "prefix", "provenances", "so_far", "labels", F.round("age", 4).alias("age"), F.round("mean", 4).alias("mean"), F.round("deviation", 3).alias("deviation"))


def stream_xes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A growing folder of XES logs as a stream: half of the cases' files land, and are read, before the other half; events without a label are left out on the way.

    A file is read by one task, so a micro-batch takes as many files as there are cores, or three if that is more.
    """
    from tracemend.sources import xes

    folder = _folder(spark, "xes")
    k = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    log = from_events(spark, sf_dir).select("seq", "case_id", "activity", "ts", F.lit("complete").alias("lifecycle"), F.lit(None).cast("string").alias("resource"), k.alias("attributes"), F.create_map(F.lit("meter/value"), F.col("value").cast("string")).alias("sensors_raw"))
    half = F.pmod(F.xxhash64("case_id"), F.lit(2))
    events = None
    for part in (0, 1):
        xes.write_xml(log.where(half == part), f"{folder}/in/{part}")
        events = xes.read_xml(spark, f"{folder}/in", streaming=True, files_a_batch=max(3, spark.sparkContext.defaultParallelism)).where("activity is not null")
        events = events.select("case_id", "pos", "activity", F.try_element_at("attributes", F.lit("k")).alias("k"), F.try_element_at("sensors", F.lit("meter/value")).alias("value"))
        events.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{folder}/out").withColumn("pos", F.col("pos").cast("long"))


QUERIES = {f.__name__: f for f in (stream_xes, stream_graph, stream_clusters, stream_cluster_distances, stream_case_history)}

# a batch is numbered by which of the equal stretches of seq an event lies in
_BATCHES = f"""span AS (SELECT min(event_id) AS lo, max(event_id) - min(event_id) + 1 AS n, greatest({LEAST_PIECES}, CAST(ceil(count(*) / 250000.0) AS BIGINT)) AS pieces FROM events), cuts AS (SELECT unnest([lo + n * i // pieces FOR i IN range(1, pieces)]) AS cut FROM span)"""
_N = "(SELECT count(*) FROM cuts WHERE cut <= seq)"
_Z = f"""{LOG}, {_BATCHES}, feats AS (SELECT seq, activity, {_N} AS batch, [hour(ts) / 24.0::DOUBLE, minute(ts) / 60.0::DOUBLE, (isodow(ts) - 1) / 7.0::DOUBLE, coalesce(value, 0) / 100.0::DOUBLE] AS z FROM log),
cells AS (SELECT seq, activity, batch, unnest(range(0, {DIMS})) AS i, unnest(z) AS v FROM feats)"""

ORACLES = {
    "stream_xes": f"WITH {LOG}, p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) - 1 AS pos FROM log) SELECT case_id, pos, activity, json_extract_string(props, '$.k') AS k, value FROM p WHERE activity IS NOT NULL",
    "stream_repair_snapshot": f"""WITH {LOG}, {_prefixed(2)}, {_BATCHES}, b AS (SELECT *, {_N} AS batch FROM prefixed),
seen AS (SELECT a.seq, p.activity AS next, count(*) AS n FROM b a JOIN b p ON a.prefix = p.prefix AND p.batch < a.batch AND p.activity IS NOT NULL WHERE a.activity IS NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY n DESC, next DESC) AS k, sum(n) OVER (PARTITION BY seq) AS total FROM seen), best AS (SELECT * FROM r WHERE k = 1)
SELECT b.seq, case_id, activity, truth, CASE WHEN activity IS NOT NULL THEN activity WHEN n / total >= 0.25 AND total >= 5 THEN next END AS recovered, CASE WHEN activity IS NOT NULL THEN 1 ELSE coalesce(n / total, 0) END AS confidence,
CASE WHEN activity IS NOT NULL THEN 'NORMAL' WHEN n / total >= 0.25 AND total >= 5 THEN 'RECOVERED_ML_SEQ' ELSE 'UNRECOVERED_ML' END AS provenance FROM b LEFT JOIN best USING (seq)""",
    "stream_graph": f"WITH {EDGES} SELECT src, dst, weight FROM edges",
    "stream_clusters": f"WITH {_Z} SELECT activity AS label, CAST(i AS INTEGER) AS i, count(*) AS n, round(sum(v), 4) AS s, round(sum(v * v), 4) AS q FROM cells WHERE activity IS NOT NULL GROUP BY 1, 2",
    "stream_cluster_distances": f"""WITH {_Z}, per AS (SELECT batch, activity AS label, i, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM cells WHERE activity IS NOT NULL GROUP BY 1, 2, 3),
sums AS (SELECT b.batch, p.label, p.i, sum(p.n) AS n, sum(p.s) AS s, sum(p.q) AS q FROM (SELECT DISTINCT batch FROM feats) b JOIN per p ON p.batch < b.batch GROUP BY 1, 2, 3),
d AS (SELECT c.seq, label, sqrt(sum((v - s / n) ** 2 / (q / n - (s / n) ** 2 + 1e-4))) AS d FROM cells c JOIN sums USING (batch, i) WHERE c.activity IS NULL AND n >= 2 GROUP BY 1, 2),
u AS (SELECT *, d ** -2 / sum(d ** -2) OVER (PARTITION BY seq) AS u FROM d) SELECT seq, arg_max(label, u) AS label, round(max(u), 3) AS u, count(*) AS clusters FROM u GROUP BY 1""",
    "stream_case_history": f"""WITH {LOG}, {_prefixed(3)}, firsts AS (SELECT *, activity IS NOT NULL AND row_number() OVER (PARTITION BY case_id, activity ORDER BY seq) = 1 AS new FROM prefixed)
SELECT seq, case_id, prefix, coalesce(array_to_string(list(CASE WHEN activity IS NULL THEN 'MISSING' ELSE 'NORMAL' END) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS provenances, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far,
CAST(coalesce(sum(new::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS labels, round((epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 3.6e9, 4) AS age, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean,
round(stddev_pop(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 3) AS deviation FROM firsts WINDOW w AS (PARTITION BY case_id ORDER BY seq)""",
}
