"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.functions import columns as C
from tracemend.operators import clusters, cooccurrence, dfg, features, inject, metrics, prefixes, temporal
from tracemend.plans import clinical, extras, feedback, models, repair, streams, trained
from tracemend.plans.oracles import ORACLES
from tracemend.schema import from_events

LABELS = ["click", "error", "purchase", "signup", "view"]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark, sf_dir)


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.col("turn").alias("seq"), F.col("conv_id").cast("string").alias("case_id"), F.col("role").alias("activity"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("z"))


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: masked labels from the counts of what followed the same prefix before, low gates for noisy labels."""
    return prefixes.repair(log(spark, sf_dir), LABELS, order=2, dominance=0.25, support=5)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return clusters.memberships(clusters.diagonal_distances(p, clusters.sufficient(p)))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's best cluster with what the grid varies."""
    m = _scored(spark, sf_dir)
    best = m.groupBy("vec_id").agg(
        F.max(F.struct("u", (-F.col("label")).alias("early"), "label", "n")).alias("b"), F.count("*").alias("k"),
        F.sum(F.when(F.col("u") > 1e-15, -F.col("u") * F.log("u")).otherwise(0.0)).alias("h"),
    )
    hmax = F.when(F.col("k") > 1, F.log(F.col("k").cast("double"))).otherwise(1.0)
    t = best.select("vec_id", F.col("b.u").alias("u"), "h", hmax.alias("hmax"), F.least(F.lit(1.0), F.col("b.n") / 50).alias("w"), F.col("b.label").alias("best"))
    return t.join(points(spark, sf_dir).select("vec_id", "label"), "vec_id").withColumn("correct", F.col("best") == F.col("label"))


def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, known = F.count("*"), F.count("activity")
    return log(spark, sf_dir).agg(
        n.alias("events"), known.alias("labelled"), F.round(1 - known / n, 6).alias("missing_rate"), F.countDistinct("case_id").alias("cases"),
        F.countDistinct("activity").alias("activities"), F.round(n / F.countDistinct("case_id"), 6).alias("events_per_case"), F.round(F.count("value") / n, 6).alias("sensor_rate"),
    )


def activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where("activity is not null").groupBy("activity").agg(F.count("*").alias("n"))


def case_activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where("activity is not null").groupBy("case_id", "activity").agg(F.count("*").alias("n"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dfg.edges(log(spark, sf_dir))


def prefix_ids_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.prefix_ids(log(spark, sf_dir), 5).select("seq", F.array_join(F.transform("prefix", lambda x: x.cast("string")), ",").alias("prefix"))


def sensor_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.sensor_windows(log(spark, sf_dir).select("seq", "case_id", F.lit("value").alias("sensor"), "value"))


def md5_hash_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = C.hash_vector(F.get_json_object("props", "$.k"))
    return log(spark, sf_dir).select("seq", *(F.round(v[i], 6).alias(f"h{i}") for i in (0, 1, 15)), F.round(F.aggregate(v, F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


def time_of_day_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = log(spark, sf_dir).select("seq", *C.time_of_day(F.col("ts")))
    return t.select("seq", *(F.round(c, 6).alias(c) for c in ("hour_part", "minute_part", "weekday_part")))


def inject_hash_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.mask_share(log(spark, sf_dir), 0.1, 42)


def inject_activity_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.mask_activities(log(spark, sf_dir), ["error", "signup"], 0.5, 42)


def count_cache_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = log(spark, sf_dir)
    proposals = prefixes.with_prefix(t, 1).where("activity is null").select("seq", "prefix", F.lit("click").alias("proposed"))
    return prefixes.veto(proposals, prefixes.top_next(t, 1), dominance=0.2, support=20)


def class_prior_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    shares = p.select("label", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))  # a row for each label
    t = clusters.class_prior(clusters.confidence(_scored(spark, sf_dir), "plain"), shares, 0.5)
    return t.select("vec_id", "label", F.round("adjusted", 4).alias("adjusted"))


def margin_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = clusters.confidence(_scored(spark, sf_dir), "margin")
    return t.select("vec_id", F.when(F.round(F.col("u") - F.col("second"), 4) >= 0.01, F.col("label")).alias("label"), F.round(F.col("u") - F.col("second"), 4).alias("margin"))


def agreement_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.top_k_agrees(_scored(spark, sf_dir), points(spark, sf_dir).select("vec_id", "label"), 3)


def asof_snapshot_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = log(spark, sf_dir)
    left = t.where("truth = 'purchase'").select("case_id", "ts", "seq")
    right = t.where("truth = 'error'").select("case_id", "ts", "value")
    return temporal.as_of(left, right, "case_id", "ts", "value", 24).select("seq", F.round("last_value", 6).alias("last_value"))


def trailing_minmax_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = temporal.trailing(log(spark, sf_dir), "case_id", "ts", "value", 4)
    return t.select("seq", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


def hourly_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = temporal.hourly(log(spark, sf_dir), "case_id", "ts", "value", "truth")
    return t.select("case_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "readings", "mean", "labels")


def hetero_union_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines as one trace for each customer: START/END of an order, one event for each shipment."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_shipdate", "l_returnflag")
    placed = o.select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("Order_"), "o_orderstatus").alias("activity"), F.col("o_orderdate").alias("ts"))
    shipped = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("Ship_"), "l_returnflag").alias("activity"), F.col("l_shipdate").alias("ts"))
    return placed.unionByName(shipped).groupBy("case_id", "activity").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last"))


def super_category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by a category of their part; parts that the mapping lacks get the default."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_quantity")
    names = spark.createDataFrame([("ECONOMY", "LOW"), ("STANDARD", "MID"), ("PROMO", "MID")], "p_type string, category string")
    t = li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").join(F.broadcast(names), "p_type", "left")
    return t.groupBy(F.coalesce("category", F.lit("OTHER")).alias("category")).agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def interval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """START and END events of shipments that follow their order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_shipdate", "l_linestatus")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderdate", "l_shipdate", "l_linestatus")
    t = temporal.intervals(rows, "o_custkey", "o_orderdate", "l_shipdate", F.concat(F.lit("delivery "), "l_linestatus"))
    return t.groupBy("case_id", "activity").agg(F.count("*").alias("n"))


def recent_per_label_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.recent(log(spark, sf_dir).where("activity is not null"), "activity", 200).select("seq", "activity")


def vocab_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = log(spark, sf_dir).orderBy("seq").limit(10_000)  # the bounded scan is the feature
    return first.agg(F.countDistinct("truth").alias("activities"), F.array_join(F.array_sort(F.collect_set("truth")), ",").alias("names"), F.countDistinct("case_id").alias("cases"))


def distinct_offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").distinct().orderBy("o_custkey").offset(20).limit(50)  # a page is the feature


def syscall_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label joined from three fields, null without the last; the counters that are neither null nor 0."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    ok = F.when(k % 5 != 0, F.when(k % 2 == 0, "yes").otherwise("no"))
    counters = F.create_map(F.lit("low"), k % 3, F.lit("mid"), k % 4)
    kept = F.map_filter(counters, lambda _, v: v.isNotNull() & (v != 0))
    label = F.when(ok.isNotNull(), F.concat_ws("_", "event_type", (F.col("user_id") % 7).cast("string"), ok))
    return e.select(F.col("event_id").alias("seq"), label.alias("activity"), F.size(kept).alias("counters"), F.coalesce(F.try_element_at(kept, F.lit("mid")), F.lit(-1)).alias("mid"))


def wide_csv_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide columns attr_* and sensor_* gathered into two maps and read back."""
    from tracemend.sources.tables import from_wide

    t = log(spark, sf_dir)
    wide = t.select(F.col("seq").cast("string").alias("seq"), "case_id", "activity", F.col("ts").cast("string").alias("timestamp"), F.get_json_object("props", "$.k").alias("attr_k"), F.col("value").cast("string").alias("sensor_value"))
    got = from_wide(wide)
    return got.select("seq", F.try_element_at("attributes", F.lit("k")).alias("k"), F.round(F.try_element_at("sensors", F.lit("value")), 6).alias("value"))


def label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose label is none of the text nulls and not a log-window marker."""
    return log(spark, sf_dir).where(~C.is_null_text(F.col("activity")) & ~F.coalesce(F.col("activity").rlike("^LogWindow_(train|test)$"), F.lit(False))).groupBy("activity").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def bfr_sufficient_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.sufficient(points(spark, sf_dir)).select("label", F.col("i").cast("int").alias("i"), "n", F.round("s", 4).alias("s"), F.round("q", 4).alias("q"))


def bfr_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.sufficient(points(spark, sf_dir)).select("label", F.col("i").cast("int").alias("i"), F.round(F.col("s") / F.col("n"), 5).alias("centroid"))


def bfr_merge_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves' statistics merged, after one label's were decayed by half."""
    p = points(spark, sf_dir)
    halves = [clusters.sufficient(p.where(F.col("vec_id") % 2 == r)) for r in (0, 1)]
    t = clusters.decay(clusters.merge(*halves), [3])
    return t.select("label", F.col("i").cast("int").alias("i"), F.round("n", 2).alias("n"), F.round("s", 4).alias("s"))


def bfr_diag_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return clusters.diagonal_distances(p, clusters.sufficient(p)).select("vec_id", "label", F.round("d", 3).alias("d"))


def fuzzy_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("vec_id", "label", F.round("u", 4).alias("u"))


def composite_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = clusters.confidences(_scored(spark, sf_dir), ["entropy", "margin", "log_combined", "plain"])
    return t.select("vec_id", "mode", "label", F.round("confidence", 4).alias("confidence"))


def bfr_full_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return clusters.full_distances(p, clusters.full_clusters(p))


def alpha_lambda_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.grid(_best(spark, sf_dir), [0.02, 0.05, 0.1, 0.2], [0.0, 0.5])


def ppmi_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.ppmi(cooccurrence.pair_counts(log(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        log_stats, activity_counts, case_activity_counts, prefix_ids_padded, sensor_window_stats, md5_hash_features, time_of_day_features, inject_hash_mask, inject_activity_specific,
        count_cache_veto, class_prior_adjust, margin_abstain, agreement_topk, asof_snapshot_24h, trailing_minmax_4h, hourly_bucket, hetero_union_trace, super_category_lookup,
        interval_events, recent_per_label_topk, vocab_discovery, distinct_offset_page, syscall_labels, wide_csv_maps, label_filter, bfr_sufficient_stats, bfr_centroids, bfr_merge_decay,
        bfr_diag_mahalanobis, fuzzy_membership, composite_confidence, bfr_full_mahalanobis, alpha_lambda_grid, ppmi_matrix,
    )
} | {
    "dfg_edges": _edges,
    "dfg_edges_conversations": lambda s, d: dfg.edges(talk(s, d)),
    "dfg_outgoing_entropy": lambda s, d: dfg.entropy(_edges(s, d), "src"),
    "dfg_incoming_entropy": lambda s, d: dfg.entropy(_edges(s, d), "dst"),
    "dfg_parallel_pairs": lambda s, d: dfg.parallel_pairs(_edges(s, d)),
    "dfg_parallel_features": lambda s, d: dfg.parallel_features(_edges(s, d), dfg.parallel_pairs(_edges(s, d), balance=0.95)),
    "global_running_outgoing": lambda s, d: dfg.running_outgoing(log(s, d)),
    "prev_k_activities": lambda s, d: features.previous_activities(log(s, d), 4),
    "hours_since_prev_capped": lambda s, d: features.hours_since_previous(log(s, d)),
    "occurrence_so_far": lambda s, d: features.occurrences(log(s, d)),
    "self_loop_flag": lambda s, d: features.self_loops(log(s, d)),
    "case_age_features": lambda s, d: features.case_age(log(s, d)),
    "lifecycle_onehot_capped": lambda s, d: features.onehot(log(s, d), "activity", 3),
    "standardise_value": lambda s, d: features.standardise(log(s, d), "value"),
    "welford_running_standardise": lambda s, d: features.running_standardise(log(s, d), "value"),
    "warmup_end_position": lambda s, d: features.warmup_end(log(s, d)),
    "inject_burst": lambda s, d: inject.mask_bursts(log(s, d), 20, 3),
    "count_cache_top": lambda s, d: prefixes.top_next(log(s, d), 2),
    "count_cache_decayed": lambda s, d: prefixes.decayed_counts(log(s, d), 1, 1000, 0.9, 0.1),
    "count_cache_decayed_by_additions": lambda s, d: prefixes.decayed_by_additions(log(s, d), 1, 1000, 0.9, 0.1),
    "count_cache_causal_repair": repaired,
    "class_weights": lambda s, d: prefixes.balanced_weights(log(s, d)),
    "prefix_contamination": lambda s, d: prefixes.contamination(repaired(s, d), 10),
    "accuracy_metrics": lambda s, d: metrics.accuracy(repaired(s, d)),
    "per_activity_prf": lambda s, d: metrics.by_activity(repaired(s, d)),
    "per_provenance": lambda s, d: metrics.by_provenance(repaired(s, d)),
    "calibration_bins": lambda s, d: metrics.calibration(repaired(s, d)),
    "natural_missing_quantiles": lambda s, d: metrics.confidence_quantiles(repaired(s, d)),
    "dfg_plausibility": lambda s, d: metrics.plausibility(repaired(s, d), _edges(s, d)),
    "stream_summary": lambda s, d: metrics.summary(repaired(s, d)),
    "bfr_covariance_cells": lambda s, d: clusters.covariance_cells(points(s, d), 8),
    "cluster_pair_distance": lambda s, d: clusters.pair_distances(clusters.sufficient(points(s, d))),
    "two_latest_delta": lambda s, d: temporal.latest_change(log(s, d), "case_id", "ts", "value"),
    "ppmi_conversations": lambda s, d: cooccurrence.ppmi(cooccurrence.pair_counts(talk(s, d))),
} | models.QUERIES | repair.QUERIES | clinical.QUERIES | extras.QUERIES | streams.QUERIES | feedback.QUERIES | trained.QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (ORACLES | repair.ORACLES | clinical.ORACLES | extras.ORACLES | streams.ORACLES | feedback.ORACLES | trained.ORACLES).items() if k in QUERIES}
