"""Joins and windows in time: as-of snapshots, trailing extremes, latest changes, hourly groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, within_hours: float) -> DataFrame:
    """`left` with the latest `value` of `right` at or before its time and at most `within_hours` old, else null.

    Both sides meet in one sort by key and time; no pair is ever built, so a busy key costs a sort and not a product.
    """
    r = right.where(F.col(value).isNotNull()).select(F.col(key), F.col(ts), F.lit(0).alias("_side"), F.struct(ts, value).alias("_seen"))
    extra = [c for c in left.columns if c not in (key, ts)]
    both = left.select(key, ts, F.lit(1).alias("_side"), F.struct(*extra).alias("_row")).unionByName(r, allowMissingColumns=True)
    last = F.last("_seen", ignorenulls=True).over(Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0))
    fresh = seconds(F.col(ts)) - seconds(F.col("_last")[ts]) <= within_hours * 3600
    return both.withColumn("_last", last).where("_side = 1").select(key, ts, *(F.col("_row")[c].alias(c) for c in extra), F.when(fresh, F.col("_last")[value]).alias(f"last_{value}"))


def trailing(log: DataFrame, key: str, ts: str, value: str, hours: float) -> DataFrame:
    """Smallest, largest and number of values in the `hours` up to each row, both ends included."""
    frame = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-int(hours * 3_600_000_000), 0)
    return log.select("*", F.min(value).over(frame).alias("low"), F.max(value).over(frame).alias("high"), F.count(value).over(frame).alias("n"))


def latest_change(log: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """For each key the latest value and its difference from the one before."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))
    two = log.where(F.col(value).isNotNull()).select(key, value, rank.alias("rank")).where("rank <= 2")
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col(value)))
    return two.groupBy(key).agg(F.round(at(1), 6).alias("latest"), F.round(at(1) - at(2), 6).alias("change"))


def hourly(log: DataFrame, key: str, ts: str, value: str, label: str) -> DataFrame:
    """A row for each key and hour: readings, their mean, and the labels seen."""
    g = log.groupBy(key, F.date_trunc("hour", ts).alias("hour"))
    return g.agg(F.count("*").alias("readings"), F.round(F.avg(value), 6).alias("mean"), F.array_join(F.array_sort(F.collect_set(label)), ";").alias("labels"))


def intervals(rows: DataFrame, case: str, start: str, end: str, label: Column) -> DataFrame:
    """START and END events of rows that last."""
    event = lambda mark, ts: F.struct(F.concat(F.lit(mark + " "), label).alias("activity"), F.col(ts).alias("ts"))
    return rows.select(F.col(case).alias("case_id"), F.explode(F.array(event("START", start), event("END", end))).alias("e")).select("case_id", "e.*").where("ts is not null and activity is not null")


def recent(log: DataFrame, by: str, k: int) -> DataFrame:
    """The last k rows of each group."""
    return log.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("seq")))).where(F.col("_rank") <= k).drop("_rank")
