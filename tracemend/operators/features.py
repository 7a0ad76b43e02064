"""Control-flow, time, payload and sensor features as window functions; every frame ends at or before the event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemend.functions import columns as C


def by_case():
    return Window.partitionBy("case_id").orderBy("seq")
PAD, MISSING, FIRST_ID = 0, 1, 2


def previous_activities(log: DataFrame, k: int) -> DataFrame:
    """The k labels before each event of its case, most recent first, '' where there is none."""
    return log.select("seq", *(F.coalesce(F.lag("activity", i).over(by_case()), F.lit("")).alias(f"prev_{i}") for i in range(1, k + 1)))


def vocabulary(log: DataFrame) -> DataFrame:
    """Label ids from FIRST_ID on, by first sight."""
    first = log.where("activity is not null").groupBy("activity").agg(F.min("seq").alias("first_seq"))
    return first.select("activity", (F.row_number().over(Window.orderBy("first_seq")) + FIRST_ID - 1).alias("label_id"), "first_seq")  # a row for each label


def prefix_ids(log: DataFrame, width: int) -> DataFrame:
    """The ids of the `width` events before each event, padded on the left; missing labels have an id of their own."""
    return with_ids(log).select("seq", padded_ids(width).alias("prefix"))


def padded_ids(width: int):
    """The column of prefix_ids() over rows with `id`."""
    seen = F.collect_list("id").over(by_case().rowsBetween(-width, -1))
    return F.concat(F.array_repeat(F.lit(PAD), F.lit(width) - F.size(seen)), seen)


def gap_hours(cap: float = 24.0):
    """The column of hours_since_previous() before rounding."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return F.coalesce(F.least((seconds - F.lag(seconds).over(by_case())) / 3600, F.lit(cap)), F.lit(0.0))


def with_ids(log: DataFrame) -> DataFrame:
    """log with the `id` of each label; missing labels have an id of their own."""
    return log.join(F.broadcast(vocabulary(log).select("activity", "label_id")), "activity", "left").withColumn("id", F.coalesce("label_id", F.lit(MISSING))).drop("label_id")  # a row for each label


def hours_since_previous(log: DataFrame, cap: float = 24.0) -> DataFrame:
    """Hours since the case's previous event, capped above only; 0 for the first."""
    return log.select("seq", F.round(gap_hours(cap), 6).alias("hours"))


def occurrences(log: DataFrame) -> DataFrame:
    """How often the event's label, and its predecessor's, occurred in the case before the event."""
    same = Window.partitionBy("case_id", "activity").orderBy("seq")
    counted = log.select("seq", "case_id", "activity", F.when(F.col("activity").isNull(), 0).otherwise(F.count("*").over(same.rowsBetween(Window.unboundedPreceding, -1))).alias("current_before"), F.when(F.col("activity").isNull(), 0).otherwise(F.count("*").over(same.rowsBetween(Window.unboundedPreceding, 0))).alias("with_own"))
    return counted.select("seq", F.col("current_before").cast("long").alias("current_before"), F.coalesce(F.lag("with_own").over(by_case()), F.lit(0)).cast("long").alias("prev_before"))


def self_loops(log: DataFrame) -> DataFrame:
    """Whether the two labels before the event are the same, and whether the one before equals the event's."""
    one, two = F.lag("activity", 1).over(by_case()), F.lag("activity", 2).over(by_case())
    return log.select("seq", F.coalesce(one == two, F.lit(False)).cast("int").alias("prev_loop"), F.coalesce(one == F.col("activity"), F.lit(False)).cast("int").alias("current_loop"))


def case_age(log: DataFrame) -> DataFrame:
    """Events so far, distinct labels so far, events for each label (10 at most), and age in hours, as logarithms."""
    frame = by_case().rowsBetween(Window.unboundedPreceding, 0)
    first = F.when(F.col("activity").isNotNull() & (F.row_number().over(Window.partitionBy("case_id", "activity").orderBy("seq")) == 1), 1).otherwise(0)
    t = log.withColumn("new", first)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    total, distinct = F.count("*").over(frame), F.sum("new").over(frame)
    age = (seconds - F.min(seconds).over(frame)) / 3600
    return t.select("seq", F.round(F.log1p(total), 6).alias("log_total"), F.round(F.log1p(distinct), 6).alias("log_distinct"), F.round(F.least(total / F.greatest(distinct, F.lit(1)), F.lit(10.0)), 6).alias("repetition"), F.round(F.log1p(age), 6).alias("log_age"))


def sensor_windows(readings: DataFrame, width: int = 10) -> DataFrame:
    """Over the last `width` readings of a sensor (case_id, sensor, seq, value): mean, population deviation, slope, step."""
    order = Window.partitionBy("case_id", "sensor").orderBy("seq")
    frame = order.rowsBetween(-(width - 1), 0)
    t = readings.withColumn("i", F.row_number().over(order))
    slope = F.when(F.count("*").over(frame) >= 2, F.regr_slope("value", "i").over(frame)).otherwise(0.0)
    return t.select(
        "seq", "sensor", F.round("value", 6).alias("value"), F.round(F.avg("value").over(frame), 6).alias("mean"), F.round(F.stddev_pop("value").over(frame), 4).alias("deviation"),
        (F.round(slope, 4) + 0.0).alias("slope"), F.round(F.coalesce(F.col("value") - F.lag("value").over(order), F.lit(0.0)), 4).alias("step"),
    )


def onehot(log: DataFrame, column: str, most: int) -> DataFrame:
    """The first-sight number of a category, from 0; null for categories after the first `most`."""
    first = log.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("seq").alias("first_seq"))
    ranked = first.orderBy("first_seq").limit(most).select(column, (F.row_number().over(Window.orderBy("first_seq")) - 1).alias("slot"))  # `most` rows
    return log.join(F.broadcast(ranked), column, "left").select("seq", "slot")


def standardise(log: DataFrame, value: str, floor: float = 1e-8) -> DataFrame:
    """(value - mean) / population deviation over labelled events; the deviation is floored."""
    m = log.where("activity is not null").agg(F.avg(value).alias("mean"), F.greatest(F.stddev_pop(value), F.lit(floor)).alias("deviation"))
    return log.crossJoin(F.broadcast(m)).select("seq", F.round((F.col(value) - F.col("mean")) / F.col("deviation"), 4).alias("z"))  # one row


def running_standardise(log: DataFrame, value: str) -> DataFrame:
    """Standardised by the case's own rows so far (sample deviation); the first row of a case is 0."""
    frame = by_case().rowsBetween(Window.unboundedPreceding, 0)
    n, mean, dev = F.count(value).over(frame), F.avg(value).over(frame), F.stddev_samp(value).over(frame)
    return log.select("seq", F.round(F.when((n < 2) | (dev < 1e-8), 0.0).otherwise((F.col(value) - mean) / dev), 4).alias("z"))


def payload(log: DataFrame, keys: dict[str, bool]) -> DataFrame:
    """Attributes by declared kind: key -> whether it is numeric."""
    return log.select("seq", F.concat(*(C.attribute_vector(F.try_element_at("attributes", F.lit(k)), n) for k, n in sorted(keys.items()))).alias("payload"))


def warmup_end(log: DataFrame, start: int = 200, target: int = 500, most: int = 1000, enough: int = 20, few: int = 5, stable: int = 500) -> DataFrame:
    """The 1-based position at which warm-up ends.

    Never before `start`; at `most` in any case; else from `target` on, once `enough` labels are known, or `few` and no
    new one for `stable` events. Labels count from `start` on. Only first positions of labels meet in one task.
    """
    pos = F.col("seq") + 1
    first = log.where("activity is not null").where(pos >= start).groupBy("activity").agg(F.min(pos).alias("at"))
    w = Window.orderBy("at")
    k, after = F.row_number().over(w), F.lead("at").over(w)
    end = F.when(k >= enough, F.greatest("at", F.lit(target))).when(k >= few, F.greatest(F.col("at") + stable, F.lit(target)))
    ends = first.select(k.alias("k"), end.alias("end"), after.alias("after")).where("end is not null and (after is null or end < after)")
    return ends.agg(F.least(F.min("end"), F.lit(most)).alias("warmup_end")).select(F.coalesce("warmup_end", F.lit(most)).cast("long").alias("warmup_end"))


def vector(*parts: Column) -> Column:
    """Feature columns and arrays as one array."""
    return F.concat(*parts)
