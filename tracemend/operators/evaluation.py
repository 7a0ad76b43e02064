"""Controlled runs: labels masked at several rates and seeds, repaired, and measured; runs that are kept and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemend.operators import inject, metrics
from tracemend.operators.running import running_sums, smallest_of_each
from tracemend.sources.files import exists


def runs(log: DataFrame, rates: list[float], seeds: list[int], repair: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Accuracy of `repair` for each rate and seed; one row each, with rate and seed."""
    out = None
    for rate in rates:
        for seed in seeds:
            masked = inject.apply_mask(log, inject.mask_share(log, rate, seed))
            one = metrics.accuracy(repair(masked)).select(F.lit(rate).alias("rate"), F.lit(seed).alias("seed"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def folder(root: str, rate: float, seed: int) -> str:
    return f"{root.rstrip('/')}/rate={rate:.2f}/seed={seed}"


def keep_run(log: DataFrame, root: str, rate: float, seed: int, overwrite: bool = False) -> str:
    """A masked log with its truth beside it, and a one-row summary; a run that is there stays unless overwrite."""
    at = folder(root, rate, seed)
    if overwrite or not exists(log.sparkSession, f"{at}/summary/_SUCCESS"):
        mask = inject.mask_share(log, rate, seed).select("seq", F.lit(True).alias("injected"))
        masked = log.join(mask, "seq", "left").withColumn("injected", F.coalesce("injected", F.lit(False)))
        masked = masked.withColumn("activity", F.when(~F.col("injected"), F.col("truth")))
        masked.write.mode("overwrite").parquet(f"{at}/events")
        masked.agg(F.count("*").alias("events"), F.count("truth").alias("labelled"), F.count_if("injected").alias("injected"), F.array_sort(F.collect_set("truth")).alias("activities")).write.mode("overwrite").json(f"{at}/summary")
    return at


def load_run(spark: SparkSession, root: str, rate: float, seed: int, drop_natural: bool = False) -> DataFrame:
    """A kept run; drop_natural: without the events whose label was missing before, and with seq counted anew."""
    at = folder(root, rate, seed)
    if not exists(spark, f"{at}/summary/_SUCCESS"):
        raise FileNotFoundError(f"no run at {at}")
    t = spark.read.parquet(f"{at}/events")
    if not drop_natural:
        return t
    kept = t.where("truth is not null").withColumn("_all", F.lit(0))
    return running_sums(kept, ["_all"], "seq", {"_nth": F.lit(1)}).withColumn("seq", F.col("_nth")).drop("_nth", "_all")


def top_labels(repaired: DataFrame, k: int = 10) -> DataFrame:
    """The k labels that were recovered most often, ties by name."""
    n = repaired.where("activity is null and recovered is not null").groupBy(F.col("recovered").alias("activity")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "activity").limit(k)


def holdout(log: DataFrame, share: float, seed: int) -> DataFrame:
    """Labelled events with their part: `holdout` for int(n * share) of them, by draws from seq, else `train`."""
    known = log.where("activity is not null")
    held = inject.sure_cut(known.select("seq", inject.draw(F.col("seq"), seed).alias("u")), "u", "seq", int(known.count() * share)).select("seq")
    train = known.join(held, "seq", "left_anti").select("seq", "activity", F.lit("train").alias("part"))
    return train.unionByName(known.join(held, "seq", "left_semi").select("seq", "activity", F.lit("holdout").alias("part")))


def class_counts(rows: DataFrame) -> DataFrame:
    """(activity, n, largest): how often each label occurs, and whether no label occurs more often."""
    n = rows.where("activity is not null").groupBy("activity").agg(F.count("*").alias("n"))
    return n.select("activity", "n", (F.col("n") == F.max("n").over(Window.partitionBy(F.lit(0)))).alias("largest"))  # a row for each label


def balanced_reservoir(rows: DataFrame, capacity: int) -> DataFrame:
    """At most `capacity` labelled events (seq, activity), balanced over labels: where a class-balanced reservoir settles.

    Labels with few events keep all; the others share the rest alike, the largest quota for which the sum stays within
    the capacity. Which events of a label stay depends on draws from seq, so every subset of its size is as likely.
    """
    n = rows.where("activity is not null").groupBy("activity").agg(F.count("*").alias("n"))
    # smallest classes first: quota where class k and all larger ones get an equal share of what the smaller ones leave
    w = Window.orderBy("n", "activity")  # a row for each label
    share = n.select("activity", "n", F.floor((F.lit(capacity) - (F.sum("n").over(w) - F.col("n"))) / (F.count("*").over(Window.partitionBy(F.lit(0))) - F.row_number().over(w) + 1)).alias("quota"))
    quota = share.crossJoin(F.broadcast(share.where("n > quota").agg(F.min_by("quota", F.struct("n", "activity")).alias("q")))).select("activity", F.least(F.coalesce("q", "n"), "n").alias("quota"))
    drawn = rows.where("activity is not null").select("seq", "activity", inject.draw(F.col("seq"), 7).alias("u"))
    return smallest_of_each(drawn, "activity", "u", "seq", quota).select("seq", "activity")
