"""Masking of known labels, by rules that each engine repeats alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemend.operators.running import sure_cut


def draw(*keys: Column | int) -> Column:
    """A number in [0, 1) from md5 of the keys."""
    h = F.md5(F.concat_ws(":", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)


def mask_share(log: DataFrame, rate: float, seed: int) -> DataFrame:
    """`int(n * rate)` labelled events, those with the smallest draws; seq and truth."""
    known = log.where("truth is not null").select("seq", "truth", draw(F.col("seq"), seed).alias("u"))
    return sure_cut(known, "u", "seq", int(known.count() * rate)).select("seq", "truth")


def mask_bursts(log: DataFrame, every: int, size: int) -> DataFrame:
    """Runs of `size` labelled events of a case in each `every`; seq and truth."""
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("seq")) - 1
    return log.where("truth is not null").withColumn("rank", rank).where(F.pmod("rank", F.lit(every)) < size).select("seq", "truth")


def mask_activities(log: DataFrame, activities: list[str], rate: float, seed: int) -> DataFrame:
    """Events with one of the labels, each with chance `rate`; seq and truth."""
    return log.where(F.col("truth").isin(activities) & (draw(F.col("seq"), seed) < rate)).select("seq", "truth")


def apply_mask(log: DataFrame, mask: DataFrame) -> DataFrame:
    """The log with `activity` null at the masked events and `truth` beside it."""
    m = mask.select("seq", F.lit(True).alias("masked"))
    return log.join(m, "seq", "left").withColumn("activity", F.when(F.col("masked").isNull(), F.col("truth"))).drop("masked")


__all__ = ["apply_mask", "draw", "mask_activities", "mask_bursts", "mask_share"]
