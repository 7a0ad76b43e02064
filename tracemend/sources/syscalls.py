"""A log of system calls from wide audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.functions import columns as C


def from_audit(rows: DataFrame, counters: list[str], lists: list[str]) -> DataFrame:
    """(case_id, activity, ts, attributes, sensors) from columns pid, syscall, uid, success, time and others.

    The label joins call, user and success, and is null where success is. Counters that are neither null nor 0 and the
    sizes of the lists become sensors; text is cut at 500 characters.
    """
    num = [x for c in counters for x in (F.lit(f"counter/{c}"), C.number(F.col(c).cast("string")))]
    sizes = [x for c in lists for x in (F.lit(f"list/{c}"), F.size(C.text_list(F.col(c))).cast("double"))]
    sensors = F.map_filter(F.create_map(*num, *sizes), lambda _, v: v.isNotNull() & (v != 0))
    label = F.when(F.col("success").isNotNull(), F.concat_ws("_", "syscall", F.col("uid").cast("string"), F.col("success").cast("string")))
    rest = [c for c in rows.columns if c not in {*counters, *lists, "pid", "syscall", "uid", "success", "time"}]
    attributes = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.substring(F.col(c).cast("string"), 1, 500))]) if rest else F.create_map().cast("map<string,string>"), lambda _, v: v.isNotNull())
    return rows.select(F.col("pid").cast("string").alias("case_id"), label.alias("activity"), C.naive_timestamp(F.col("time").cast("string")).alias("ts"), attributes.alias("attributes"), sensors.alias("sensors"))


def read_csv(spark: SparkSession, path: str, columns: list[str], counters: list[str], lists: list[str]) -> DataFrame:
    """Only `columns` are read."""
    return from_audit(spark.read.option("header", True).csv(path).select(*columns), counters, lists)
