"""The event-log model: one row for each event, in arrival order `seq`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_LOG = (
    "seq long, case_id string, subprocess_id string, activity string, ts timestamp_ntz, lifecycle string, resource string, "
    "attributes map<string,string>, sensors map<string,double>, sensors_raw map<string,string>, file_path string"
)

#: provenance of a repaired label
NORMAL, BY_CLUSTER, BY_SEQUENCE, UNRECOVERED = "NORMAL", "RECOVERED_ML", "RECOVERED_ML_SEQ", "UNRECOVERED_ML"


def label(c: Column | str) -> Column:
    """A label or null: blank text is no label."""
    return F.nullif(F.trim(c), F.lit(""))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log in a table `events`: cases are users, `truth` the label, `activity` the label with one in ten masked."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("case_id"), label("event_type").alias("truth"),
        F.when(F.col("event_id") % 10 != 7, label("event_type")).alias("activity"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "props",
    )
