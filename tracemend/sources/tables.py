"""Event logs in CSV files and wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.functions import columns as C
from tracemend.schema import label

# Columns of a wide table that are fields of the log; names that stand for a field.
FIELDS = {"seq": "seq", "case_id": "case_id", "subprocess_id": "subprocess_id", "activity": "activity", "concept_name": "activity", "timestamp": "timestamp", "lifecycle": "lifecycle", "resource": "resource", "file_path": "file_path"}


def gathered(columns: dict[str, str]) -> Column:
    """A map of the columns (key -> column) that aren't null or blank."""
    if not columns:
        return F.create_map().cast("map<string,string>")
    pairs = [x for k, c in columns.items() for x in (F.lit(k), F.col(f"`{c}`").cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (F.trim(v) != ""))


def canonical(df: DataFrame, attributes: Column, sensors_raw: Column) -> DataFrame:
    """The event-log model from named string columns; absent fields are null."""
    has = lambda c, kind="string": (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
    return df.select(
        has("seq", "long").alias("seq"), has("case_id").alias("case_id"), has("subprocess_id").alias("subprocess_id"), label(has("activity")).alias("activity"),
        C.naive_timestamp(has("timestamp")).alias("ts"), has("lifecycle").alias("lifecycle"), has("resource").alias("resource"), attributes.alias("attributes"),
        F.map_filter(F.transform_values(sensors_raw, lambda _, v: C.number(v)), lambda _, v: v.isNotNull()).alias("sensors"), sensors_raw.alias("sensors_raw"), has("file_path").alias("file_path"),
    )


def from_wide(df: DataFrame) -> DataFrame:
    """A wide table: columns attr_* become attributes, sensor_* become sensors."""
    named = df.withColumnsRenamed({c: FIELDS[c] for c in df.columns if c in FIELDS and FIELDS[c] not in df.columns})
    of = lambda p: {c.removeprefix(p): c for c in df.columns if c.startswith(p)}
    return canonical(named, gathered(of("attr_")), gathered(of("sensor_")))


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    return from_wide(spark.read.option("header", True).option("recursiveFileLookup", True).csv(path))


def read_ticket_csv(spark: SparkSession, path: str, fields: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """A CSV log with columns of its own: `fields` names them for the model, `drop` leaves some out, the rest are attributes."""
    df = spark.read.option("header", True).csv(path)
    rest = {c: c for c in df.columns if c not in fields and c not in drop}
    kept = df.select(*(F.col(f"`{c}`").alias(f) for c, f in fields.items()), gathered(rest).alias("_rest"))
    return canonical(kept, F.col("_rest"), gathered({}))


def write_log(log: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Parquet, with a one-row summary beside it."""
    w = log.write.mode("overwrite")
    (w.partitionBy(*partitions) if partitions else w).parquet(f"{path}/events")
    log.agg(F.count("*").alias("events"), F.count("activity").alias("labelled"), F.countDistinct("case_id").alias("cases"), F.array_sort(F.collect_set("activity")).alias("activities")).write.mode("overwrite").json(f"{path}/summary")
