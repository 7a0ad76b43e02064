"""XES event logs: XML and YAML, read and written by Spark's own sources.

A trace is a row of the XML reader; its events are exploded in place. Sensor points sit in nested lists under an event
and become a map "source/id" -> value. Compressed files are read as such.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.functions import columns as C
from tracemend.schema import EVENT_LOG, label
from tracemend.sources.files import find_logs, is_yaml, rename_parts, resolve

_KEYED = "array<struct<_key:string,_value:string>>"
_KINDS = ["string", "date", "int", "float", "boolean", "id"]
_LIST = "array<struct<_key:string," + ",".join(f"{k}:{_KEYED}" for k in _KINDS) + ",list:array<struct<_key:string,`_stream:source`:string,`_stream:system`:string,`_stream:id`:string,`_stream:observation`:string," + ",".join(f"{k}:{_KEYED}" for k in _KINDS) + ">>>>"
_EVENT = "struct<" + ",".join(f"{k}:{_KEYED}" for k in _KINDS) + f",list:{_LIST}>"
TRACE = ", ".join(f"{k} {_KEYED}" for k in _KINDS) + f", event array<{_EVENT}>"

# Attributes that are fields of the log, not attributes of an event.
CORE = ["concept:name", "time:timestamp", "lifecycle:transition", "org:resource"]


def pairs_of(s: Column) -> Column:
    return F.concat(*(F.coalesce(s[k], F.array().cast(_KEYED)) for k in _KINDS))


def keyed(s: Column) -> Column:
    """All attributes of an element as one map; of equal keys the first counts."""
    pairs = pairs_of(s)
    return F.map_from_entries(F.aggregate(pairs, F.array().cast(_KEYED), lambda a, p: F.when(F.exists(a, lambda q: q["_key"] == p["_key"]), a).otherwise(F.concat(a, F.array(p)))))


def points(lists: Column) -> Column:
    """Sensor readings of an event: source or system, then id, its id attribute, or what follows # in the observation."""
    all_ = F.flatten(F.transform(F.coalesce(lists, F.array().cast(_LIST)), lambda stream: F.coalesce(stream["list"], F.array())))
    here = F.filter(all_, lambda p: p["_key"] == "stream:point")

    def entry(p: Column) -> Column:
        at = lambda key: F.get(F.filter(pairs_of(p), lambda q: q["_key"] == key), F.lit(0))["_value"]  # noqa: E731  # no map of all is made for each look
        source = F.coalesce(p["_stream:source"], p["_stream:system"], at("stream:source"), at("stream:system"), F.lit(""))
        seen = F.coalesce(p["_stream:observation"], at("stream:observation"))
        name = F.coalesce(p["_stream:id"], at("stream:id"), F.element_at(F.split(seen, "#"), -1), F.lit(""))
        return F.struct(F.concat_ws("/", source, name).alias("key"), at("stream:value").alias("value"))

    readings = F.transform(here, entry)
    return F.map_from_entries(F.aggregate(readings, F.array().cast("array<struct<key:string,value:string>>"), lambda a, p: F.concat(F.filter(a, lambda q: q["key"] != p["key"]), F.array(p))))


def read_xml(spark: SparkSession, path: str | list[str], streaming: bool = False, files_a_batch: int | None = None) -> DataFrame:
    """Events of XES files under a path in the event-log model; seq is null until ordered() gives one.

    The trace's own concept:name is the case; the `subprocess` field is the same. Timestamps lose their zone. A stream takes
    files as they come, `files_a_batch` of them at a time.
    """
    reader = (spark.readStream if streaming else spark.read).format("xml").option("rowTag", "trace").option("recursiveFileLookup", True).schema(TRACE)
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if streaming and files_a_batch else reader
    traces = reader.load(path).select(keyed(F.struct(*_KINDS)).alias("trace"), F.posexplode("event").alias("pos", "e"), F.col("_metadata.file_path").alias("file_path"))
    t = traces.select("trace", "pos", "file_path", keyed(F.col("e")).alias("a"), points(F.col("e.list")).alias("raw"))
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    return t.select(
        F.lit(None).cast("long").alias("seq"), at("trace", "concept:name").alias("case_id"), at("trace", "concept:name").alias("subprocess_id"), label(at("a", "concept:name")).alias("activity"),
        C.naive_timestamp(at("a", "time:timestamp")).alias("ts"), at("a", "lifecycle:transition").alias("lifecycle"), at("a", "org:resource").alias("resource"),
        F.map_filter("a", lambda k, _: ~k.isin(CORE)).alias("attributes"), F.map_filter(F.transform_values("raw", lambda _, v: C.number(v)), lambda _, v: v.isNotNull()).alias("sensors"),
        F.col("raw").alias("sensors_raw"), "file_path", "pos",
    )


def ordered(log: DataFrame, path: str | None = None) -> DataFrame:
    """seq from 0 by time, nulls first, then file and position; parts are numbered apart and shifted by their sizes.

    The numbered parts are stored once (below `path` or the shared folder), as both the sizes and the rows are read from them.
    """
    import uuid

    from pyspark.sql import Window

    spark = log.sparkSession
    at = path or f"{(spark.conf.get('spark.checkpoint.dir', '') or log_folder(spark)).rstrip('/')}/ordered-{uuid.uuid4().hex[:12]}"
    keys = [F.col("ts").asc_nulls_first(), F.col("file_path"), F.col("case_id"), F.col("pos")]
    ranged = log.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    ranged.withColumn("_part", F.shiftright("_row", 33)).withColumn("_row", F.col("_row").bitwiseAND((1 << 33) - 1)).write.mode("overwrite").parquet(at)
    kept = spark.read.parquet(at)
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return kept.join(F.broadcast(before), "_part").withColumn("seq", F.col("_row") + F.col("_before")).drop("_row", "_part", "_before", "pos")


def log_folder(spark: SparkSession) -> str:
    from tracemend.plans.models import _folder

    return _folder(spark, "log")


def read_logs(spark: SparkSession, path: str, where: Column | None = None, most_files: int | None = None, most_events: int | None = None) -> DataFrame:
    """Events of all XML and YAML logs under a path, found by their names; those that fulfil `where`; at most `most_events` of each trace, in order, and of `most_files` files."""
    from pyspark.sql import Window

    found = find_logs(spark, path, most_files)
    xml, yml = [f for f in found if not is_yaml(f)], [f for f in found if is_yaml(f)]
    parts = ([read_xml(spark, xml)] if xml else []) + ([read_yaml(spark, yml)] if yml else [])
    if not parts:
        return empty(spark).withColumn("pos", F.lit(0).cast("long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if where is not None:
        out = out.where(where)
    if most_events is not None:
        nth = F.row_number().over(Window.partitionBy("file_path", "case_id").orderBy("pos"))
        out = out.withColumn("_nth", nth).where(F.col("_nth") <= most_events).drop("_nth")
    return out


def read_single(spark: SparkSession, path: str) -> DataFrame:
    """Events of the one XES file that a path stands for, compressed or not."""
    return read_xml(spark, resolve(spark, path))


def write_xml(log: DataFrame, path: str, compression: str | None = None) -> None:
    """A log of traces with their events, time and sensors; a case's events are gathered, as a trace is one element."""
    pair = lambda k, v: F.struct(F.lit(k).alias("_key"), v.alias("_value"))
    strings = F.filter(F.array(pair("concept:name", F.col("activity")), pair("lifecycle:transition", F.col("lifecycle")), pair("org:resource", F.col("resource"))), lambda p: p["_value"].isNotNull())
    extra = F.transform(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("_key"), e["value"].alias("_value")))
    stamp = F.array(pair("time:timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    text = lambda k, v: F.struct(F.lit(k).alias("_key"), v.alias("_value"))
    point = lambda e: F.struct(F.lit("stream:point").alias("_key"), F.array(text("stream:source", F.element_at(F.split(e["key"], "/", 2), 1)), text("stream:id", F.coalesce(F.try_element_at(F.split(e["key"], "/", 2), F.lit(2)), F.lit(""))), text("stream:value", e["value"])).alias("string"))
    stream = F.transform(F.map_entries("sensors_raw"), point)
    lists = F.when(F.size("sensors_raw") > 0, F.array(F.struct(F.lit("stream:datastream").alias("_key"), stream.alias("list"))))
    events = log.select("case_id", "seq", F.struct(F.concat(strings, extra).alias("string"), stamp.alias("date"), lists.alias("list")).alias("e"))
    traces = events.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "e"))), lambda x: x["e"]).alias("event"))
    traces.select(F.array(pair("concept:name", F.col("case_id"))).alias("string"), "event").write.mode("overwrite").format("xml").option("rowTag", "trace").option("rootTag", "log").option("compression", compression or "none").save(path)
    rename_parts(log.sparkSession, path, ".xes.gz" if compression == "gzip" else ".xes")


def main_index(log: DataFrame) -> DataFrame:
    """A trace for each file: how many events and cases it has."""
    return log.groupBy("file_path").agg(F.count("*").alias("events"), F.countDistinct("case_id").alias("cases"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def without_markers(log: DataFrame) -> DataFrame:
    """The log without the events that mark its training and test windows."""
    return log.where(~F.coalesce(F.col("activity").rlike("^LogWindow_(train|test)$"), F.lit(False)))


def read_yaml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Events of YAML logs: documents apart by lines of ---; a `log` document names the trace, `event` documents follow.

    A document is a row, so a long file is read by as many tasks as it has blocks. Each document is parsed by itself, once, and
    what it says is stored in the shared folder; the trace of an event is the last one named before it in its block, or else at
    the end of the blocks before. Needs PyYAML on the executors, and takes its C parser where that was built. A document without
    either, or of another kind, gives no event.
    """
    from pyspark.sql import Window

    reader = spark.read.option("lineSep", "\n---")
    if isinstance(path, str):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.y*ml*")
    docs = reader.text(path).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))

    def each(batches: Iterator) -> Iterator:
        import pandas as pd
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        here, trace = None, None
        for pdf in batches:
            out = []
            for text, f, block, at in zip(pdf["value"], pdf["file_path"], pdf["block"], pdf["at"], strict=True):
                if here != (f, block):
                    here, trace = (f, block), None
                doc = yaml.load(text.lstrip("-"), Loader=loader)
                if not isinstance(doc, dict):
                    continue
                if "log" in doc:
                    name = ((doc["log"] or {}).get("trace") or {}).get("concept:name")
                    if name is not None:
                        trace = str(name)
                        out.append((True, trace, None, None, None, None, None, None, f, block, at))
                elif "event" in doc:
                    e = doc["event"] or {}
                    raw = {}
                    for item in e.get("stream:datastream") or []:
                        if p := item.get("stream:point"):
                            raw[f"{p.get('stream:source') or p.get('stream:system') or ''}/{p.get('stream:id') or str(p.get('stream:observation') or '').rpartition('#')[2]}"] = str(p.get("stream:value"))
                    text_of = lambda k, e=e: None if e.get(k) is None else str(e[k])
                    out.append((False, trace, text_of("concept:name"), text_of("time:timestamp"), text_of("lifecycle:transition"), text_of("org:resource"), {k: str(v) for k, v in e.items() if k not in (*CORE, "stream:datastream") and v is not None}, raw, f, block, at))
            yield pd.DataFrame(out, columns=["names", "trace", "activity", "timestamp", "lifecycle", "resource", "attributes", "raw", "file_path", "block", "at"])

    kind = "names boolean, trace string, activity string, timestamp string, lifecycle string, resource string, attributes map<string,string>, raw map<string,string>, file_path string, block long, at long"
    at = f"{log_folder(spark)}/documents"
    docs.mapInPandas(each, kind).write.parquet(at)
    t = spark.read.schema(kind).parquet(at)
    last = t.groupBy("file_path", "block").agg(F.max_by("trace", F.when(F.col("names"), F.col("at"))).alias("_last"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file_path", "block", F.last("_last", ignorenulls=True).over(before).alias("_carried")).where("_carried is not null")  # a row for each block
    t = t.where(~F.col("names")).join(F.broadcast(carried), ["file_path", "block"], "left").withColumn("case_id", F.coalesce("trace", "_carried"))
    return t.select(
        F.lit(None).cast("long").alias("seq"), "case_id", F.col("case_id").alias("subprocess_id"), label("activity").alias("activity"), C.naive_timestamp(F.replace(F.col("timestamp"), F.lit(" "), F.lit("T"))).alias("ts"), "lifecycle", "resource",
        "attributes", F.map_filter(F.transform_values("raw", lambda _, v: C.number(v)), lambda _, v: v.isNotNull()).alias("sensors"), F.col("raw").alias("sensors_raw"), "file_path", F.col("at").alias("pos"),
    )


def write_yaml(log: DataFrame, path: str) -> None:
    """A log as YAML documents, a `log` document before the events of a case; values are written as JSON texts, which are YAML."""
    quoted = lambda c: F.to_json(F.struct(c.cast("string").alias("v")))
    text = lambda c: F.regexp_extract(quoted(c), r'^\{"v":(.*)\}$', 1)
    line = lambda k, c: F.when(c.isNotNull(), F.concat(F.lit(f'  "{k}": '), text(c), F.lit("\n"))).otherwise("")
    extra = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(F.lit("  "), text(e["key"]), F.lit(": "), text(e["value"]), F.lit("\n"))), "")
    source, name = (lambda e, i=i: F.coalesce(F.try_element_at(F.split(e["key"], "/", 2), F.lit(i)), F.lit("")) for i in (1, 2))
    seen = F.filter(F.map_entries("sensors_raw"), lambda e: e["value"].isNotNull())
    point = lambda e: F.concat(F.lit('    - "stream:point": {"stream:source": '), text(source(e)), F.lit(', "stream:id": '), text(name(e)), F.lit(', "stream:value": '), text(e["value"]), F.lit("}\n"))
    points_ = F.when(F.size(seen) > 0, F.concat(F.lit('  "stream:datastream":\n'), F.array_join(F.transform(seen, point), ""))).otherwise("")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    event = F.concat(F.lit("---\nevent:\n"), line("concept:name", F.col("activity")), line("time:timestamp", stamp), extra, points_)
    head = F.concat(F.lit('---\nlog:\n  trace:\n    "concept:name": '), text(F.col("case_id")), F.lit("\n"))
    cases = log.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", event.alias("e")))), lambda x: x["e"]), "").alias("events"))  # a case is one document chain
    cases.select(F.concat(head, "events").alias("value")).write.mode("overwrite").text(path)
    rename_parts(log.sparkSession, path, ".xes.yaml")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_LOG)
