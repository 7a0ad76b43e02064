"""Attributes of events as vectors of fixed width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemend.functions import columns as C


def common_keys(log: DataFrame, most: int, column: str = "attributes") -> DataFrame:
    """(key, n): the `most` keys of a map column that most events have, ties by name."""
    n = log.select(F.explode(F.map_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "key").limit(most)


def key_slots(log: DataFrame, most: int, column: str = "attributes") -> DataFrame:
    """(key, slot): keys of a map column by first sight, those of one event by name; the first `most`."""
    first = log.select("seq", F.explode(F.map_keys(column)).alias("key")).groupBy("key").agg(F.min("seq").alias("first"))
    ranked = first.orderBy("first", "key").limit(most)
    return ranked.select("key", (F.row_number().over(Window.orderBy("first", "key")) - 1).alias("slot"))  # `most` rows


def sized_number(value: Column) -> Column:
    """A number for a text: itself, or the length of a list or map written in it; null for other texts."""
    items = F.size(F.from_json(F.regexp_replace(value, "'", '"'), "array<string>"))
    entries = F.size(F.from_json(F.regexp_replace(value, "'", '"'), "map<string,string>"))
    listed, mapped = value.startswith("["), value.startswith("{")
    may = value.rlike(r"^[\x00-\x20]*[+-]?[0-9.iInN]")  # whatever reads as a number begins so; trying others costs an exception each
    return F.coalesce(F.when(may, C.number(value)), F.when(listed & (items >= 0), items.cast("double")), F.when(mapped & (entries >= 0), entries.cast("double")))


def hash_words(text: Column, size: int) -> list[Column]:
    """The first `size` bytes of a text's md5 as numbers of seven bytes each."""
    return [F.conv(F.substring(F.md5(text), 2 * i + 1, 14), 16, 10).cast("long") for i in range(0, min(size, 16), 7)]


def hash_cells(words: list[Column], size: int) -> list[Column]:
    """columns.hash_vector of the same text, from hash_words."""
    byte = lambda i: F.shiftright(words[i // 7], 8 * (min(7, 16 - i // 7 * 7) - 1 - i % 7)).bitwiseAND(255)
    return [(byte(i).cast("double") / 255.0 * 2 - 1) if i < 16 else F.lit(None).cast("double") for i in range(size)]


def payload(log: DataFrame, slots: list[str], hash_dim: int = 8, column: str = "attributes") -> DataFrame:
    """seq and payload: for each slot whether it is there, its number, whether it is one; hashes of the values; the hash of all keys; how many.

    The width is len(slots) * (3 + hash_dim) + hash_dim + 1. Values are hashed by their first 200 characters. What several cells
    are made of, numbers and hashes, is found once a row.
    """
    names = F.array_sort(F.map_keys(column))
    at = [F.try_element_at(column, F.lit(k)) for k in slots]
    has = [F.map_contains_key(F.col(column), F.lit(k)) for k in slots]
    texts = [F.substring(F.coalesce(v, F.lit("None")), 1, 200) for v in at] + [F.array_join(names, "|")]
    words = [w.alias(f"_w{j}_{g}") for j, x in enumerate(texts) for g, w in enumerate(hash_words(x, hash_dim))]
    t = log.select("seq", F.size(names).alias("_size"), *(h.alias(f"_h{i}") for i, h in enumerate(has)), *(sized_number(v).alias(f"_n{i}") for i, v in enumerate(at)), *words)
    groups = len(words) // len(texts)
    of = lambda j, there: [F.when(there, c).otherwise(0.0) for c in hash_cells([F.col(f"_w{j}_{g}") for g in range(groups)], hash_dim)]
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    own = range(len(slots))
    cells = [*(flag(F.col(f"_h{i}")) for i in own), *(F.coalesce(F.col(f"_n{i}"), F.lit(0.0)) for i in own), *(flag(F.col(f"_n{i}").isNotNull()) for i in own)]
    hashes = [c for i in own for c in of(i, F.col(f"_h{i}"))] + of(len(slots), F.col("_size") > 0)
    return t.select("seq", F.array(*cells, *hashes, F.greatest(F.col("_size"), F.lit(0)).cast("double")).alias("payload"))


def sensor_names(sensors: list[str]) -> list[str]:
    """Names of the cells of a sensor vector: six for each sensor, kind by kind."""
    return [f"iot_{kind}_{s}" for kind in ("val", "pres", "mean", "std", "slope", "delta") for s in sorted(sensors)]


def enriched(parts: DataFrame, weight: Column) -> DataFrame:
    """seq and x: data, control flow scaled by a confidence, sensors, end to end. parts: seq, data, flow, sensors (arrays)."""
    flow = F.transform("flow", lambda v: v * weight)
    return parts.select("seq", F.concat("data", flow, "sensors").alias("x"))


def running_standardised(rows: DataFrame, dims: int, by: str | None = None) -> DataFrame:
    """seq and x with each cell standardised by the rows so far, of the key `by` or of all (sample deviation, floored); the first row is zeros."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    cell = lambda i: F.get("x", F.lit(i))
    got = [F.when(F.count(F.lit(1)).over(w) < 2, 0.0).otherwise((cell(i) - F.avg(cell(i)).over(w)) / F.greatest(F.stddev_samp(cell(i)).over(w), F.lit(1e-8))) for i in range(dims)]
    return rows.select("seq", F.array(*got).alias("x"))


def label_vector(label: Column, dims: int = 8) -> Column:
    """A vector for a label that depends on the label alone: cells in [-1, 1] from md5 of label and position."""
    h = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", label, i.cast("string"))), 1, 8), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: h(i) / float((1 << 32) - 1) * 2 - 1)
