"""Running sums over keys with many rows, in blocks.

A window over a key with a frame from its first row sorts all rows of the key in one task. Here a row's sum is that of the
blocks before its own, which is a window over one row for each key and block, plus that within its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16  #: positions of `order` that make a block


def running_sums(rows: DataFrame, keys: list[str], order: str, values: dict[str, Column], block_rows: int = BLOCK_ROWS, deep: bool = False) -> DataFrame:
    """rows with, for each name in `values`, the sum of its expression over the rows of the same keys that stand earlier.

    `order` counts arrivals, so a block holds `block_rows` rows of all keys at most; rows that repeat a position share a
    block. Null keys are a key, null values count as 0. deep: the sums of blocks are summed in blocks in turn, for keys of
    many millions of blocks.
    """
    named = [f"_k_{k}" for k in keys]
    block = F.coalesce(F.floor(F.col(order) / block_rows), F.lit(-1)).alias("_block")  # rows without a position come first
    # keys that are never null, so that sums, join and window are dealt out by the same expressions
    t = rows.select("*", block, *(F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("n")).alias(n) for k, n in zip(keys, named, strict=True)), *(F.coalesce(v, F.lit(0)).alias(f"_v_{n}") for n, v in values.items()))
    sums = t.groupBy(*named, "_block").agg(*(F.sum(f"_v_{n}").alias(f"_b_{n}") for n in values))
    if deep:
        sums = running_sums(sums.withColumnRenamed("_block", "_outer"), named, "_outer", {f"_p_{n}": F.col(f"_b_{n}") for n in values}, block_rows).withColumnRenamed("_outer", "_block")
        earlier = {n: F.col(f"_p_{n}") for n in values}
    else:
        blocks = Window.partitionBy(*named).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        earlier = {n: F.coalesce(F.sum(f"_b_{n}").over(blocks), F.lit(0)) for n in values}
    before = sums.select(*named, "_block", *(v.alias(f"_b_{n}") for n, v in earlier.items()))
    inside = Window.partitionBy(*named, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = t.select("*", *(F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_i_{n}") for n in values))
    return so_far.join(before, [*named, "_block"]).select(*rows.columns, *((F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in values))


def sure_cut(rows: DataFrame, by: str, ties: str, n: int, cells: int = 1 << 16) -> DataFrame:
    """The n rows with the smallest `by`, a number in [0, 1), ties by `ties`, without an order of all rows.

    Counts of equal cells of [0, 1) say in which cell the n-th row lies; only that cell is ranked.
    """
    cell = F.floor(F.col(by) * cells)
    counts = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("k"))  # `cells` rows at most
    upto = F.sum("k").over(Window.orderBy("cell"))
    at = counts.select("cell", upto.alias("upto"), (upto - F.col("k")).alias("before")).where(F.col("upto") >= n).orderBy("cell").first()
    if at is None or n <= 0:
        return rows if n > 0 else rows.limit(0)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(by, ties))  # one cell's rows
    edge = rows.where(cell == at["cell"]).withColumn("_rank", rank).where(F.col("_rank") <= n - at["before"]).drop("_rank")
    return rows.where(cell < at["cell"]).unionByName(edge)


def smallest_of_each(rows: DataFrame, key: str, by: str, ties: str, quota: DataFrame, cells: int = 1 << 16) -> DataFrame:
    """Of each key the `quota` rows (key, quota: a row for each key) with the smallest `by`, a number in [0, 1), ties by `ties`.

    Counts of cells say up to which cell rows can be wanted; only rows up to there are ranked, about `quota` of each key.
    """
    cell = F.floor(F.col(by) * cells)
    counts = rows.groupBy(key, cell.alias("_cell")).agg(F.count("*").alias("_k"))
    upto = counts.withColumn("_upto", F.sum("_k").over(Window.partitionBy(key).orderBy("_cell"))).join(quota, key)
    last = quota.join(upto.where(F.col("_upto") >= F.col("quota")).groupBy(key).agg(F.min("_cell").alias("_last")), key, "left")
    some = rows.join(F.broadcast(last), key).where(cell <= F.coalesce("_last", F.lit(cells)))  # a row for each key
    rank = F.row_number().over(Window.partitionBy(key).orderBy(by, ties))
    return some.withColumn("_rank", rank).where(F.col("_rank") <= F.col("quota")).drop("_rank", "_last", "quota")
