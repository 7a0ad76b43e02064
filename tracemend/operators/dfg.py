"""Directly-follows graphs as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemend.operators.running import BLOCK_ROWS, running_sums


def by_case():
    return Window.partitionBy("case_id").orderBy("seq")


def follows(log: DataFrame) -> DataFrame:
    """Each event with the label before it in its case (null for the first, or where that label is missing)."""
    return log.withColumn("prev", F.lag("activity").over(by_case()))


def edges(log: DataFrame) -> DataFrame:
    """(src, dst, weight) over neighbours in a case that both have labels."""
    return follows(log).where("prev is not null and activity is not null").groupBy(F.col("prev").alias("src"), F.col("activity").alias("dst")).agg(F.count("*").alias("weight"))


def entropy(edges: DataFrame, by: str) -> DataFrame:
    """Total weight and natural-log entropy of the edges out of (by=src) or into (by=dst) each label."""
    total = F.sum("weight").over(Window.partitionBy(by))
    p = F.col("weight") / F.col("total")
    return edges.withColumn("total", total).groupBy(F.col(by).alias("activity")).agg(F.max("total").alias("total"), F.round(-F.sum(p * F.log(p)), 6).alias("entropy"))


def parallel_pairs(edges: DataFrame, least: int = 5, balance: float = 0.3) -> DataFrame:
    """Unordered pairs that follow each other both ways: both counts at least `least`, their ratio at least `balance`."""
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("back"))
    low, high = F.least("weight", "back"), F.greatest("weight", "back")
    return edges.join(back, ["src", "dst"]).where((F.col("src") < F.col("dst")) & (low >= least) & (low / high >= balance)).select(F.col("src").alias("a"), F.col("dst").alias("b"), low.alias("low"), high.alias("high"))


def parallel_features(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each source label: whether it has parallel siblings, how many, and their share of its outgoing weight."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    marked = edges.join(both.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("sibling")), ["src", "dst"], "left")
    siblings = F.count("sibling")
    share = F.sum(F.when(F.col("sibling") == 1, F.col("weight")).otherwise(0)) / F.sum("weight")
    return marked.groupBy(F.col("src").alias("activity")).agg((siblings > 0).cast("int").alias("is_parallel"), siblings.alias("siblings"), F.round(share, 6).alias("sibling_share"))


def running_outgoing(log: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each event with a predecessor: how often that label has been left before, and left for this label, in all cases."""
    pairs = follows(log).where("prev is not null and activity is not null").select("seq", "prev", "activity")
    out = running_sums(pairs, ["prev"], "seq", {"out_before": F.lit(1)}, block_rows)
    return running_sums(out, ["prev", "activity"], "seq", {"edge_before": F.lit(1)}, block_rows)


def counts(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: n_edges, n_parallel_pairs."""
    return edges.agg(F.count("*").alias("n_edges")).crossJoin(pairs.agg(F.count("*").alias("n_parallel_pairs")))  # one row each
