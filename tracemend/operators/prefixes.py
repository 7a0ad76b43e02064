"""Next-label counts by prefix: top label, dominance, support, repair, veto."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemend.operators.running import BLOCK_ROWS, running_sums
from tracemend.schema import BY_SEQUENCE, NORMAL, UNRECOVERED


def by_case():
    return Window.partitionBy("case_id").orderBy("seq")


def with_prefix(log: DataFrame, order: int) -> DataFrame:
    """The `order` labels before each event, joined, '?' for a missing label and '' before the case begins."""
    before = [F.when(F.lag("seq", i).over(by_case()).isNull(), "").otherwise(F.coalesce(F.lag("activity", i).over(by_case()), F.lit("?"))) for i in range(order, 0, -1)]
    return log.withColumn("prefix", F.concat_ws(">", *before))


def top_next(log: DataFrame, order: int = 3) -> DataFrame:
    """For each prefix: the most frequent next label (ties: the one seen first), its share, and the total."""
    pairs = with_prefix(log, order).where("activity is not null").groupBy("prefix", "activity").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = F.max(F.struct("n", (-F.col("first")).alias("early"), "activity"))
    return pairs.groupBy("prefix").agg(best.alias("b"), F.sum("n").alias("support")).select("prefix", F.col("b.activity").alias("next"), F.round(F.col("b.n") / F.col("support"), 6).alias("dominance"), "support")


def causal_counts(log: DataFrame, labels: list[str], order: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each event and label: how often the label followed the event's prefix before. A prefix with many events is summed in blocks."""
    return running_sums(with_prefix(log, order), ["prefix"], "seq", {f"n_{i}": (F.col("activity") == a).cast("int") for i, a in enumerate(labels)}, block_rows)


def repair(log: DataFrame, labels: list[str], order: int = 3, dominance: float = 0.95, support: int = 50) -> DataFrame:
    """Missing labels from what followed the same prefix before; all others abstain.

    Commits where the most frequent label (ties: the first in `labels`) has a share of `dominance` of at least `support`
    earlier cases of the prefix. Rows: seq, case_id, truth, activity, recovered, confidence, provenance.
    """
    t = causal_counts(log, labels, order)
    counts = [F.col(f"n_{i}") for i in range(len(labels))]
    total = sum(counts[1:], counts[0])
    top = F.greatest(*counts) if len(counts) > 1 else counts[0]
    best = F.coalesce(*(F.when(c == top, F.lit(a)) for a, c in zip(labels, counts, strict=True)))
    share = F.when(total > 0, top / total).otherwise(0.0)
    missing, sure = F.col("activity").isNull(), (total >= support) & (share >= dominance)
    return t.select(
        "seq", "case_id", "truth", "activity", F.when(missing & sure, best).when(~missing, F.col("activity")).alias("recovered"),
        F.round(F.when(missing, share).otherwise(1.0), 6).alias("confidence"),
        F.when(~missing, NORMAL).when(sure, BY_SEQUENCE).otherwise(UNRECOVERED).alias("provenance"),
    )


def veto(proposals: DataFrame, cache: DataFrame, dominance: float = 0.9, support: int = 20) -> DataFrame:
    """Proposals (seq, prefix, proposed) with a verdict: abstain where a sure cache entry names another label."""
    hit = proposals.join(cache, "prefix", "left")
    against = F.coalesce((F.col("dominance") >= dominance) & (F.col("support") >= support) & (F.col("next") != F.col("proposed")), F.lit(False))
    return hit.select("seq", "proposed", F.when(against, None).otherwise(F.col("proposed")).alias("kept"), against.cast("int").alias("vetoed"))


def decayed_counts(log: DataFrame, order: int, every: int, factor: float, least: float) -> DataFrame:
    """Counts that lose `factor` at each `every` of seq, masked events included, in closed form: a count of age k epochs weighs factor**k.

    The query's SQL says this; a weight is compared with `least` at the end only. `decayed_by_additions` is the cache's own rule.
    """
    t = with_prefix(log, order).where("activity is not null")
    epoch = F.floor(F.col("seq") / every)
    last = t.agg(F.max(epoch).alias("last"))
    w = F.pow(F.lit(factor), F.col("last") - F.col("epoch"))
    return t.select("prefix", "activity", epoch.alias("epoch")).crossJoin(F.broadcast(last)).groupBy("prefix", "activity").agg(F.round(F.sum(w), 6).alias("weight")).where(F.col("weight") >= least)  # one row


def decayed_by_additions(log: DataFrame, order: int, every: int, factor: float, least: float) -> DataFrame:
    """Counts of the labels after a prefix that lose `factor` after each `every` additions; what a decay leaves under `least` is gone and starts from 0."""
    return decayed(with_prefix(log, order).where("activity is not null"), every, factor, least).drop("touched")


def decayed(additions: DataFrame, every: int, factor: float, least: float) -> DataFrame:
    """(prefix, activity, weight, touched) of additions (seq, prefix, activity) in order of seq, decayed after each `every`; touched: the last seq."""
    keys, parts = ("seq", "prefix", "activity"), int(additions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = additions.select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    t = t.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)).withColumn("_row", F.col("_row").bitwiseAND((1 << 33) - 1))
    sizes = t.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    epoch = F.floor((F.col("_row") + F.col("_before")) / every).alias("epoch")
    added = t.join(F.broadcast(before), "_part").groupBy("prefix", "activity", epoch).agg(F.count("*").alias("n"), F.max("seq").alias("touched"))
    decays = sizes.agg(F.floor(F.sum("_n") / every).alias("decays"))

    def kept(weight, times):
        left = weight * F.pow(F.lit(factor), times)
        return F.when((times > 0) & (left < least), 0.0).otherwise(left)

    start = F.struct(F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("epoch"))
    fold = lambda a, x: F.struct((kept(a["weight"], x["epoch"] - a["epoch"]) + x["n"]).alias("weight"), x["epoch"].alias("epoch"))
    pairs = added.groupBy("prefix", "activity").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("epoch", "n"))), start, fold).alias("a"), F.max("touched").alias("touched"))  # a row for each epoch
    end = pairs.crossJoin(F.broadcast(decays)).select("prefix", "activity", kept(F.col("a.weight"), F.col("decays") - F.col("a.epoch")).alias("weight"), "touched")  # one row
    return end.where(F.col("weight") > 0).withColumn("weight", F.round("weight", 6))


def prefix_entries(repaired: DataFrame, width: int) -> DataFrame:
    """repaired with `entries`: label (given or recovered), provenance and confidence of the `width` events before in the case, oldest first."""
    entry = F.struct(F.col("recovered").alias("label"), "provenance", "confidence")
    return repaired.withColumn("entries", F.collect_list(entry).over(by_case().rowsBetween(-width, -1)))


def contamination(repaired: DataFrame, width: int) -> DataFrame:
    """Share of the `width` events before each repaired event whose label was not given, and how many there were."""
    frame = by_case().rowsBetween(-width, -1)
    bad = F.sum(F.when(F.col("provenance") != NORMAL, 1).otherwise(0)).over(frame)
    n = F.count("*").over(frame)
    return repaired.select("seq", "provenance", n.alias("n_before"), F.round(F.when(n > 0, bad / n).otherwise(0.0), 6).alias("contaminated")).where(F.col("provenance") != NORMAL).drop("provenance")


def balanced_weights(log: DataFrame) -> DataFrame:
    """Class weights N / (C * n_c)."""
    n = log.where("activity is not null").groupBy("activity").agg(F.count("*").alias("n"))
    all_ = Window.partitionBy(F.lit(0))  # a row for each label
    return n.select("activity", "n", F.round(F.sum("n").over(all_) / (F.count("*").over(all_) * F.col("n")), 6).alias("weight"))


