"""How well masked labels were repaired. repaired: seq, truth, activity (null where masked), recovered, confidence, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemend.schema import BY_CLUSTER, BY_SEQUENCE


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def masked(repaired: DataFrame) -> DataFrame:
    return repaired.where("activity is null and truth is not null")


def right() -> Column:
    return F.col("recovered") == F.col("truth")


def wrong() -> Column:
    return F.col("recovered") != F.col("truth")


def accuracy(repaired: DataFrame) -> DataFrame:
    """One row; a wrong label is a false positive and a false negative, an abstention a false negative."""
    t = masked(repaired).agg(F.count("*").alias("total"), F.count_if(right()).alias("tp"), F.count_if(wrong()).alias("fp"), F.count_if(F.col("recovered").isNull()).alias("abstained"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("total"))
    return t.select(
        "total", "tp", "fp", (F.col("total") - F.col("tp")).alias("fn"), "abstained", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
        F.round(_ratio(2 * p * r, p + r), 6).alias("f1"), F.round(_ratio(F.col("tp") + F.col("fp"), F.col("total")), 6).alias("coverage"), F.round(_ratio(F.col("abstained"), F.col("total")), 6).alias("abstain_rate"),
    )


def by_activity(repaired: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label, true or recovered."""
    m = masked(repaired)
    sides = F.explode(F.array(F.struct(F.col("truth").alias("activity"), F.lit(1).alias("is_true")), F.struct(F.col("recovered").alias("activity"), F.lit(0).alias("is_true"))))
    t = m.select(F.coalesce(right(), F.lit(False)).alias("right"), sides.alias("s")).select("right", "s.*").where("activity is not null")
    t = t.groupBy("activity").agg(F.count_if((F.col("is_true") == 1) & F.col("right")).alias("tp"), F.count_if((F.col("is_true") == 0) & ~F.col("right")).alias("fp"), F.count_if((F.col("is_true") == 1) & ~F.col("right")).alias("fn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return t.select("activity", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(_ratio(2 * p * r, p + r), 6).alias("f1"))


def by_provenance(repaired: DataFrame) -> DataFrame:
    t = masked(repaired).groupBy("provenance").agg(F.count("*").alias("events"), F.count_if(right()).alias("tp"), F.count_if(wrong()).alias("fp"))
    return t.select("provenance", "events", "tp", "fp", F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"))


def calibration(repaired: DataFrame) -> DataFrame:
    """Accuracy of each tenth of confidence, over committed and abstained events."""
    t = masked(repaired).groupBy(F.floor(F.col("confidence") * 10 + 0.5).cast("long").alias("bin")).agg(F.count("*").alias("events"), F.count_if(right()).alias("right"))
    return t.select("bin", "events", F.round(F.col("right") / F.col("events"), 6).alias("accuracy"))


def confidence_quantiles(repaired: DataFrame) -> DataFrame:
    """Recovery rate and the spread of confidence of committed and of abstained events that lack a label."""
    m = repaired.where("activity is null").withColumn("kind", F.when(F.col("provenance").isin(BY_CLUSTER, BY_SEQUENCE), "committed").otherwise("abstained"))
    q = F.percentile("confidence", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    t = m.groupBy("kind").agg(F.count("*").alias("events"), F.avg("confidence").alias("mean"), q.alias("q"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    return t.select("kind", "events", F.round("mean", 6).alias("mean"), *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))), F.round("lo", 6).alias("min"), F.round("hi", 6).alias("max"))


def plausibility(repaired: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether recovered labels follow their predecessor in the graph: valid, invalid, or unknown without one."""
    prev = F.lag("activity").over(Window.partitionBy("case_id").orderBy("seq"))
    t = repaired.withColumn("prev", prev).where("activity is null and recovered is not null")
    known = F.broadcast(edges.select(F.col("src").alias("prev"), F.col("dst").alias("recovered"), F.lit(1).alias("there")))  # a row for each pair of labels
    verdict = F.when(F.col("prev").isNull(), "unknown").when(F.col("there") == 1, "valid").otherwise("invalid")
    return t.join(known, ["prev", "recovered"], "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("events"))


def summary(repaired: DataFrame) -> DataFrame:
    """One row for the whole stream."""
    gone = F.col("activity").isNull()
    return repaired.agg(
        F.count("*").alias("events"), F.count_if(gone).alias("missing"), F.count_if(gone & F.col("recovered").isNotNull()).alias("recovered"), F.count_if(gone & F.col("recovered").isNull()).alias("unrecovered"),
        F.round(F.avg(F.when(gone & F.col("recovered").isNotNull(), F.col("confidence"))), 6).alias("mean_confidence"), F.countDistinct("case_id").alias("cases"),
    )
