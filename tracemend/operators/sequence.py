"""Next labels from prefixes by a trained classifier, with a class-balanced training sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemend.operators.features import FIRST_ID, prefix_ids, vocabulary


def examples(log: DataFrame, width: int) -> DataFrame:
    """seq, features (one-hot ids of the last `width` events), label (0-based id, null where missing)."""
    from pyspark.ml.functions import array_to_vector

    vocab = vocabulary(log)
    k = vocab.count() + FIRST_ID  # a row for each label
    hot = F.flatten(F.transform("prefix", lambda p: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == p).cast("double"))))
    ids = log.select("seq", "activity").join(F.broadcast(vocab.select("activity", "label_id")), "activity", "left").select("seq", (F.col("label_id") - FIRST_ID).cast("double").alias("label"))
    return prefix_ids(log, width).join(ids, "seq").select("seq", array_to_vector(hot).alias("features"), "label")


def balanced(rows: DataFrame, per_class: int) -> DataFrame:
    """At most `per_class` labelled examples of each class, by a hash of seq: a bounded replay sample."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("seq")))
    return rows.where("label is not null").withColumn("_rank", rank).where(F.col("_rank") <= per_class).drop("_rank")


def train(rows: DataFrame, classes: int, hidden: int = 32, per_class: int = 500, seed: int = 1):
    """A multilayer perceptron on a balanced sample."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    sample = balanced(rows, per_class)
    size = sample.select("features").first()[0].size
    return MultilayerPerceptronClassifier(layers=[size, hidden, classes], maxIter=60, seed=seed).fit(sample)


def rescue(rows: DataFrame, model, threshold: float) -> DataFrame:
    """Unlabelled examples with the likeliest class, its probability, and whether it passes the threshold."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    t = model.transform(rows.where("label is null")).select("seq", F.col("prediction").cast("int").alias("class"), F.array_max(p).alias("confidence"))
    return t.withColumn("committed", F.col("confidence") >= threshold)
