"""Queries of the cascade over trained sources, on a log with an order of its own made from the events table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemend.functions import columns as C
from tracemend.operators import autoencoder, cache, drift, trained
from tracemend.operators.cascade import Gates
from tracemend.operators.graphs import Scratch
from tracemend.plans.models import _folder
from tracemend.plans.oracles import LOG
from tracemend.plans.repair import LABELS
from tracemend.schema import from_events

GATES = Gates(alpha_cluster=0.45, alpha_seq=0.75, margin=0.2, prior_beta=0.1, arbitration=True, arbitration_margin=0.1, agreement="topk", agreement_k=2, override=(0.91, 20), emit=(0.93, 20), mode="plain")
RULE = cache.Rule(1000, 2000)
SKIPS, NOISE = 8, 1.5  #: events in a hundred that leave out a label; how far readings stray


def ring_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' cases, times and masks with labels that follow one another in a ring, mostly, and readings x around a place of each label.

    What strays and which labels are left out is a function of event_id.
    """
    t = from_events(spark, sf_dir)
    step = 1 + (F.pmod(F.col("seq") * 7919, F.lit(100)) < SKIPS).cast("int")
    k = F.pmod(F.sum(step).over(Window.partitionBy("case_id").orderBy("seq")), F.lit(len(LABELS)))
    t = t.withColumn("k", k.cast("int")).withColumn("truth", F.element_at(F.array(*map(F.lit, LABELS)), F.col("k") + 1))
    stray = lambda m, p: (F.pmod(F.col("seq") * m, F.lit(p)) / float(p) - 0.5) * NOISE
    turn = F.col("k") * (2 * math.pi / len(LABELS))
    x = F.array(F.cos(turn) + stray(31, 97), F.sin(turn) + stray(57, 101), stray(43, 89) + 0.3 * F.cos(turn), F.hour("ts") / 24.0, F.coalesce("value", F.lit(0.0)) / 100.0)
    return t.select("seq", "case_id", "truth", F.when(F.col("seq") % 10 != 7, F.col("truth")).alias("activity"), x.alias("x"))


def cascade_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event decided over latents, running full covariances, a sequence model and counts, after a warm-up whose models are stored and read again; the warm-up's own missing labels are decided again at its end."""
    scratch = Scratch(spark, "trained")
    log = scratch.keep(ring_log(spark, sf_dir))
    folder = _folder(spark, "models")
    end = trained.warmup_end(log, least=2000, most=6000, enough=len(LABELS))
    trained.save(spark, folder, 0, trained.fit(scratch, log, end, GATES, latent=8, hidden=32, epochs=30))
    models = trained.load(spark, folder, 0)
    online = trained.cascade(scratch, log, models, GATES, RULE).where("step <> 'warm-up'").withColumn("phase", F.lit("online"))
    again = trained.retro(log, models, GATES).withColumn("phase", F.lit("retro"))
    return online.unionByName(again).withColumn("confidence", F.round("confidence", 6))


def causal_full_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each missing label the nearest cluster under the full covariance of the labelled events before it, of time of day and value."""
    t = from_events(spark, sf_dir)
    z = F.array(F.hour("ts") / 24.0, F.coalesce("value", F.lit(0.0)) / 100.0)
    found = trained.running_full(t.select("seq", F.col("activity").alias("label"), z.alias("z"), F.col("activity").isNull().alias("asked")), least=20)
    near = F.array_min(F.transform(F.filter("candidates", lambda c: c["d"].isNotNull()), lambda c: F.struct(C.rounded(c["d"], 6).alias("d"), c["label"].alias("label"), c["n"].alias("n"))))
    return found.select("seq", near["label"].alias("label"), near["n"].alias("n"), C.rounded(near["d"], 4).alias("d"))


METRICS = ["error", "norm", "variance"]


def coded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring's events as a coder of the first fifth sees them: reconstruction error, length and variance of the latents. In the last third the readings of one label move."""
    scratch = Scratch(spark, "coded")
    log = scratch.keep(ring_log(spark, sf_dir))
    lo, hi = log.agg(F.min("seq"), F.max("seq")).first()
    moved = (F.col("seq") > hi - (hi - lo) / 3) & (F.col("truth") == LABELS[-1])
    log = log.withColumn("x", F.when(moved, F.transform("x", lambda v: v + 1.5)).otherwise(F.col("x")))
    model = autoencoder.train(log.where(F.col("seq") < lo + (hi - lo) / 5).select("x"), latent=8, hidden=32, epochs=20)
    z = autoencoder.encode(log.select("seq", "activity", "x"), model)
    add = lambda f: F.aggregate("z", F.lit(0.0), lambda a, v: a + f(v))
    square, mean = add(lambda v: v * v), add(lambda v: v) / F.size("z")
    return scratch.keep(z.select("seq", "activity", "error", F.sqrt(square).alias("norm"), (square / F.size("z") - mean * mean).alias("variance")))


def drift_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 500 events in which metrics of a label, or of all events (null), changed, with severity and recommendation."""
    return drift.verdicts(drift.families(coded_log(spark, sf_dir), METRICS), 500, "error")


def drift_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each change of a label's reconstruction errors: its older and newer errors, and whether its cluster decays before the model is tuned; changes over all events where no label changed in the same block tune and reset."""
    t = coded_log(spark, sf_dir)
    alarms = Scratch(spark, "alarms").keep(drift.families(t, ["error"]).select("seq", "activity"))
    own = alarms.where("activity is not null").withColumn("alarm", F.lit(True)).distinct()
    known = t.where("activity is not null").select("seq", "activity", "error").join(own, ["seq", "activity"], "left").withColumn("alarm", F.coalesce("alarm", F.lit(False)))
    stretch = F.floor(F.col("seq") / drift.BLOCK)
    alone = alarms.where("activity is null").join(own.select(stretch.alias("s")).distinct(), stretch == F.col("s"), "left_anti")
    overall = alone.select("seq", F.lit(None).cast("string").alias("activity"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after"), F.lit("tune_and_reset").alias("reaction"))
    return drift.tiers(known).unionByName(overall)


QUERIES = {f.__name__: f for f in (cascade_trained, causal_full_mahalanobis, drift_alarms, drift_reactions)}

_SUMS = ", ".join(
    f"coalesce(count(*) FILTER (activity = '{a}') OVER w, 0) AS n{i}, " + ", ".join(f"coalesce(sum({v}) FILTER (activity = '{a}') OVER w, 0) AS {n}{i}" for n, v in {"sx": "x", "sy": "y", "qxx": "x * x", "qxy": "x * y", "qyy": "y * y"}.items())
    for i, a in enumerate(LABELS)
)


def _distance(i: int, label: str) -> str:
    a, b, c = f"(qxx{i} / n{i} - (sx{i} / n{i}) ** 2 + 1e-4)", f"(qxy{i} / n{i} - sx{i} / n{i} * sy{i} / n{i})", f"(qyy{i} / n{i} - (sy{i} / n{i}) ** 2 + 1e-4)"
    dx, dy = f"(x - sx{i} / n{i})", f"(y - sy{i} / n{i})"
    return f"CASE WHEN n{i} >= 20 THEN {{'d': round(sqrt(({c} * {dx} ** 2 - 2 * {b} * {dx} * {dy} + {a} * {dy} ** 2) / ({a} * {c} - {b} ** 2)), 6), 'label': '{label}', 'n': n{i}}} END"


ORACLES = {
    "causal_full_mahalanobis": f"""WITH {LOG}, p AS (SELECT seq, activity, hour(ts) / 24.0::DOUBLE AS x, coalesce(value, 0) / 100.0::DOUBLE AS y FROM log), run AS (SELECT *, {_SUMS} FROM p WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
near AS (SELECT seq, list_sort(list_filter([{", ".join(_distance(i, a) for i, a in enumerate(LABELS))}], lambda x: x IS NOT NULL))[1] AS m FROM run WHERE activity IS NULL) SELECT seq, m.label AS label, m.n AS n, round(m.d, 4) AS d FROM near""",
}
