"""Change detection by adaptive windows, and what follows from it.

Tasks over ranges of (key, order) sum runs of BLOCK rows, the clock of the detector, side by side. One task for each key then reads
only these sums in order, with an exponential histogram whose buckets grow with the logarithm of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemend.operators.running import running_sums


BLOCK = 32  #: rows that are summed before the detector sees them


@dataclass
class AdaptiveWindow:
    """Buckets (rows, sum, sum of squares), oldest first, of runs of blocks; `most` of each level, then two merge."""

    delta: float = 0.002
    most: int = 5
    least: int = 5
    clock: int = 32
    buckets: list[tuple[int, float, float]] = field(default_factory=list)
    levels: list[int] = field(default_factory=list)
    seen: int = 0

    def add(self, x: float) -> bool:
        """Whether the mean changed; the older part is then forgotten."""
        return self.add_block(1, x, x * x)

    def add_block(self, n: int, s: float, q: float) -> bool:
        """As add() for the sums of n rows; the mean is looked at where the rows seen pass a multiple of the clock."""
        self.buckets.append((n, s, q))
        self.levels.append(0)
        due = (self.seen + n) // self.clock > self.seen // self.clock
        self.seen += n
        level, end = 0, len(self.levels)
        while True:
            same = [i for i in range(end) if self.levels[i] == level]
            if len(same) <= self.most:
                break
            i, j = same[0], same[1]
            self.buckets[i : j + 1] = [tuple(a + b for a, b in zip(self.buckets[i], self.buckets[j], strict=True))]
            self.levels[i : j + 1] = [level + 1]
            end, level = i + 1, level + 1
        return due and self.shrink()

    def totals(self) -> tuple[int, float, float]:
        return tuple(map(sum, zip(*self.buckets, strict=True))) if self.buckets else (0, 0.0, 0.0)

    def shrink(self) -> bool:
        changed, again = False, True
        while again:
            again = False
            n, s, q = self.totals()
            if n < 2 * self.least:
                break
            var = max(0.0, q / n - (s / n) ** 2)
            d = math.log(2 * math.log(max(n, 3)) / self.delta)
            n0, s0 = 0, 0.0
            for b in self.buckets[:-1]:
                n0, s0 = n0 + b[0], s0 + b[1]
                n1 = n - n0
                if n0 < self.least or n1 < self.least:
                    continue
                m = 1 / (1 / n0 + 1 / n1)
                if abs(s0 / n0 - (s - s0) / n1) > math.sqrt(2 / m * var * d) + 2 / (3 * m) * d:
                    self.buckets.pop(0)
                    self.levels.pop(0)
                    changed = again = True
                    break
        return changed


def blocks(rows: DataFrame, key: str, order: str, value: str, size: int = BLOCK) -> DataFrame:
    """(key, last, n, s, q): sums of runs of `size` rows of a key in order; the last run of a task's range may be shorter."""
    kept = rows.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("at"), F.col(value).cast("double").alias("v"))
    ranged = kept.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "at").sortWithinPartitions("key", "at", "v")

    def each(batches: Iterator) -> Iterator:
        import pandas as pd

        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            key = pdf["key"].fillna("").to_numpy()
            new = np.append(True, key[1:] != key[:-1])
            nth = np.arange(len(pdf)) - np.maximum.accumulate(np.where(new, np.arange(len(pdf)), 0))
            begin = np.flatnonzero(nth % size == 0)
            rest = pdf.iloc[begin[-1] :]  # it may go on in the next batch
            yield summed(pd, pdf, begin[:-1], begin[-1])
        if rest is not None:
            yield summed(pd, rest.reset_index(drop=True), np.zeros(1, int), len(rest))

    def summed(pd, pdf, begin, end):
        v = pdf["v"].to_numpy()[:end]
        ends = np.append(begin[1:], end)[: len(begin)]
        add = lambda x: np.add.reduceat(x, begin) if len(begin) else np.empty(0)
        return pd.DataFrame({"key": pdf["key"].to_numpy()[begin], "last": pdf["at"].to_numpy()[ends - 1], "n": ends - begin, "s": add(v), "q": add(v * v)})

    return ranged.mapInPandas(each, "key string, last long, n long, s double, q double")


def detect(rows: DataFrame, key: str, order: str, value: str, delta: float = 0.002, block: int = BLOCK) -> DataFrame:
    """(key, order, window, mean) where the mean of a key's values changed, to the block. Null values are skipped."""
    dealt = blocks(rows, key, order, value, block).repartition("key").sortWithinPartitions("key", "last")

    def each(batches: Iterator) -> Iterator:
        import pandas as pd

        now, window = object(), AdaptiveWindow(delta)
        for pdf in batches:
            out = []
            for k, last, n, s, q in zip(pdf["key"], pdf["last"], pdf["n"], pdf["s"], pdf["q"], strict=True):
                if k != now:
                    now, window = k, AdaptiveWindow(delta)
                if window.add_block(n, s, q):
                    total, mean, _ = window.totals()
                    out.append((k, last, total, mean / total))
            yield pd.DataFrame(out, columns=[key, order, "window", "mean"])

    return dealt.mapInPandas(each, f"{key} string, {order} long, window long, mean double")


def severity(kinds: Column) -> Column:
    """By how many kinds of signal fired: none, low, medium, high."""
    return F.when(kinds >= 3, "high").when(kinds == 2, "medium").when(kinds == 1, "low").otherwise("none")


def averaged_severity(embedding: Column, embedding_severity: Column, windows: Column) -> Column:
    """Over two detectors: the mean of the embedding's severity, where it fired, and of 0, 0.3, 0.6, 0.9 for the other's none to high; low under 0.3, medium under 0.6."""
    other = F.when(windows == "high", 0.9).when(windows == "medium", 0.6).when(windows == "low", 0.3).otherwise(0.0)
    mean = F.when(embedding, (embedding_severity + other) / 2).otherwise(other)
    return F.when(mean < 0.3, "low").when(mean < 0.6, "medium").otherwise("high")


def recommendation(drifted: Column, severity: Column, reconstruction: Column) -> Column:
    """What one detector asks for, by severity and whether reconstruction errors are among what fired."""
    own = F.when(severity == "high", "immediate_retraining_recommended").when((severity == "medium") & reconstruction, "schedule_retraining").when(severity == "medium", "increase_monitoring").otherwise("monitor_closely")
    return F.when(drifted, own).otherwise("continue_monitoring")


def combined_recommendation(drifted: Column, severity: Column, methods: Column, reconstruction: Column) -> Column:
    """What several detectors ask for together; methods: how many fired."""
    own = F.when((severity == "high") | (methods >= 3), "immediate_retraining").when((severity == "medium") & reconstruction, "schedule_retraining").when(severity == "low", "increase_monitoring").otherwise("monitor_closely")
    return F.when(drifted, own).otherwise("continue_monitoring")


def after_warmup(rows: DataFrame, order: str, events: int = 4000) -> DataFrame:
    """Detectors of several signals say nothing before `events` events have been seen."""
    return rows.where(F.col(order) >= events)


def embedding_signals(rows: DataFrame, every: int = 100) -> DataFrame:
    """(label, at, norm, variance): for each label and each `every` positions of seq, mean length of its vectors z and variance of their cells."""
    at = F.floor(F.col("seq") / every)
    square = F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v)
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + v)
    t = rows.where("label is not null").select("label", at.alias("at"), square.alias("q"), total.alias("s"), F.size("z").alias("d"))
    mean = F.sum("s") / F.sum("d")
    return t.groupBy("label", "at").agg(F.round(F.avg(F.sqrt("q")), 6).alias("norm"), F.round(F.sum("q") / F.sum("d") - mean * mean, 6).alias("variance"))


def summary(found: DataFrame, order: str, last: int = 5) -> DataFrame:
    """One row: how many drifts of each severity, the last position, the last few positions."""
    recent = F.slice(F.sort_array(F.collect_list(order), asc=False), 1, last)  # a row for each drift
    return found.agg(F.count("*").alias("drifts"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("low", "medium", "high")), F.max(order).alias("last"), recent.alias("recent"))


def combined(signals: dict[str, Column], rule: str = "any") -> Column:
    """Whether drift is declared: any, all, or the majority of the signals."""
    n = sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals.values()), F.lit(0))
    return {"any": n >= 1, "all": n >= len(signals), "majority": n * 2 > len(signals)}[rule]


def retrain(high: Column, medium: Column, kinds: Column, reconstruction: Column, embedding: Column, total: Column) -> Column:
    """Whether the counts of recent drifts call for a new model."""
    return (high >= 1) | (medium >= 2) | (kinds >= 3) | (reconstruction >= 2) | (total >= 4) | (embedding >= 3)


def reaction(post: Column, pre: Column, delta: float = 2.0) -> Column:
    """For a label that drifted: decay its cluster where errors grew by more than delta, else fine-tune only."""
    return F.when(post / F.greatest(pre, F.lit(1e-12)) > delta, "decay_and_tune").otherwise("tune")


def tiers(rows: DataFrame, keep: int = 100, enough: int = 20, delta: float = 2.0) -> DataFrame:
    """Alarms of labels with what follows: (seq, activity, before, after, reaction).

    rows: seq, activity, error, alarm. Of the label's last `keep` errors up to the alarm, before and after are the means of
    the older and the newer half; with fewer than `enough` nothing is done, else the model is tuned, and the label's cluster
    is decayed first where errors grew by more than `delta`. An event's place within its label is counted in blocks, and only
    alarms ask for the places before theirs, so no task holds a label.
    """
    placed = running_sums(rows.select("seq", "activity", F.col("error").cast("double").alias("error"), "alarm"), ["activity"], "seq", {"_place": F.lit(1)})
    asks = placed.where("alarm").select("activity", F.col("seq").alias("_at"), F.col("_place").alias("_to"))
    asks = asks.select("activity", "_at", F.explode(F.sequence(F.greatest(F.col("_to") - (keep - 1), F.lit(0)), "_to")).alias("_place"))
    met = asks.join(placed.select("activity", "_place", "error"), ["activity", "_place"])
    found = met.groupBy("activity", "_at").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "error"))), lambda x: x["error"]).alias("_e"))  # `keep` errors
    t = found.withColumn("_e", F.filter("_e", lambda v: v.isNotNull())).withColumn("_mid", F.floor(F.size("_e") / 2).cast("int"))
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda x, v: x + v), F.size(a))
    t = t.withColumns({"before": mean(F.slice("_e", F.lit(1), F.col("_mid"))), "after": mean(F.slice("_e", F.col("_mid") + 1, F.size("_e") - F.col("_mid")))})
    act = F.when(F.size("_e") < enough, "none").when((F.col("before") > 0) & (F.try_divide("after", "before") > delta), "decay_and_tune").otherwise("tune")
    return t.select(F.col("_at").alias("seq"), "activity", "before", "after", act.alias("reaction"))


def families(rows: DataFrame, metrics: list[str], delta: float = 0.002) -> DataFrame:
    """(activity, metric, seq, window, mean): where a metric's mean changed among the events of a label, and, with a null activity, among all events.

    rows: seq, activity, and a column for each metric. Events without a label count for all only.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("p")
    long = rows.select("seq", "activity", pairs).select("seq", "activity", "p.metric", "p.v")
    key = lambda label: F.to_json(F.struct(F.col("metric").alias("m"), label.alias("a")))
    own = long.where("activity is not null").select("seq", key(F.col("activity")).alias("k"), "v")
    both = own.unionByName(long.select("seq", key(F.lit(None).cast("string")).alias("k"), "v"))
    k = F.from_json("k", "m string, a string")
    return detect(both, "k", "seq", "v", delta).select(k["a"].alias("activity"), k["m"].alias("metric"), "seq", "window", "mean")


def verdicts(alarms: DataFrame, every: int, reconstruction: str) -> DataFrame:
    """(activity, at, kinds, severity, recommendation) of each label, and each stretch of `every` positions, in which some of its metrics changed."""
    t = alarms.groupBy("activity", F.floor(F.col("seq") / every).alias("at")).agg(F.countDistinct("metric").alias("kinds"), F.max(F.col("metric") == reconstruction).alias("_rec"))
    own = severity(F.col("kinds"))
    return t.select("activity", "at", "kinds", own.alias("severity"), recommendation(F.col("kinds") > 0, own, F.col("_rec")).alias("recommendation"))
