"""The repair decision as one plan: clusters, margin, veto, arbitration, rescue, gate, direct emission, provenance.

Scores come as columns; each gate is an expression over them, so a table of events is decided in one projection. The
online state of clusters, prefix counts and class counts is read as running sums of the events before (batch-causal), in
blocks, so no key is one task's work. Events of the warm-up are decided afterwards, with all that the warm-up knew.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemend.operators.prefixes import with_prefix
from tracemend.operators.running import BLOCK_ROWS, running_sums
from tracemend.schema import BY_CLUSTER, BY_SEQUENCE, NORMAL, UNRECOVERED


@dataclass(frozen=True)
class Gates:
    alpha_cluster: float = 0.5  #: confidence from which a cluster's label is taken
    alpha_seq: float = 0.5  #: confidence from which the sequence model's label is taken
    margin: float = 0.0  #: least distance between the two best memberships; 0: not asked for
    prior_beta: float = 0.0  #: power of the correction for frequent labels
    arbitration: bool = False
    arbitration_margin: float = 0.05
    agreement: str = ""  #: "", "argmax", "topk" or "tiered"
    agreement_k: int = 3
    agreement_override: float = 1.01  #: sequence confidence that needs no agreement
    alpha_seq_high: float = 0.7  #: the same, for "tiered"
    override: tuple[float, int] | None = (0.90, 20)  #: dominance and support of a count that vetoes a cluster; None: no counts
    emit: tuple[float, int] | None = (0.95, 50)  #: dominance and support of a count that is emitted by itself
    n_min: int = 20
    n_reliable: int = 50
    strength: float = 1.0
    mode: str = "entropy"


def members(candidates: Column, fuzzifier: float = 2.0) -> Column:
    """(u, label, n) of an array of (label, n, d), the likeliest first, ties by label; a distance of null takes no part."""
    at = lambda c: F.pow(F.greatest(F.least(c["d"], F.lit(1e10)), F.lit(1e-10)), F.lit(-2.0 / (fuzzifier - 1)))
    there = F.filter(candidates, lambda c: c["d"].isNotNull())
    total = F.aggregate(there, F.lit(0.0), lambda a, c: a + at(c))
    got = F.transform(there, lambda c: F.struct((-at(c) / total).alias("minus"), c["label"].alias("label"), c["n"].alias("n")))
    return F.transform(F.array_sort(got), lambda c: F.struct((-c["minus"]).alias("u"), c["label"].alias("label"), c["n"].alias("n")))


def confident(rows: DataFrame, gates: Gates, candidates: str = "candidates") -> DataFrame:
    """rows with best, cluster_conf, cluster_margin, tops (labels, likeliest first), from an array of (label, n, d) each."""
    t = rows.withColumn("_m", members(F.col(candidates)))
    u, second = F.coalesce(F.try_element_at("_m", F.lit(1))["u"], F.lit(0.0)), F.coalesce(F.try_element_at("_m", F.lit(2))["u"], F.lit(0.0))
    n, k = F.try_element_at("_m", F.lit(1))["n"], F.size("_m")
    h = F.aggregate("_m", F.lit(0.0), lambda a, c: a - F.when(c["u"] > 1e-15, c["u"] * F.log(c["u"])).otherwise(0.0))
    hmax = F.when(k > 1, F.log(k.cast("double"))).otherwise(1.0)
    w = F.least(F.lit(1.0), n / gates.n_reliable)
    score = {
        "entropy": u * F.pow(F.greatest(1 - h / hmax, F.lit(0.0)), F.lit(gates.strength)) * w, "margin": (u - second) * w,
        "log_combined": 1 / (1 + F.exp(-(F.log(u) - gates.strength * h + F.log(w)))), "plain": u * w,
    }[gates.mode]
    best = F.try_element_at("_m", F.lit(1))["label"]
    return t.select(*rows.columns, best.alias("best"), F.coalesce(score, F.lit(0.0)).alias("cluster_conf"), (u - second).alias("cluster_margin"), F.transform("_m", lambda c: c["label"]).alias("tops"))


def decide(scored: DataFrame, gates: Gates) -> DataFrame:
    """scored with recovered, confidence, provenance, and `step`, what decided.

    Columns: activity (null: missing), best, cluster_conf, cluster_margin, tops; seq_label, seq_conf; cache_label,
    cache_dom, cache_sup. A null label of a source is no proposal.
    """
    yes, no = F.lit(True), F.lit(False)
    say = lambda c: F.coalesce(c, no)
    best, conf, margin, seq, seq_conf, cache = (F.col(c) for c in ("best", "cluster_conf", "cluster_margin", "seq_label", "seq_conf", "cache_label"))
    near = (margin < gates.arbitration_margin) | (conf < gates.alpha_cluster + gates.arbitration_margin)
    sure = say(best.isNotNull() & (conf >= gates.alpha_cluster))
    clear = sure & (say(margin >= gates.margin) if gates.margin > 0 else yes)
    strong = lambda at: say((F.col("cache_dom") >= at[0]) & (F.col("cache_sup") >= at[1])) if at else no
    held = clear & ~say(strong(gates.override) & (cache != best))
    yields = held & say(near & (seq_conf >= gates.alpha_seq) & (seq != best) & (seq_conf > conf + gates.arbitration_margin)) if gates.arbitration else no
    first = F.try_element_at("tops", F.lit(1))
    agrees = {
        "": yes, "argmax": say(seq == first), "topk": say(F.array_contains(F.slice("tops", 1, gates.agreement_k), seq)), "tiered": say(seq == first) | say(seq_conf >= gates.alpha_seq_high),
    }[gates.agreement]
    if gates.agreement in ("argmax", "topk"):
        agrees = agrees | say(seq_conf >= gates.agreement_override) | (F.size("tops") == 0)
    rescued = ~held & say(seq.isNotNull() & (seq_conf >= gates.alpha_seq)) & agrees
    emitted = ~held & ~rescued & cache.isNotNull() & strong(gates.emit)
    given = F.col("activity").isNotNull()
    step = F.when(given, "given").when(yields, "arbitrated").when(held, "cluster").when(rescued, "rescued").when(emitted, "counted").when(clear, "vetoed").when(sure, "near tie").otherwise("unsure")
    t = scored.withColumn("step", step)
    is_ = lambda *names: F.col("step").isin(*names)
    return t.select(
        *scored.columns, F.when(is_("given"), F.col("activity")).when(is_("arbitrated", "rescued"), seq).when(is_("cluster"), best).when(is_("counted"), cache).alias("recovered"),
        F.when(is_("given"), 1.0).when(is_("arbitrated", "rescued"), seq_conf).when(is_("counted"), F.col("cache_dom")).otherwise(conf).alias("confidence"),
        F.when(is_("given"), NORMAL).when(is_("cluster"), BY_CLUSTER).when(is_("arbitrated", "rescued", "counted"), BY_SEQUENCE).otherwise(UNRECOVERED).alias("provenance"), "step",
    )


# ---- where the scores come from


def top_of(counts: list[Column], labels: list[str]) -> tuple[Column, Column, Column]:
    """The label with the largest count (ties: the first in `labels`), its share, and the total; null without any."""
    total = sum(counts[1:], counts[0])
    top = F.greatest(*counts) if len(counts) > 1 else counts[0]
    label = F.coalesce(*(F.when(c == top, F.lit(a)) for a, c in zip(labels, counts, strict=True)))
    return F.when(total > 0, label), F.when(total > 0, top / total), total


def by_counts(log: DataFrame, labels: list[str], order: int, names: tuple[str, str, str], block_rows: int = BLOCK_ROWS, until: int | None = None) -> DataFrame:
    """log with the label that most often followed the event's prefix: before it, or, with `until`, among all events before that position."""
    hit = {f"_c{i}": F.col("activity").eqNullSafe(a).cast("int") for i, a in enumerate(labels)}
    t = with_prefix(log, order)
    if until is None:
        t = running_sums(t, ["prefix"], "seq", hit, block_rows)
    else:
        known = t.where(F.col("seq") < until).groupBy("prefix").agg(*(F.sum(v).alias(c) for c, v in hit.items()))
        t = t.join(known, "prefix", "left").fillna(0, list(hit))
    got = top_of([F.col(c) for c in hit], labels)
    return t.select(*log.columns, *(c.alias(n) for c, n in zip(got, names, strict=True)))


def by_clusters(log: DataFrame, labels: list[str], dims: int, gates: Gates, epsilon: float = 1e-4, block_rows: int = BLOCK_ROWS, until: int | None = None) -> DataFrame:
    """log (with z, an array of `dims` numbers) with `candidates`: label, n and distance under the diagonal cluster of each label.

    A cluster is made of the labelled events before the event, or, with `until`, of all before that position; clusters of
    fewer than n_min events have a null distance. With prior_beta, `factor` corrects for frequent labels.
    """
    z = [F.get("z", F.lit(j)) for j in range(dims)]
    sums = {}
    for i, a in enumerate(labels):
        own = F.col("activity").eqNullSafe(a)
        sums[f"_n{i}"] = own.cast("int")
        for j in range(dims):
            sums[f"_s{i}_{j}"], sums[f"_q{i}_{j}"] = F.when(own, z[j]).otherwise(0.0), F.when(own, z[j] * z[j]).otherwise(0.0)
    if until is None:
        t = running_sums(log.withColumn("_all", F.lit(0)), ["_all"], "seq", sums, max(1, block_rows // 8), deep=True)  # one key: smaller blocks for more tasks
    else:
        t = log.crossJoin(F.broadcast(log.where(F.col("seq") < until).agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(c) for c, v in sums.items()))))  # one row

    def distance(i: int) -> Column:
        n = F.col(f"_n{i}")
        mean = [F.col(f"_s{i}_{j}") / n for j in range(dims)]
        parts = [F.pow(z[j] - mean[j], 2) / (F.col(f"_q{i}_{j}") / n - mean[j] * mean[j] + epsilon) for j in range(dims)]
        return F.when(n >= gates.n_min, F.sqrt(sum(parts[1:], parts[0])))

    candidates = F.array(*(F.struct(F.lit(a).alias("label"), F.col(f"_n{i}").alias("n"), distance(i).alias("d")) for i, a in enumerate(labels)))
    counts = F.array(*(F.col(f"_n{i}") for i in range(len(labels))))
    return t.select(*log.columns, candidates.alias("candidates"), counts.alias("class_counts"))


def prior_adjusted(rows: DataFrame, labels: list[str], beta: float) -> DataFrame:
    """cluster_conf times ((1/K) / share)**beta, at most 1, with K the labels seen and share that of the best label so far."""
    if beta <= 0:
        return rows
    total = F.aggregate("class_counts", F.lit(0).cast("long"), lambda a, c: a + c)
    seen = F.size(F.filter("class_counts", lambda c: c > 0))
    own = F.get("class_counts", F.array_position(F.array(*map(F.lit, labels)), F.col("best")).cast("int") - 1)
    factor = F.pow((1.0 / F.greatest(seen, F.lit(1))) / (F.greatest(own, F.lit(1)) / total), F.lit(beta))
    return rows.withColumn("cluster_conf", F.when(total > 0, F.least(F.lit(1.0), F.col("cluster_conf") * F.coalesce(factor, F.lit(1.0)))).otherwise(F.col("cluster_conf")))


def scored(log: DataFrame, labels: list[str], dims: int, gates: Gates, block_rows: int = BLOCK_ROWS, until: int | None = None) -> DataFrame:
    """log (seq, case_id, truth, activity, z) with all that decide() asks for: diagonal clusters, counts after one label as the sequence source, counts after two as the cache."""
    t = by_clusters(log, labels, dims, gates, block_rows=block_rows, until=until)
    t = by_counts(t, labels, 1, ("seq_label", "seq_conf", "_"), block_rows, until).drop("_")
    t = by_counts(t, labels, 2, ("cache_label", "cache_dom", "cache_sup"), block_rows, until)
    return prior_adjusted(confident(t, gates), labels, gates.prior_beta)


KEPT = ["seq", "case_id", "truth", "activity", "recovered", "confidence", "provenance", "step"]


def cascade(log: DataFrame, labels: list[str], dims: int, gates: Gates, warmup: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Events decided by what was known before each of them; missing labels of the first `warmup` events stay unrecovered."""
    out = decide(scored(log, labels, dims, gates, block_rows), gates)
    early = (F.col("seq") < warmup) & F.col("activity").isNull()
    none = {"recovered": F.lit(None).cast("string"), "confidence": F.lit(0.0), "provenance": F.lit(UNRECOVERED), "step": F.lit("warm-up")}
    return out.select(*(F.when(early, none[c]).otherwise(F.col(c)).alias(c) if c in none else F.col(c) for c in KEPT))


def retro(log: DataFrame, labels: list[str], dims: int, gates: Gates, warmup: int, alpha_cluster: float | None = None, alpha_seq: float | None = None) -> DataFrame:
    """The warm-up's events decided again by all that was known at its end, with thresholds of their own and without the cache."""
    g = replace(gates, alpha_cluster=gates.alpha_cluster if alpha_cluster is None else alpha_cluster, alpha_seq=gates.alpha_seq if alpha_seq is None else alpha_seq, override=None, emit=None)
    first = log.where(F.col("seq") < warmup)
    return decide(scored(first, labels, dims, g, until=warmup), g).select(*KEPT)
