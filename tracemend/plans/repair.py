"""Queries of the decision cascade over the events table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.operators import cascade
from tracemend.operators.cascade import Gates
from tracemend.plans.oracles import LOG, _prefixed
from tracemend.schema import from_events

LABELS, DIMS, WARMUP = ["click", "error", "purchase", "signup", "view"], 4, 300

GATES = Gates(alpha_cluster=0.24, alpha_seq=0.22, margin=0.02, prior_beta=0.3, arbitration=True, agreement="topk", agreement_k=2, override=(0.24, 20), emit=(0.24, 20), mode="plain")

TIERED = Gates(alpha_cluster=0.05, alpha_seq=0.2, agreement="tiered", alpha_seq_high=0.28, override=(0.24, 20), emit=(0.26, 20), mode="margin")


def with_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with z: time of day, minute, weekday and value."""
    t = from_events(spark, sf_dir)
    z = F.array(F.hour("ts") / 24.0, F.minute("ts") / 60.0, F.weekday("ts") / 7.0, F.coalesce("value", F.lit(0.0)) / 100.0)
    return t.select("seq", "case_id", "truth", "activity", z.alias("z"))


def told(t: DataFrame) -> DataFrame:
    return t.withColumn("confidence", F.round("confidence", 4))


def cascade_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole decision for each event: causal clusters with a prior, margin, veto, arbitration, gated rescue, direct emission."""
    return told(cascade.cascade(with_z(spark, sf_dir), LABELS, DIMS, GATES, WARMUP))


def cascade_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the tiered agreement and no arbitration; how often each step decided, and how often rightly."""
    t = cascade.cascade(with_z(spark, sf_dir), LABELS, DIMS, TIERED)
    return t.groupBy("step", "provenance").agg(F.count("*").alias("events"), F.count_if(F.col("recovered") == F.col("truth")).alias("right"))


def retro_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warm-up's events, decided again with what its end knew and lower thresholds."""
    return told(cascade.retro(with_z(spark, sf_dir), LABELS, DIMS, GATES, WARMUP, alpha_cluster=0.22, alpha_seq=0.24))


def _sql(g: Gates, until: int | None = None, warmup: int = 0, alpha_cluster: float | None = None, alpha_seq: float | None = None) -> str:
    """CTEs up to `decided`: seq, case_id, truth, activity, recovered, confidence, provenance, step."""
    k, dims, ac, as_ = len(LABELS), range(1, DIMS + 1), alpha_cluster or g.alpha_cluster, alpha_seq or g.alpha_seq
    over = "OVER w" if until is None else "OVER (PARTITION BY 0)"
    frame = "WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" if until is None else f"WHERE seq < {until}"
    sums = ", ".join(
        f"coalesce(count(*) FILTER (activity = '{a}') {over}, 0) AS n{i}, " + ", ".join(f"coalesce(sum(z{j}) FILTER (activity = '{a}') {over}, 0) AS s{i}_{j}, coalesce(sum(z{j} * z{j}) FILTER (activity = '{a}') {over}, 0) AS q{i}_{j}" for j in dims)
        for i, a in enumerate(LABELS)
    )
    dist = ", ".join(f"CASE WHEN n{i} >= {g.n_min} THEN sqrt(" + " + ".join(f"(z{j} - s{i}_{j} / n{i}) ** 2 / (q{i}_{j} / n{i} - (s{i}_{j} / n{i}) ** 2 + 1e-4)" for j in dims) + f") END AS d{i}" for i in range(k))
    weights = ", ".join(f"coalesce(d{i} ** -2, 0) AS w{i}" for i in range(k))
    # members as a sorted list: the likeliest first, ties by label
    listed = "list_filter([" + ", ".join(f"{{'m': -(w{i} / total), 'l': '{a}', 'n': n{i}, 'd': d{i}}}" for i, a in enumerate(LABELS)) + "], lambda x: x.d IS NOT NULL)"

    def counts(order: int, label: str, share: str, support: str, source: str) -> str:
        over = "OVER p" if until is None else "OVER (PARTITION BY prefix)"
        frame = "WINDOW p AS (PARTITION BY prefix ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" if until is None else ""
        where = "" if until is None else f"WHERE seq < {until}"
        c = ", ".join(f"coalesce(count(*) FILTER (activity = '{a}') {over}, 0) AS c{i}" for i, a in enumerate(LABELS))
        top = "greatest(" + ", ".join(f"c{i}" for i in range(k)) + ")"
        sum_ = " + ".join(f"c{i}" for i in range(k))
        which = "CASE " + " ".join(f"WHEN c{i} = {top} THEN '{a}'" for i, a in enumerate(LABELS)) + " END"
        return f"""{_prefixed(order).replace("prefixed AS", f"prefixed{order} AS")}, counted{order} AS (SELECT seq, {c} FROM prefixed{order} {where} {frame}),
{source} AS (SELECT seq, CASE WHEN {sum_} > 0 THEN {which} END AS {label}, CASE WHEN {sum_} > 0 THEN {top} / ({sum_}) END AS {share}, {sum_} AS {support} FROM counted{order})"""

    factor = "1" if g.prior_beta <= 0 else f"""pow((1.0 / ({" + ".join(f"(n{i} > 0)::INT" for i in range(k))})) / (greatest(CASE best {" ".join(f"WHEN '{a}' THEN n{i}" for i, a in enumerate(LABELS))} END, 1)::DOUBLE / ({" + ".join(f"n{i}" for i in range(k))})), {g.prior_beta})"""
    score = {"plain": "u * rel", "margin": "(u - second) * rel"}[g.mode]
    near = f"(cluster_margin < {g.arbitration_margin} OR cluster_conf < {ac + g.arbitration_margin})"
    veto = "false" if g.override is None or until is not None else f"coalesce(cache_dom >= {g.override[0]} AND cache_sup >= {g.override[1]} AND cache_label <> best, false)"
    emit = "false" if g.emit is None or until is not None else f"coalesce(cache_dom >= {g.emit[0]} AND cache_sup >= {g.emit[1]}, false)"
    yields = f"coalesce(held AND {near} AND seq_conf >= {as_} AND seq_label <> best AND seq_conf > cluster_conf + {g.arbitration_margin}, false)" if g.arbitration else "false"
    agrees = {
        "topk": f"(coalesce(list_contains(tops[1:{g.agreement_k}], seq_label), false) OR coalesce(seq_conf >= {g.agreement_override}, false) OR len(tops) = 0)",
        "tiered": f"(coalesce(seq_label = tops[1], false) OR coalesce(seq_conf >= {g.alpha_seq_high}, false))",
    }[g.agreement]
    clear = f"coalesce(cluster_margin >= {g.margin}, false)" if g.margin > 0 else "true"
    early = f"seq < {warmup} AND activity IS NULL"
    return f"""{LOG}, feats AS (SELECT *, hour(ts) / 24.0::DOUBLE AS z1, minute(ts) / 60.0::DOUBLE AS z2, (isodow(ts) - 1) / 7.0::DOUBLE AS z3, coalesce(value, 0) / 100.0::DOUBLE AS z4 FROM log),
run AS (SELECT seq, case_id, truth, activity, z1, z2, z3, z4, {sums} FROM feats {frame}), dist AS (SELECT *, {dist} FROM run), weighted AS (SELECT *, {weights} FROM dist),
totals AS (SELECT *, {" + ".join(f"w{i}" for i in range(k))} AS total FROM weighted), members AS (SELECT *, list_sort({listed}) AS m FROM totals),
bests AS (SELECT *, m[1].l AS best, coalesce(-m[1].m, 0) AS u, coalesce(-m[2].m, 0) AS second, least(1.0, m[1].n / {g.n_reliable}) AS rel, list_transform(m, lambda x: x.l) AS tops FROM members),
conf AS (SELECT *, u - second AS cluster_margin, least(1.0, coalesce({score}, 0) * coalesce({factor}, 1)) AS cluster_conf FROM bests),
{counts(1, "seq_label", "seq_conf", "seq_sup", "seqs")},
{counts(2, "cache_label", "cache_dom", "cache_sup", "caches")},
joined AS (SELECT * FROM conf JOIN seqs USING (seq) JOIN caches USING (seq)),
g1 AS (SELECT *, coalesce(best IS NOT NULL AND cluster_conf >= {ac}, false) AS sure FROM joined), g2 AS (SELECT *, sure AND {clear} AS clear FROM g1), g3 AS (SELECT *, clear AND NOT {veto} AS held FROM g2),
g4 AS (SELECT *, {yields} AS yields, NOT held AND coalesce(seq_label IS NOT NULL AND seq_conf >= {as_}, false) AND {agrees} AS rescued FROM g3), g5 AS (SELECT *, NOT held AND NOT rescued AND cache_label IS NOT NULL AND {emit} AS emitted FROM g4),
stepped AS (SELECT *, CASE WHEN activity IS NOT NULL THEN 'given' WHEN {early} THEN 'warm-up' WHEN yields THEN 'arbitrated' WHEN held THEN 'cluster' WHEN rescued THEN 'rescued' WHEN emitted THEN 'counted' WHEN clear THEN 'vetoed' WHEN sure THEN 'near tie' ELSE 'unsure' END AS step FROM g5),
decided AS (SELECT seq, case_id, truth, activity, CASE WHEN step = 'given' THEN activity WHEN step IN ('arbitrated', 'rescued') THEN seq_label WHEN step = 'cluster' THEN best WHEN step = 'counted' THEN cache_label END AS recovered,
  round(CASE WHEN step = 'given' THEN 1 WHEN step = 'warm-up' THEN 0 WHEN step IN ('arbitrated', 'rescued') THEN seq_conf WHEN step = 'counted' THEN cache_dom ELSE cluster_conf END, 4) AS confidence,
  CASE WHEN step = 'given' THEN 'NORMAL' WHEN step = 'cluster' THEN 'RECOVERED_ML' WHEN step IN ('arbitrated', 'rescued', 'counted') THEN 'RECOVERED_ML_SEQ' ELSE 'UNRECOVERED_ML' END AS provenance, step FROM stepped)"""


QUERIES = {f.__name__: f for f in (cascade_repair, cascade_tiered, retro_repair)}
ORACLES = {
    "cascade_repair": f"WITH {_sql(GATES, warmup=WARMUP)} SELECT * FROM decided",
    "cascade_tiered": f'WITH {_sql(TIERED)} SELECT step, provenance, count(*) AS events, count(*) FILTER (recovered = truth) AS "right" FROM decided GROUP BY 1, 2',
    "retro_repair": f"WITH {_sql(GATES, until=WARMUP, alpha_cluster=0.22, alpha_seq=0.24)} SELECT * FROM decided",
}
