"""The same queries as SQL for an independent engine."""

from __future__ import annotations

LOG = """log AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS case_id, nullif(trim(event_type), '') AS truth,
    CASE WHEN event_id % 10 <> 7 THEN nullif(trim(event_type), '') END AS activity, ts, value, props FROM events
)"""
EDGES = f"""{LOG}, pairs AS (SELECT seq, case_id, lag(activity) OVER (PARTITION BY case_id ORDER BY seq) AS prev, activity FROM log),
edges AS (SELECT prev AS src, activity AS dst, count(*) AS weight FROM pairs WHERE prev IS NOT NULL AND activity IS NOT NULL GROUP BY 1, 2)"""


def _entropy(by: str) -> str:
    return f"""WITH {EDGES}, t AS (SELECT *, sum(weight) OVER (PARTITION BY {by}) AS total FROM edges)
SELECT {by} AS activity, CAST(max(total) AS BIGINT) AS total, round(-sum(weight / total * ln(weight / total)), 6) AS entropy FROM t GROUP BY 1"""


def _pairs(balance: float) -> str:
    return f"""paired AS (
  SELECT e.src AS a, e.dst AS b, least(e.weight, r.weight) AS low, greatest(e.weight, r.weight) AS high FROM edges e JOIN edges r ON e.src = r.dst AND e.dst = r.src
  WHERE e.src < e.dst AND least(e.weight, r.weight) >= 5 AND least(e.weight, r.weight) / greatest(e.weight, r.weight) >= {balance}
)"""


def _prefixed(order: int) -> str:
    lags = ", ".join(f"CASE WHEN lag(seq, {i}) OVER w IS NULL THEN '' ELSE coalesce(lag(activity, {i}) OVER w, '?') END" for i in range(order, 0, -1))
    return f"prefixed AS (SELECT *, concat_ws('>', {lags}) AS prefix FROM log WINDOW w AS (PARTITION BY case_id ORDER BY seq))"


_LABELS = ["click", "error", "purchase", "signup", "view"]
REPAIRED = f"""{LOG}, {_prefixed(2)}, counted AS (
  SELECT *, {", ".join(f"coalesce(sum(CASE WHEN activity = '{a}' THEN 1 ELSE 0 END) OVER w, 0) AS n{i}" for i, a in enumerate(_LABELS))}
  FROM prefixed WINDOW w AS (PARTITION BY prefix ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), topped AS (SELECT *, n0 + n1 + n2 + n3 + n4 AS total, greatest(n0, n1, n2, n3, n4) AS top FROM counted),
shared AS (SELECT *, CASE WHEN total > 0 THEN top / total ELSE 0 END AS share, CASE {" ".join(f"WHEN n{i} = top THEN '{a}'" for i, a in enumerate(_LABELS))} END AS best FROM topped),
repaired AS (
  SELECT seq, case_id, truth, activity, CASE WHEN activity IS NOT NULL THEN activity WHEN total >= 5 AND share >= 0.25 THEN best END AS recovered,
    round(CASE WHEN activity IS NULL THEN share ELSE 1 END, 6) AS confidence,
    CASE WHEN activity IS NOT NULL THEN 'NORMAL' WHEN total >= 5 AND share >= 0.25 THEN 'RECOVERED_ML_SEQ' ELSE 'UNRECOVERED_ML' END AS provenance FROM shared
)"""
MASKED = f"{REPAIRED}, masked AS (SELECT * FROM repaired WHERE activity IS NULL AND truth IS NOT NULL)"


def _ppmi(source: str) -> str:
    lags = " UNION ALL ".join(f"SELECT lag(activity, {i}) OVER (PARTITION BY case_id ORDER BY seq) AS a, activity AS b FROM src" for i in (1, 2, 3))
    return f"""WITH {source}, near AS ({lags}), one AS (SELECT a, b FROM near WHERE a IS NOT NULL AND b IS NOT NULL),
counts AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM one UNION ALL SELECT b, a FROM one) GROUP BY 1, 2)
SELECT a, b, n, round(greatest(ln(n * (sum(n) OVER ()) / ((sum(n) OVER (PARTITION BY a)) * (sum(n) OVER (PARTITION BY b)))), 0), 6) AS ppmi FROM counts"""


STATS = """long AS (SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
stats AS (SELECT label, i, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM long GROUP BY 1, 2)"""
SCORED = f"""{STATS}, dist AS (
  SELECT vec_id, c.label, c.n, sqrt(sum((v - s / n) ** 2 / (q / n - (s / n) ** 2 + 1e-4))) AS d FROM long p JOIN stats c ON p.i = c.i WHERE c.n >= 2 GROUP BY 1, 2, 3
), members AS (SELECT *, d ** -2 / sum(d ** -2) OVER (PARTITION BY vec_id) AS u FROM dist),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY u DESC, label) AS rank, count(*) OVER (PARTITION BY vec_id) AS k, -sum(u * ln(u)) OVER (PARTITION BY vec_id) AS h FROM members),
best AS (
  SELECT a.vec_id, a.label, a.n, a.u, coalesce(b.u, 0) AS second, a.h, CASE WHEN a.k > 1 THEN ln(a.k) ELSE 1 END AS hmax, least(1.0, a.n / 50) AS w
  FROM ranked a LEFT JOIN ranked b ON a.vec_id = b.vec_id AND b.rank = 2 WHERE a.rank = 1
)"""

ORACLES: dict[str, str] = {
    "log_stats": f"""WITH {LOG} SELECT count(*) AS events, count(activity) AS labelled, round(1 - count(activity) / count(*), 6) AS missing_rate, count(DISTINCT case_id) AS cases,
count(DISTINCT activity) AS activities, round(count(*) / count(DISTINCT case_id), 6) AS events_per_case, round(count(value) / count(*), 6) AS sensor_rate FROM log""",
    "activity_counts": f"WITH {LOG} SELECT activity, count(*) AS n FROM log WHERE activity IS NOT NULL GROUP BY 1",
    "case_activity_counts": f"WITH {LOG} SELECT case_id, activity, count(*) AS n FROM log WHERE activity IS NOT NULL GROUP BY 1, 2",
    "dfg_edges": f"WITH {EDGES} SELECT * FROM edges",
    "dfg_edges_conversations": """WITH pairs AS (SELECT lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, role FROM conversations)
SELECT prev AS src, role AS dst, count(*) AS weight FROM pairs WHERE prev IS NOT NULL AND role IS NOT NULL GROUP BY 1, 2""",
    "dfg_outgoing_entropy": _entropy("src"),
    "dfg_incoming_entropy": _entropy("dst"),
    "dfg_parallel_pairs": f"WITH {EDGES}, {_pairs(0.3)} SELECT * FROM paired",
    "dfg_parallel_features": f"""WITH {EDGES}, {_pairs(0.95)}, twoway AS (SELECT a, b FROM paired UNION ALL SELECT b, a FROM paired)
SELECT src AS activity, CAST(count(b) > 0 AS INTEGER) AS is_parallel, count(b) AS siblings, round(sum(CASE WHEN b IS NOT NULL THEN weight ELSE 0 END) / sum(weight), 6) AS sibling_share
FROM edges LEFT JOIN twoway ON src = a AND dst = b GROUP BY 1""",
    "global_running_outgoing": f"""WITH {EDGES} SELECT seq, prev, activity,
count(*) OVER (PARTITION BY prev ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS out_before,
count(*) OVER (PARTITION BY prev, activity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge_before
FROM pairs WHERE prev IS NOT NULL AND activity IS NOT NULL""",
    "prev_k_activities": f"WITH {LOG} SELECT seq, {', '.join(f"coalesce(lag(activity, {i}) OVER w, '') AS prev_{i}" for i in range(1, 5))} FROM log WINDOW w AS (PARTITION BY case_id ORDER BY seq)",
    "prefix_ids_padded": f"""WITH {LOG}, vocab AS (SELECT activity, row_number() OVER (ORDER BY min(seq)) + 1 AS id FROM log WHERE activity IS NOT NULL GROUP BY 1),
t AS (SELECT seq, case_id, coalesce(id, 1) AS id FROM log LEFT JOIN vocab USING (activity))
SELECT seq, {" || ',' || ".join(f"CAST(coalesce(lag(id, {i}) OVER w, 0) AS VARCHAR)" for i in range(5, 0, -1))} AS prefix FROM t WINDOW w AS (PARTITION BY case_id ORDER BY seq)""",
    "hours_since_prev_capped": f"""WITH {LOG} SELECT seq, round(coalesce(least((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY case_id ORDER BY seq)) / 1e6 / 3600, 24), 0), 6) AS hours FROM log""",
    "occurrence_so_far": f"""WITH {LOG}, t AS (SELECT *, CASE WHEN activity IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY case_id, activity ORDER BY seq) END AS k FROM log)
SELECT seq, greatest(k - 1, 0) AS current_before, coalesce(lag(k) OVER (PARTITION BY case_id ORDER BY seq), 0) AS prev_before FROM t""",
    "self_loop_flag": f"""WITH {LOG} SELECT seq, CAST(coalesce(lag(activity, 1) OVER w = lag(activity, 2) OVER w, false) AS INTEGER) AS prev_loop,
CAST(coalesce(lag(activity, 1) OVER w = activity, false) AS INTEGER) AS current_loop FROM log WINDOW w AS (PARTITION BY case_id ORDER BY seq)""",
    "case_age_features": f"""WITH {LOG}, t AS (SELECT *, CASE WHEN activity IS NOT NULL AND row_number() OVER (PARTITION BY case_id, activity ORDER BY seq) = 1 THEN 1 ELSE 0 END AS new FROM log),
r AS (SELECT seq, count(*) OVER w AS n, sum(new) OVER w AS d, (epoch_us(ts) - min(epoch_us(ts)) OVER w) / 1e6 / 3600 AS age FROM t WINDOW w AS (PARTITION BY case_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT seq, round(ln(1 + n), 6) AS log_total, round(ln(1 + d), 6) AS log_distinct, round(least(n / greatest(d, 1), 10), 6) AS repetition, round(ln(1 + age), 6) AS log_age FROM r""",
    "sensor_window_stats": f"""WITH {LOG}, t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS i FROM log)
SELECT seq, 'value' AS sensor, round(value, 6) AS value, round(avg(value) OVER f, 6) AS mean, round(stddev_pop(value) OVER f, 4) AS deviation,
CASE WHEN count(*) OVER f >= 2 THEN round(regr_slope(value, i) OVER f, 4) + 0.0 ELSE 0 END AS slope, round(coalesce(value - lag(value) OVER w, 0), 4) AS step
FROM t WINDOW w AS (PARTITION BY case_id ORDER BY seq), f AS (PARTITION BY case_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "md5_hash_features": f"""WITH {LOG}, h AS (SELECT seq, list_transform(range(0, 16), lambda i: CAST('0x' || substr(md5(json_extract_string(props, '$.k')), CAST(i * 2 + 1 AS BIGINT), 2) AS INTEGER) / 255.0 * 2 - 1) AS v FROM log)
SELECT seq, round(CAST(v[1] AS DOUBLE), 6) AS h0, round(CAST(v[2] AS DOUBLE), 6) AS h1, round(CAST(v[16] AS DOUBLE), 6) AS h15, round(CAST(list_sum(v) AS DOUBLE), 6) AS total FROM h""",
    "time_of_day_features": f"WITH {LOG} SELECT seq, round(hour(ts) / 24, 6) AS hour_part, round(minute(ts) / 60, 6) AS minute_part, round((isodow(ts) - 1) / 7, 6) AS weekday_part FROM log",
    "lifecycle_onehot_capped": f"""WITH {LOG}, slots AS (SELECT activity, CAST(row_number() OVER (ORDER BY min(seq)) - 1 AS INTEGER) AS slot FROM log WHERE activity IS NOT NULL GROUP BY 1 QUALIFY slot < 3)
SELECT seq, slot FROM log LEFT JOIN slots USING (activity)""",
    "standardise_value": f"""WITH {LOG}, m AS (SELECT avg(value) AS mean, greatest(stddev_pop(value), 1e-8) AS deviation FROM log WHERE activity IS NOT NULL) SELECT seq, round((value - mean) / deviation, 4) AS z FROM log, m""",
    "welford_running_standardise": f"""WITH {LOG}, r AS (SELECT seq, value, count(value) OVER w AS n, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS dev FROM log WINDOW w AS (PARTITION BY case_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT seq, round(CASE WHEN n < 2 OR dev < 1e-8 THEN 0 ELSE (value - mean) / dev END, 4) AS z FROM r""",
    "warmup_end_position": f"""WITH {LOG}, t AS (SELECT seq + 1 AS n, activity FROM log), f AS (SELECT activity, min(n) AS first FROM t WHERE activity IS NOT NULL AND n >= 200 GROUP BY 1),
states AS (SELECT t.n, (SELECT count(*) FROM f WHERE first <= t.n) AS k, (SELECT max(first) FROM f WHERE first <= t.n) AS newest FROM t WHERE t.n BETWEEN 500 AND 1000)
SELECT coalesce(min(n), 1000) AS warmup_end FROM states WHERE n >= 1000 OR k >= 20 OR (k >= 5 AND n - newest >= 500)""",
    "inject_hash_mask": f"""WITH {LOG}, known AS (SELECT seq, truth, CAST('0x' || substr(md5(seq || ':42'), 1, 8) AS BIGINT) AS u FROM log WHERE truth IS NOT NULL)
SELECT seq, truth FROM (SELECT *, row_number() OVER (ORDER BY u, seq) AS r, count(*) OVER () AS n FROM known) WHERE r <= floor(n * 0.1)""",
    "inject_burst": f"WITH {LOG}, r AS (SELECT seq, truth, row_number() OVER (PARTITION BY case_id ORDER BY seq) - 1 AS k FROM log WHERE truth IS NOT NULL) SELECT seq, truth FROM r WHERE k % 20 < 3",
    "inject_activity_specific": f"WITH {LOG} SELECT seq, truth FROM log WHERE truth IN ('error', 'signup') AND CAST('0x' || substr(md5(seq || ':42'), 1, 8) AS BIGINT) / 4294967296 < 0.5",
    "count_cache_top": f"""WITH {LOG}, {_prefixed(2)}, pairs AS (SELECT prefix, activity, count(*) AS n, min(seq) AS first FROM prefixed WHERE activity IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, first) AS rank, sum(n) OVER (PARTITION BY prefix) AS support FROM pairs)
SELECT prefix, activity AS next, round(n / support, 6) AS dominance, CAST(support AS BIGINT) AS support FROM r WHERE rank = 1""",
    "count_cache_decayed": f"""WITH {LOG}, {_prefixed(1)}, t AS (SELECT prefix, activity, seq // 1000 AS epoch FROM prefixed WHERE activity IS NOT NULL)
SELECT prefix, activity, round(sum(pow(0.9, last - epoch)), 6) AS weight FROM t, (SELECT max(epoch) AS last FROM t) GROUP BY 1, 2 HAVING sum(pow(0.9, last - epoch)) >= 0.1""",
    "count_cache_causal_repair": f"WITH {REPAIRED} SELECT * FROM repaired",
    "count_cache_veto": f"""WITH {LOG}, {_prefixed(1)}, pairs AS (SELECT prefix, activity, count(*) AS n, min(seq) AS first FROM prefixed WHERE activity IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, first) AS rank, sum(n) OVER (PARTITION BY prefix) AS support FROM pairs), cache AS (SELECT * FROM r WHERE rank = 1),
hit AS (SELECT p.seq, coalesce(c.n / c.support >= 0.2 AND c.support >= 20 AND c.activity <> 'click', false) AS against FROM prefixed p LEFT JOIN cache c USING (prefix) WHERE p.activity IS NULL)
SELECT seq, 'click' AS proposed, CASE WHEN against THEN NULL ELSE 'click' END AS kept, CAST(against AS INTEGER) AS vetoed FROM hit""",
    "class_weights": f"""WITH {LOG}, n AS (SELECT activity, count(*) AS n FROM log WHERE activity IS NOT NULL GROUP BY 1)
SELECT activity, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM n""",
    "prefix_contamination": f"""WITH {REPAIRED}, c AS (SELECT seq, provenance, count(*) OVER w AS n_before, sum(CASE WHEN provenance <> 'NORMAL' THEN 1 ELSE 0 END) OVER w AS bad FROM repaired WINDOW w AS (PARTITION BY case_id ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT seq, n_before, round(CASE WHEN n_before > 0 THEN bad / n_before ELSE 0 END, 6) AS contaminated FROM c WHERE provenance <> 'NORMAL'""",
    "accuracy_metrics": f"""WITH {MASKED}, t AS (SELECT count(*) AS total, count(*) FILTER (recovered = truth) AS tp, count(*) FILTER (recovered <> truth) AS fp, count(*) FILTER (recovered IS NULL) AS abstained FROM masked),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(total, 0), 0) AS q FROM t)
SELECT total, tp, fp, total - tp AS fn, abstained, round(p, 6) AS "precision", round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1,
round(coalesce((tp + fp) / nullif(total, 0), 0), 6) AS coverage, round(coalesce(abstained / nullif(total, 0), 0), 6) AS abstain_rate FROM r""",
    "per_activity_prf": f"""WITH {MASKED}, sides AS (SELECT truth AS activity, coalesce(recovered = truth, false) AS ok, true AS is_true FROM masked UNION ALL SELECT recovered, coalesce(recovered = truth, false), false FROM masked WHERE recovered IS NOT NULL),
t AS (SELECT activity, count(*) FILTER (is_true AND ok) AS tp, count(*) FILTER (NOT is_true AND NOT ok) AS fp, count(*) FILTER (is_true AND NOT ok) AS fn FROM sides GROUP BY 1),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q FROM t)
SELECT activity, tp, fp, fn, round(p, 6) AS "precision", round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1 FROM r""",
    "per_provenance": f"""WITH {MASKED}, t AS (SELECT provenance, count(*) AS events, count(*) FILTER (recovered = truth) AS tp, count(*) FILTER (recovered <> truth) AS fp FROM masked GROUP BY 1)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision" FROM t""",
    "calibration_bins": f"""WITH {MASKED} SELECT CAST(floor(confidence * 10 + 0.5) AS BIGINT) AS bin, count(*) AS events, round(count(*) FILTER (recovered = truth) / count(*), 6) AS accuracy FROM masked GROUP BY 1""",
    "natural_missing_quantiles": f"""WITH {REPAIRED}, m AS (SELECT confidence, CASE WHEN provenance IN ('RECOVERED_ML', 'RECOVERED_ML_SEQ') THEN 'committed' ELSE 'abstained' END AS kind FROM repaired WHERE activity IS NULL)
SELECT kind, count(*) AS events, round(avg(confidence), 6) AS mean, round(quantile_cont(confidence, 0.25), 6) AS q1, round(quantile_cont(confidence, 0.5), 6) AS median, round(quantile_cont(confidence, 0.75), 6) AS q3, round(min(confidence), 6) AS min, round(max(confidence), 6) AS max FROM m GROUP BY 1""",
    "dfg_plausibility": f"""WITH {REPAIRED}, {EDGES[len(LOG) + 2 :]}, t AS (SELECT *, lag(activity) OVER (PARTITION BY case_id ORDER BY seq) AS prev FROM repaired)
SELECT CASE WHEN prev IS NULL THEN 'unknown' WHEN src IS NOT NULL THEN 'valid' ELSE 'invalid' END AS verdict, count(*) AS events FROM t LEFT JOIN edges ON prev = src AND recovered = dst WHERE activity IS NULL AND recovered IS NOT NULL GROUP BY 1""",
    "stream_summary": f"""WITH {REPAIRED} SELECT count(*) AS events, count(*) FILTER (activity IS NULL) AS missing, count(*) FILTER (activity IS NULL AND recovered IS NOT NULL) AS recovered, count(*) FILTER (activity IS NULL AND recovered IS NULL) AS unrecovered,
round(avg(confidence) FILTER (activity IS NULL AND recovered IS NOT NULL), 6) AS mean_confidence, count(DISTINCT case_id) AS cases FROM repaired""",
    "bfr_sufficient_stats": f"WITH {STATS} SELECT label, CAST(i AS INTEGER) AS i, n, round(s, 4) AS s, round(q, 4) AS q FROM stats",
    "bfr_centroids": f"WITH {STATS} SELECT label, CAST(i AS INTEGER) AS i, round(s / n, 5) AS centroid FROM stats",
    "bfr_merge_decay": f"WITH {STATS} SELECT label, CAST(i AS INTEGER) AS i, round(n * f, 2) AS n, round(s * f, 4) AS s FROM (SELECT *, CASE WHEN label = 3 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS f FROM stats)",
    "bfr_covariance_cells": f"""WITH {STATS} SELECT a.label, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(avg(a.v * b.v) - avg(a.v) * avg(b.v), 6) AS covariance FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.i <= b.i WHERE a.i < 8 AND b.i < 8 GROUP BY 1, 2, 3""",
    "bfr_diag_mahalanobis": f"WITH {SCORED} SELECT vec_id, label, round(d, 3) AS d FROM dist",
    "fuzzy_membership": f"WITH {SCORED} SELECT vec_id, label, round(u, 4) AS u FROM members",
    "composite_confidence": f"""WITH {SCORED} SELECT vec_id, 'entropy' AS mode, label, round(u * greatest(1 - h / hmax, 0) * w, 4) AS confidence FROM best UNION ALL SELECT vec_id, 'margin', label, round((u - second) * w, 4) FROM best
UNION ALL SELECT vec_id, 'log_combined', label, round(1 / (1 + exp(-(ln(u) - h + ln(w)))), 4) FROM best UNION ALL SELECT vec_id, 'plain', label, round(u * w, 4) FROM best""",
    "cluster_pair_distance": f"""WITH {STATS}, t AS (SELECT label, i, s / n AS m, q / n - (s / n) ** 2 + 1e-4 AS v FROM stats)
SELECT a.label AS a, b.label AS b, round((sqrt(sum((a.m - b.m) ** 2 / a.v)) + sqrt(sum((a.m - b.m) ** 2 / b.v))) / 2, 4) AS distance FROM t a JOIN t b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""",
    "alpha_lambda_grid": f"""WITH {SCORED}, t AS (SELECT b.*, b.label = e.label AS correct FROM best b JOIN embeddings e USING (vec_id)), g AS (SELECT * FROM (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) a(alpha), (VALUES (0::DOUBLE), (0.5::DOUBLE)) s(strength)),
c AS (SELECT alpha, strength, u * pow(greatest(1 - h / hmax, 0), strength) * w >= alpha AS sure, correct FROM t, g), r AS (SELECT alpha, strength, count(*) FILTER (sure AND correct) AS tp, count(*) FILTER (sure AND NOT correct) AS fp, count(*) AS n FROM c GROUP BY 1, 2),
x AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, tp / n AS q FROM r) SELECT alpha, strength, tp, fp, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1 FROM x""",
    "class_prior_adjust": f"""WITH {SCORED}, n AS (SELECT label, count(*) AS c FROM embeddings GROUP BY 1), s AS (SELECT label, pow((1 / count(*) OVER ()) / (c / sum(c) OVER ()), 0.5) AS f FROM n)
SELECT vec_id, label, round(least(u * w * f, 1), 4) AS adjusted FROM best JOIN s USING (label)""",
    "margin_abstain": f"WITH {SCORED} SELECT vec_id, CASE WHEN round(u - second, 4) >= 0.01 THEN label END AS label, round(u - second, 4) AS margin FROM best",
    "agreement_topk": f"WITH {SCORED} SELECT e.vec_id, e.label, CAST(r.label IS NOT NULL AS INTEGER) AS agrees FROM embeddings e LEFT JOIN ranked r ON e.vec_id = r.vec_id AND e.label = r.label AND r.rank <= 3",
    "ppmi_matrix": _ppmi(f"{LOG}, src AS (SELECT * FROM log)"),
    "ppmi_conversations": _ppmi("src AS (SELECT conv_id AS case_id, turn AS seq, role AS activity FROM conversations)"),
    "asof_snapshot_24h": f"""WITH {LOG}, l AS (SELECT * FROM log WHERE truth = 'purchase'), r AS (SELECT case_id, ts, value FROM log WHERE truth = 'error' AND value IS NOT NULL)
SELECT l.seq, round(CASE WHEN l.ts - r.ts <= INTERVAL 24 HOUR THEN r.value END, 6) AS last_value FROM l ASOF LEFT JOIN r ON l.case_id = r.case_id AND l.ts >= r.ts""",
    "trailing_minmax_4h": f"""WITH {LOG} SELECT seq, round(min(value) OVER w, 6) AS low, round(max(value) OVER w, 6) AS high, count(value) OVER w AS n FROM log
WINDOW w AS (PARTITION BY case_id ORDER BY ts RANGE BETWEEN INTERVAL 4 HOUR PRECEDING AND CURRENT ROW)""",
    "two_latest_delta": f"""WITH {LOG}, r AS (SELECT case_id, value, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC) AS k FROM log WHERE value IS NOT NULL)
SELECT case_id, round(max(value) FILTER (k = 1), 6) AS latest, round(max(value) FILTER (k = 1) - max(value) FILTER (k = 2), 6) AS change FROM r GROUP BY 1""",
    "hourly_bucket": f"""WITH {LOG} SELECT case_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS readings, round(avg(value), 6) AS mean, string_agg(DISTINCT truth, ';' ORDER BY truth) AS labels FROM log GROUP BY 1, 2""",
    "hetero_union_trace": """WITH t AS (SELECT o_custkey AS case_id, 'Order_' || o_orderstatus AS activity, o_orderdate AS ts FROM orders UNION ALL SELECT o_custkey, 'Ship_' || l_returnflag, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT case_id, activity, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last FROM t GROUP BY 1, 2""",
    "super_category_lookup": """SELECT coalesce(category, 'OTHER') AS category, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN (VALUES ('ECONOMY', 'LOW'), ('STANDARD', 'MID'), ('PROMO', 'MID')) m(kind, category) ON p_type = kind GROUP BY 1""",
    "interval_events": """WITH r AS (SELECT o_custkey AS case_id, o_orderdate, l_shipdate, 'delivery ' || l_linestatus AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT case_id, 'START ' || a AS activity, o_orderdate AS ts FROM r UNION ALL SELECT case_id, 'END ' || a, l_shipdate FROM r) SELECT case_id, activity, count(*) AS n FROM e WHERE ts IS NOT NULL AND activity IS NOT NULL GROUP BY 1, 2""",
    "recent_per_label_topk": f"WITH {LOG} SELECT seq, activity FROM log WHERE activity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY activity ORDER BY seq DESC) <= 200",
    "vocab_discovery": f"WITH {LOG} SELECT count(DISTINCT truth) AS activities, string_agg(DISTINCT truth, ',' ORDER BY truth) AS names, count(DISTINCT case_id) AS cases FROM (SELECT * FROM log ORDER BY seq LIMIT 10000)",
    "distinct_offset_page": "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 50 OFFSET 20",
    "syscall_labels": """WITH t AS (SELECT event_id AS seq, event_type, user_id % 7 AS u, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT seq, CASE WHEN k % 5 <> 0 THEN event_type || '_' || u || '_' || CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END END AS activity,
CAST(CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN k % 4 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS counters, CASE WHEN k % 4 <> 0 THEN k % 4 ELSE -1 END AS mid FROM t""",
    "wide_csv_maps": f"WITH {LOG} SELECT seq, json_extract_string(props, '$.k') AS k, round(value, 6) AS value FROM log",
    "label_filter": f"WITH {LOG} SELECT activity, count(*) AS n, round(sum(value), 2) AS total FROM log WHERE activity IS NOT NULL AND lower(trim(activity)) NOT IN ('', 'nan', 'null', 'none', 'na') AND NOT regexp_matches(activity, '^LogWindow_(train|test)$') GROUP BY 1",
    "xes_round_trip": f"WITH {LOG} SELECT row_number() OVER (ORDER BY ts) - 1 AS seq, case_id, activity, json_extract_string(props, '$.k') AS k, value FROM log",
}
