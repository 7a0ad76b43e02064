"""Queries of the smaller operators: payloads, evaluation runs, state that is kept, drift rules, sources read back; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemend.functions import columns as C
from tracemend.operators import clusters, dfg, drift, evaluation, features, inject, metrics, payload, prefixes, temporal
from tracemend.plans.oracles import _LABELS, EDGES, LOG, REPAIRED, SCORED, STATS, _pairs, _prefixed
from tracemend.schema import from_events
from tracemend.sources import files, syscalls, tables, xes

log = from_events


def folder(spark: SparkSession, name: str) -> str:
    from tracemend.plans.models import _folder

    return _folder(spark, name)


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with a map of attributes whose keys come in by and by."""
    k = F.col("_k")  # read from the text once a row
    pairs = F.create_map(F.lit("k"), k.cast("string"), F.lit("user"), F.col("case_id"), F.lit("even"), F.when(k % 2 == 0, "yes"), F.lit("list"), F.when(k % 3 == 0, F.concat(F.lit("['a', '"), k.cast("string"), F.lit("']"))), F.lit("late"), F.when(F.col("seq") > 500, "x"))
    t = log(spark, sf_dir).withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
    return t.withColumn("attributes", F.map_filter(pairs, lambda _, v: v.isNotNull())).drop("_k")


_ATTR = f"""{LOG}, kv AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM log),
attrs AS (SELECT seq, unnest(['k', 'user', 'even', 'list', 'late']) AS key, unnest([CAST(k AS VARCHAR), case_id, CASE WHEN k % 2 = 0 THEN 'yes' END, CASE WHEN k % 3 = 0 THEN '[''a'', ''' || k || ''']' END, CASE WHEN seq > 500 THEN 'x' END]) AS v FROM kv),
there AS (SELECT * FROM attrs WHERE v IS NOT NULL)"""


def common_attribute_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.common_keys(attributed(spark, sf_dir), 3)


def attribute_key_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.key_slots(attributed(spark, sf_dir), 4)


SLOTS, HASH = ["k", "even", "list"], 4


def payload_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload vectors by cell: how often each isn't 0, and its sum."""
    # no vector is empty; a plain explode would first make each vector once more to see that
    v = payload.payload(attributed(spark, sf_dir), SLOTS, HASH).select(F.posexplode_outer("payload").alias("cell", "v"))
    return v.groupBy("cell").agg(F.count_if(F.col("v") != 0).alias("used"), F.round(F.sum("v"), 4).alias("total"))


def _hash_cells(text: str) -> str:
    return "[" + ", ".join(f"CAST('0x' || substr(md5({text}), {2 * i + 1}, 2) AS INTEGER) / 255.0::DOUBLE * 2 - 1" for i in range(HASH)) + "]"


_of = lambda k: f"max(CASE WHEN key = '{k}' THEN v END)"
_cells = (
    [f"CASE WHEN {_of(k)} IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END" for k in SLOTS]
    + [f"coalesce({_of('k')}::DOUBLE, 0)", "0::DOUBLE", f"CASE WHEN {_of('list')} IS NOT NULL THEN 2.0::DOUBLE ELSE 0 END"]
    + [f"CASE WHEN {_of('k')} IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END", "0::DOUBLE", f"CASE WHEN {_of('list')} IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END"]
)
_zeros = "[" + ", ".join(["0::DOUBLE"] * HASH) + "]"
_PAYLOAD = f"""WITH {_ATTR}, vectors AS (
  SELECT seq, list_concat([{", ".join(_cells)}], {", ".join(f"CASE WHEN {_of(k)} IS NOT NULL THEN {_hash_cells(_of(k))} ELSE {_zeros} END" for k in SLOTS)}, {_hash_cells("string_agg(key, '|' ORDER BY key)")}, [count(*)::DOUBLE]) AS p FROM there GROUP BY seq
), c AS (SELECT unnest(range(0, len(p))) AS cell, unnest(p) AS v FROM vectors) SELECT CAST(cell AS INTEGER) AS cell, count(*) FILTER (v <> 0) AS used, round(sum(v), 4) AS total FROM c GROUP BY 1"""


def enriched_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data, control flow weighted by a confidence and sensor cells, standardised by the rows so far of the case."""
    k = F.get_json_object("props", "$.k").cast("double")
    t = log(spark, sf_dir)
    parts = t.select("seq", "case_id", F.array(k).alias("data"), F.array(F.when(F.col("activity") == "view", 1.0).otherwise(0.0), F.hour("ts") / 24.0).alias("flow"), F.array(F.coalesce("value", F.lit(0.0))).alias("sensors"), F.when(F.col("activity").isNull(), 0.5).otherwise(1.0).alias("w"))
    x = payload.enriched(parts, F.col("w")).join(parts.select("seq", "case_id"), "seq")
    z = payload.running_standardised(x, 4, "case_id")
    return z.select("seq", *((F.round(F.get("x", F.lit(i)), 3) + 0.0).alias(f"x{i}") for i in range(4)))


_ENRICHED = f"""WITH {LOG}, parts AS (SELECT seq, case_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x0, (coalesce(activity = 'view', false))::INT * CASE WHEN activity IS NULL THEN 0.5::DOUBLE ELSE 1 END AS x1, hour(ts) / 24.0::DOUBLE * CASE WHEN activity IS NULL THEN 0.5::DOUBLE ELSE 1 END AS x2, coalesce(value, 0) AS x3 FROM log)
SELECT seq, {", ".join(f"round(CASE WHEN count(*) OVER w < 2 THEN 0 ELSE (x{i} - avg(x{i}) OVER w) / greatest(stddev_samp(x{i}) OVER w, 1e-8) END, 3) + 0 AS x{i}" for i in range(4))} FROM parts WINDOW w AS (PARTITION BY case_id ORDER BY seq)"""


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = payload.label_vector(F.col("activity"), 8)
    return log(spark, sf_dir).where("activity is not null").select("activity").distinct().select("activity", *(F.round(F.get(v, F.lit(i)), 6).alias(f"v{i}") for i in range(8)))


def sensor_vector_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the cells of the sensor vector of the log: one sensor for each label."""
    names = sorted(r[0] for r in log(spark, sf_dir).where("activity is not null").select("activity").distinct().collect())  # a row for each label
    return spark.createDataFrame(list(enumerate(payload.sensor_names(names))), "cell int, name string")


def top_recovered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.top_labels(prefixes.repair(log(spark, sf_dir), _LABELS, order=2, dominance=0.25, support=5), 3)


RATES, SEEDS = [0.1, 0.3], [1, 2]


def full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with each label but those that are missing by nature: one in fifty."""
    return log(spark, sf_dir).withColumn("truth", F.when(F.col("seq") % 50 != 3, F.col("truth"))).select("seq", "case_id", "truth", F.col("truth").alias("activity"))


def evaluation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the repair by prefix counts for two rates and two seeds."""
    return evaluation.runs(full_log(spark, sf_dir), RATES, SEEDS, lambda t: prefixes.repair(t, _LABELS, order=1, dominance=0.2, support=5))


_draw = lambda seed: f"CAST('0x' || substr(md5(CAST(seq AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
_FULL = "full_log AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS case_id, CASE WHEN event_id % 50 <> 3 THEN event_type END AS truth FROM events)"


def _masked(rate: float, seed: int) -> str:
    return f"""drawn AS (SELECT *, row_number() OVER (ORDER BY truth IS NULL, {_draw(seed)}, seq) AS k FROM full_log),
log AS (SELECT seq, case_id, truth, CASE WHEN k > (SELECT CAST(floor(count(truth) * {rate}::DOUBLE) AS BIGINT) FROM full_log) THEN truth END AS activity, truth IS NOT NULL AND k <= (SELECT CAST(floor(count(truth) * {rate}::DOUBLE) AS BIGINT) FROM full_log) AS injected FROM drawn)"""


def _run(rate: float, seed: int) -> str:
    counts = ", ".join(f"coalesce(sum(CASE WHEN activity = '{a}' THEN 1 ELSE 0 END) OVER w, 0) AS n{i}" for i, a in enumerate(_LABELS))
    all_ = ", ".join(f"n{i}" for i in range(len(_LABELS)))
    return f"""SELECT * FROM (WITH {_masked(rate, seed)}, {_prefixed(1)}, counted AS (SELECT *, {counts} FROM prefixed WINDOW w AS (PARTITION BY prefix ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
topped AS (SELECT *, {all_.replace(", ", " + ")} AS total, greatest({all_}) AS top FROM counted), repaired AS (SELECT *, CASE WHEN total >= 5 AND top / total >= 0.2 THEN CASE {" ".join(f"WHEN n{i} = top THEN '{a}'" for i, a in enumerate(_LABELS))} END END AS recovered FROM topped WHERE activity IS NULL AND truth IS NOT NULL),
t AS (SELECT count(*) AS total, count(*) FILTER (recovered = truth) AS tp, count(*) FILTER (recovered <> truth) AS fp, count(*) FILTER (recovered IS NULL) AS abstained FROM repaired), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(total, 0), 0) AS q FROM t)
SELECT {rate}::DOUBLE AS rate, {seed} AS seed, total, tp, fp, total - tp AS fn, abstained, round(p, 6) AS "precision", round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1, round(coalesce((tp + fp) / nullif(total, 0), 0), 6) AS coverage, round(coalesce(abstained / nullif(total, 0), 0), 6) AS abstain_rate FROM r)"""


def kept_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A masked run that is written, found again, and read without the events that lacked a label by nature, numbered anew."""
    root = folder(spark, "runs")
    evaluation.keep_run(full_log(spark, sf_dir).select("seq", "case_id", "truth"), root, 0.2, 5)
    evaluation.keep_run(full_log(spark, sf_dir).limit(0).select("seq", "case_id", "truth"), root, 0.2, 5)  # it is there, so this changes nothing
    return evaluation.load_run(spark, root, 0.2, 5, drop_natural=True).select("seq", "case_id", "activity", F.when(F.col("injected"), F.col("truth")).alias("ground_truth"))


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.holdout(log(spark, sf_dir), 0.1, 3)


def masked_and_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log under a mask, with what it was beside it."""
    t = full_log(spark, sf_dir)
    return inject.apply_mask(t, inject.mask_share(t, 0.25, 9)).groupBy("truth", "activity").agg(F.count("*").alias("n"))


def label_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_counts(log(spark, sf_dir))


def balanced_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.balanced_reservoir(log(spark, sf_dir), 300)


def count_cache_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: prefixes of the cache, and its observations."""
    t = prefixes.with_prefix(log(spark, sf_dir), 3).where("activity is not null")
    return t.agg(F.countDistinct("prefix").alias("prefixes"), F.count("*").alias("observations"))


def dfg_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dfg.edges(log(spark, sf_dir))
    return dfg.counts(e, dfg.parallel_pairs(e))


def prefix_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For missing labels: the last three entries of the case with label and provenance, and how many of each provenance."""
    t = prefixes.prefix_entries(prefixes.repair(log(spark, sf_dir), _LABELS, order=2, dominance=0.25, support=5), 3).where("activity is null")
    text = F.array_join(F.transform("entries", lambda e: F.concat_ws("/", F.coalesce(e["label"], F.lit("?")), e["provenance"])), ",")
    return t.select("seq", text.alias("entries"), *(F.size(F.filter("entries", _is(p))).alias(c) for c, p in (("given", "NORMAL"), ("repaired", "RECOVERED_ML_SEQ"), ("open", "UNRECOVERED_ML"))))


def _is(provenance: str):
    return lambda e: e["provenance"] == provenance


def saved_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster sums that are written and read again give the same distances."""
    p = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("z"))
    at = f"{folder(spark, 'clusters')}/state"
    clusters.save(clusters.sufficient(p), at)
    return clusters.diagonal_distances(p, clusters.load(spark, at)).groupBy("label").agg(F.round(F.min("d"), 3).alias("low"), F.round(F.max("d"), 3).alias("high"), F.round(F.avg("d"), 3).alias("mean"))


def alpha_lambda_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of the whole 8 by 5 grid with the best F1, ties by the larger threshold and strength."""
    from tracemend.plans.catalogue import _best

    cells = clusters.grid(_best(spark, sf_dir), [0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12], [0.0, 0.5, 1.0, 1.5, 2.0])
    return cells.orderBy(F.desc("f1"), F.desc("alpha"), F.desc("strength")).limit(1)


def bfr_covariance_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of all 64 dimensions: for each label and dimension, those with the others summed and the largest."""
    p = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("z"))
    return clusters.covariance_cells(p, 64).groupBy("label", "i").agg(F.count("*").alias("cells"), F.round(F.sum("covariance"), 6).alias("total"), F.round(F.max("covariance"), 6).alias("most"))


def drift_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and variances of each label's vectors by stretches of positions."""
    p = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("seq"), "label", F.col("embedding").cast("array<double>").alias("z"))
    return drift.embedding_signals(p, 200).select("label", "at", F.round("norm", 4).alias("norm"), F.round("variance", 4).alias("variance"))


def drift_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label and stretch of 100 positions: which of its figures moved away from the stretch before, severities, combination rules, recommendations, whether to retrain."""
    t = log(spark, sf_dir).where("activity is not null").groupBy("activity", F.floor(F.col("seq") / 100).alias("at")).agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("value") - 100)).alias("error"), F.avg("value").alias("mean"), F.var_pop("value").alias("spread"), F.avg(F.hour("ts")).alias("hour"),
    )
    t = t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("at")))  # a row for each label and stretch
    before = lambda c: F.lag(c).over(Window.partitionBy("activity").orderBy("at"))
    moved = lambda c, by: F.coalesce(F.abs(F.col(c) - before(c)) > by, F.lit(False))
    fired = {"rec": moved("error", 0.15 * before("error")), "norm": moved("mean", 0.1 * before("mean")), "var": moved("spread", 0.3 * before("spread")), "dist": moved("share", F.lit(0.06)), "emb": moved("hour", F.lit(1.5)), "other": moved("n", F.lit(6))}
    t = t.select("activity", "at", *(v.alias(k) for k, v in fired.items()))
    rec, norm, var, dist, emb, other = (F.col(c) for c in fired)
    kinds = sum((x.cast("int") for x in (rec, norm, var, dist)), F.lit(0))
    own = drift.severity(kinds)
    both = drift.averaged_severity(emb, F.lit(0.5), own)
    any_ = drift.combined({"e": emb, "a": kinds >= 1}, "any")
    return t.select(
        "activity", "at", own.alias("own"), both.alias("averaged"), *(drift.combined({"e": emb, "a": kinds >= 1, "o": other}, r).alias(r) for r in ("any", "all", "majority")),
        drift.recommendation(kinds >= 1, own, rec).alias("single"), drift.combined_recommendation(any_, both, emb.cast("int") + kinds, rec).alias("combined"),
        drift.retrain((own == "high").cast("int"), (own == "medium").cast("int"), kinds, rec.cast("int"), emb.cast("int"), kinds).alias("retrain"),
    )


def drift_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At alarms of a label (each 97th event): means of its older and newer errors, and what follows."""
    t = log(spark, sf_dir).where("activity is not null").select("seq", "activity", F.abs(F.col("value") - 100).alias("error"), (F.col("seq") % 97 == 0).alias("alarm"))
    return drift.tiers(t).select("seq", "activity", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), "reaction")


def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drifts by severity after the warm-up, the last position and the last five."""
    t = log(spark, sf_dir).withColumn("severity", drift.severity((F.col("seq") % 4).cast("int")))
    return drift.summary(drift.after_warmup(t, "seq", 400).where("severity <> 'none'"), "seq").withColumn("recent", F.array_join(F.transform("recent", lambda x: x.cast("string")), ","))


def recent_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 150 labelled events, and of those of each label the last 20."""
    last = log(spark, sf_dir).where("activity is not null").orderBy(F.desc("seq")).limit(150)  # the window is the feature
    return temporal.recent(last, "activity", 20).select("seq", "activity")


def null_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that stand for nothing: null texts and -1."""
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.when(k % 5 == 0, "-1").when(k % 5 == 1, " None ").when(k % 5 == 2, "nan").otherwise(k.cast("string"))
    return log(spark, sf_dir).groupBy(C.is_null_number(text).alias("nothing")).agg(F.count("*").alias("n"))


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes written as JSON and read again."""
    t = attributed(spark, sf_dir).select("seq", F.to_json("attributes").alias("j"))
    m = F.from_json("j", "map<string,string>")
    return t.select("seq", F.size(m).alias("keys"), F.try_element_at(m, F.lit("k")).alias("k"))


def wide_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide CSV file, written and read as a log."""
    at = folder(spark, "wide")
    t = log(spark, sf_dir)
    t.select("seq", "case_id", F.col("activity").alias("concept_name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.get_json_object("props", "$.k").alias("attr_k"), F.col("value").alias("sensor_value")).write.option("header", True).csv(at)
    got = tables.read_wide_csv(spark, at)
    return got.select("seq", "case_id", "activity", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.try_element_at("attributes", F.lit("k")).alias("k"), F.round(F.try_element_at("sensors", F.lit("value")), 4).alias("value"))


def ticket_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticket log with columns of its own, one of them dropped."""
    at = folder(spark, "tickets")
    log(spark, sf_dir).select(F.col("case_id").alias("Case ID"), F.col("activity").alias("Activity"), F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSS").alias("Complete Timestamp"), F.col("seq").alias("Ticket"), F.lit("v").alias("Variant.1")).write.option("header", True).csv(at)
    got = tables.read_ticket_csv(spark, at, {"Case ID": "case_id", "Activity": "activity", "Complete Timestamp": "timestamp"}, drop=("Variant.1",))
    return got.select(F.try_element_at("attributes", F.lit("Ticket")).cast("long").alias("seq"), "case_id", "activity", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.size("attributes").alias("keys"))


def audit_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide audit table as CSV, of which some columns are read."""
    at = folder(spark, "audit")
    k = F.get_json_object("props", "$.k").cast("int")
    log(spark, sf_dir).select(
        F.col("case_id").alias("pid"), F.col("truth").alias("syscall"), (k % 7).alias("uid"), F.when(k % 5 != 0, F.when(k % 2 == 0, "yes").otherwise("no")).alias("success"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
        (k % 3).alias("low"), F.concat(F.lit("['a', '"), k.cast("string"), F.lit("']")).alias("args"), F.col("seq").alias("exe"), F.lit("unread").alias("rest"),
    ).write.option("header", True).csv(at)
    got = syscalls.read_csv(spark, at, ["pid", "syscall", "uid", "success", "time", "low", "args", "exe"], ["low"], ["args"])
    return got.select(F.try_element_at("attributes", F.lit("exe")).cast("long").alias("seq"), "case_id", "activity", F.try_element_at("sensors", F.lit("counter/low")).alias("low"), F.try_element_at("sensors", F.lit("list/args")).alias("args"))


def written_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log written as Parquet: its one-row summary."""
    at = folder(spark, "log")
    tables.write_log(log(spark, sf_dir).drop("props"), at)
    s = spark.read.json(f"{at}/summary")
    return s.select("events", "labelled", "cases", F.array_join("activities", ",").alias("activities"), F.lit(spark.read.parquet(f"{at}/events").count()).alias("read"))


def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and cases of each file of a log."""
    t = log(spark, sf_dir).withColumn("file_path", F.concat(F.lit("part-"), (F.col("case_id").cast("int") % 4).cast("string")))
    return xes.main_index(t).select("file_path", "events", "cases", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


def compressed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed CSV files loaded as typed tables; one of those asked for isn't there."""
    at = folder(spark, "gz")
    for n, t in (("orders", spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")), ("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"))):
        t.write.option("header", True).option("compression", "gzip").csv(f"{at}/in/{n}.csv.gz")
    got = files.load_tables(spark, f"{at}/in", ["orders", "nation", "absent"], f"{at}/tables")
    return got["orders"].groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"), F.max(F.col("o_custkey") + 1).alias("top")).withColumn("tables", F.lit(len(got)))


def batched_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written in parts of 40; a second run with other rows adds only the parts that were missing."""
    at = folder(spark, "parts")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    files.write_batches(c.where("c_custkey < 80"), "c_custkey", 40, at)
    files.write_batches(c.withColumn("c_nationkey", F.lit(-1)), "c_custkey", 40, at)
    return spark.read.parquet(at).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"), F.count_if(F.col("c_nationkey") == -1).alias("later"))


def compressed_xes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as compressed XES files, found by their names, with a limit on the events of a trace and a filter."""
    at = folder(spark, "xes")
    t = log(spark, sf_dir).select("seq", "case_id", "activity", "ts", F.lit("complete").alias("lifecycle"), F.lit(None).cast("string").alias("resource"), F.create_map(F.lit("event"), F.col("seq").cast("string")).alias("attributes"), F.create_map().cast("map<string,string>").alias("sensors_raw"))
    xes.write_xml(t, f"{at}/deep/log", compression="gzip")
    found = xes.read_logs(spark, at, where=F.col("activity").isNotNull(), most_events=30)
    return found.select(F.try_element_at("attributes", F.lit("event")).cast("long").alias("seq"), "case_id", "activity")


def yaml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as YAML documents with sensor points, written and read again."""
    at = folder(spark, "yaml")
    t = log(spark, sf_dir).select("seq", "case_id", "activity", "ts", F.create_map(F.lit("event"), F.col("seq").cast("string")).alias("attributes"), F.create_map(F.lit("meter/value"), F.col("value").cast("string")).alias("sensors_raw"))
    xes.write_yaml(t, at)
    got = xes.read_logs(spark, at)
    return got.select(F.try_element_at("attributes", F.lit("event")).cast("long").alias("seq"), "case_id", "activity", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round(F.try_element_at("sensors", F.lit("meter/value")), 4).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        common_attribute_keys, attribute_key_slots, payload_vectors, enriched_features, label_vectors, sensor_vector_names, top_recovered_labels, evaluation_runs, kept_run, holdout_split, masked_and_restored,
        label_class_counts, balanced_reservoir, count_cache_size, dfg_size, prefix_entries, saved_clusters, alpha_lambda_best, bfr_covariance_all, drift_signals, drift_verdicts,
        drift_tiers, drift_summary, recent_labelled, null_numbers, json_round_trip, wide_csv_round_trip, ticket_csv_round_trip, audit_csv, written_log, file_index, compressed_tables, batched_parts, compressed_xes, yaml_round_trip,
    )
}

_LOG_BACK = f"""WITH {LOG} SELECT seq, case_id, activity, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"""
_DRIFT = f"""{LOG}, g AS (SELECT activity, seq // 100 AS "at", count(*) AS n, avg(abs(value - 100)) AS error, avg(value) AS mean, var_pop(value) AS spread, avg(hour(ts)) AS hour FROM log WHERE activity IS NOT NULL GROUP BY 1, 2),
h AS (SELECT *, n / sum(n) OVER (PARTITION BY "at") AS share FROM g), b AS (SELECT activity, "at", coalesce(abs(error - lag(error) OVER w) > 0.15::DOUBLE * lag(error) OVER w, false) AS rec, coalesce(abs(mean - lag(mean) OVER w) > 0.1::DOUBLE * lag(mean) OVER w, false) AS norm,
  coalesce(abs(spread - lag(spread) OVER w) > 0.3::DOUBLE * lag(spread) OVER w, false) AS var, coalesce(abs(share - lag(share) OVER w) > 0.06::DOUBLE, false) AS dist, coalesce(abs(hour - lag(hour) OVER w) > 1.5::DOUBLE, false) AS emb, coalesce(abs(n - lag(n) OVER w) > 6, false) AS other FROM h WINDOW w AS (PARTITION BY activity ORDER BY "at")),
k AS (SELECT *, rec::INT + norm::INT + var::INT + dist::INT AS kinds FROM b), o AS (SELECT *, CASE WHEN kinds >= 3 THEN 'high' WHEN kinds = 2 THEN 'medium' WHEN kinds = 1 THEN 'low' ELSE 'none' END AS own, [0.0, 0.3, 0.6, 0.9, 0.9][kinds + 1]::DOUBLE AS w FROM k),
m AS (SELECT *, CASE WHEN emb THEN (0.5::DOUBLE + w) / 2 ELSE w END AS mean FROM o), s AS (SELECT *, CASE WHEN mean < 0.3 THEN 'low' WHEN mean < 0.6 THEN 'medium' ELSE 'high' END AS averaged, emb OR kinds >= 1 AS hit FROM m)"""

ORACLES = {
    "common_attribute_keys": f"WITH {_ATTR} SELECT key, count(*) AS n FROM there GROUP BY 1 ORDER BY n DESC, key LIMIT 3",
    "attribute_key_slots": f"WITH {_ATTR}, f AS (SELECT key, min(seq) AS first FROM there GROUP BY 1) SELECT key, CAST(row_number() OVER (ORDER BY first, key) - 1 AS INTEGER) AS slot FROM f ORDER BY first, key LIMIT 4",
    "payload_vectors": _PAYLOAD, "enriched_features": _ENRICHED,
    "label_vectors": f"""WITH {LOG} SELECT DISTINCT activity, {", ".join(f"round(CAST('0x' || substr(md5(activity || ':{i}'), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE * 2 - 1, 6) AS v{i}" for i in range(8))} FROM log WHERE activity IS NOT NULL""",
    "sensor_vector_names": f"""WITH {LOG}, s AS (SELECT DISTINCT activity FROM log WHERE activity IS NOT NULL), k AS (SELECT unnest(['val', 'pres', 'mean', 'std', 'slope', 'delta']) AS kind, unnest(range(0, 6)) AS o)
SELECT CAST(row_number() OVER (ORDER BY o, activity) - 1 AS INTEGER) AS cell, 'iot_' || kind || '_' || activity AS name FROM k, s""",
    "top_recovered_labels": f"WITH {REPAIRED} SELECT recovered AS activity, count(*) AS n FROM repaired WHERE activity IS NULL AND recovered IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3",
    "evaluation_runs": f"WITH {_FULL} " + " UNION ALL ".join(_run(r, s) for r in RATES for s in SEEDS),
    "kept_run": f"WITH {_FULL}, {_masked(0.2, 5)} SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, case_id, activity, CASE WHEN injected THEN truth END AS ground_truth FROM log WHERE truth IS NOT NULL",
    "holdout_split": f"""WITH {LOG}, known AS (SELECT *, row_number() OVER (ORDER BY {_draw(3)}, seq) AS k, count(*) OVER () AS n FROM log WHERE activity IS NOT NULL) SELECT seq, activity, CASE WHEN k <= CAST(floor(n * 0.1::DOUBLE) AS BIGINT) THEN 'holdout' ELSE 'train' END AS part FROM known""",
    "masked_and_restored": f"WITH {_FULL}, {_masked(0.25, 9)} SELECT truth, activity, count(*) AS n FROM log GROUP BY 1, 2",
    "label_class_counts": f"WITH {LOG}, n AS (SELECT activity, count(*) AS n FROM log WHERE activity IS NOT NULL GROUP BY 1) SELECT *, n = max(n) OVER () AS largest FROM n",
    "balanced_reservoir": f"""WITH {LOG}, n AS (SELECT activity, count(*) AS n FROM log WHERE activity IS NOT NULL GROUP BY 1), q AS (SELECT *, CAST(floor((300 - (sum(n) OVER w - n)) / (count(*) OVER () - row_number() OVER w + 1)) AS BIGINT) AS quota FROM n WINDOW w AS (ORDER BY n, activity)),
cut AS (SELECT arg_min(quota, n) AS q FROM q WHERE n > quota), r AS (SELECT seq, activity, row_number() OVER (PARTITION BY activity ORDER BY {_draw(7)}, seq) AS k FROM log WHERE activity IS NOT NULL) SELECT seq, activity FROM r, cut WHERE q IS NULL OR k <= q""",
    "count_cache_size": f"WITH {LOG}, {_prefixed(3)} SELECT count(DISTINCT prefix) AS prefixes, count(*) AS observations FROM prefixed WHERE activity IS NOT NULL",
    "dfg_size": f"WITH {EDGES}, {_pairs(0.3)} SELECT (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM paired) AS n_parallel_pairs",
    "prefix_entries": f"""WITH {REPAIRED}, e AS (SELECT *, list(coalesce(recovered, '?') || '/' || provenance) OVER w AS l, list(provenance) OVER w AS p FROM repaired WINDOW w AS (PARTITION BY case_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT seq, coalesce(array_to_string(l, ','), '') AS entries, CAST(coalesce(len(list_filter(p, lambda x: x = 'NORMAL')), 0) AS INTEGER) AS given, CAST(coalesce(len(list_filter(p, lambda x: x = 'RECOVERED_ML_SEQ')), 0) AS INTEGER) AS repaired, CAST(coalesce(len(list_filter(p, lambda x: x = 'UNRECOVERED_ML')), 0) AS INTEGER) AS open FROM e WHERE activity IS NULL""",
    "saved_clusters": f"WITH {SCORED} SELECT label, round(min(d), 3) AS low, round(max(d), 3) AS high, round(avg(d), 3) AS mean FROM dist GROUP BY 1",
    "alpha_lambda_best": f"""WITH {SCORED}, t AS (SELECT b.*, b.label = e.label AS correct FROM best b JOIN embeddings e USING (vec_id)), g AS (SELECT unnest([0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12])::DOUBLE AS alpha), h AS (SELECT unnest([0.0, 0.5, 1.0, 1.5, 2.0])::DOUBLE AS strength),
c AS (SELECT alpha, strength, u * pow(greatest(1 - t.h / hmax, 0), strength) * w >= alpha AS sure, correct FROM t, g, h), r AS (SELECT alpha, strength, count(*) FILTER (sure AND correct) AS tp, count(*) FILTER (sure AND NOT correct) AS fp, count(*) AS n FROM c GROUP BY 1, 2),
x AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, tp / n AS q FROM r) SELECT alpha, strength, tp, fp, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1 FROM x ORDER BY f1 DESC, alpha DESC, strength DESC LIMIT 1""",
    "bfr_covariance_all": f"""WITH {STATS}, c AS (SELECT a.label, a.i, round(avg(a.v * b.v) - avg(a.v) * avg(b.v), 6) AS covariance FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.label, a.i, b.i)
SELECT label, CAST(i AS INTEGER) AS i, count(*) AS cells, round(sum(covariance), 6) AS total, round(max(covariance), 6) AS most FROM c GROUP BY 1, 2""",
    "drift_signals": """WITH v AS (SELECT label, vec_id // 200 AS "at", list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) AS q, list_sum(CAST(embedding AS DOUBLE[])) AS s, len(embedding) AS d FROM embeddings WHERE label IS NOT NULL)
SELECT label, "at", round(round(avg(sqrt(q)), 6), 4) AS norm, round(round(sum(q) / sum(d) - (sum(s) / sum(d)) ** 2, 6), 4) AS variance FROM v GROUP BY 1, 2""",
    "drift_verdicts": f"""WITH {_DRIFT} SELECT activity, "at", own, averaged, emb OR kinds >= 1 OR other AS "any", emb AND kinds >= 1 AND other AS "all", (emb::INT + (kinds >= 1)::INT + other::INT) * 2 > 3 AS majority,
CASE WHEN kinds = 0 THEN 'continue_monitoring' WHEN own = 'high' THEN 'immediate_retraining_recommended' WHEN own = 'medium' AND rec THEN 'schedule_retraining' WHEN own = 'medium' THEN 'increase_monitoring' ELSE 'monitor_closely' END AS single,
CASE WHEN NOT hit THEN 'continue_monitoring' WHEN averaged = 'high' OR emb::INT + kinds >= 3 THEN 'immediate_retraining' WHEN averaged = 'medium' AND rec THEN 'schedule_retraining' WHEN averaged = 'low' THEN 'increase_monitoring' ELSE 'monitor_closely' END AS combined,
own = 'high' OR kinds >= 3 AS retrain FROM s""",
    "drift_tiers": f"""WITH {LOG}, e AS (SELECT seq, activity, list(abs(value - 100)) OVER (PARTITION BY activity ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS es FROM log WHERE activity IS NOT NULL), a AS (SELECT *, len(es) // 2 AS mid FROM e WHERE seq % 97 = 0),
m AS (SELECT *, list_avg(es[1:mid]) AS before, list_avg(es[mid + 1:]) AS after FROM a) SELECT seq, activity, round(before, 4) AS before, round(after, 4) AS after, CASE WHEN len(es) < 20 THEN 'none' WHEN before > 0 AND after / before > 2 THEN 'decay_and_tune' ELSE 'tune' END AS reaction FROM m""",
    "drift_summary": """WITH d AS (SELECT event_id AS seq, event_id % 4 AS k FROM events WHERE event_id >= 400 AND event_id % 4 > 0) SELECT count(*) AS drifts, count(*) FILTER (k = 1) AS low, count(*) FILTER (k = 2) AS medium, count(*) FILTER (k = 3) AS high, max(seq) AS last,
array_to_string(list(CAST(seq AS VARCHAR) ORDER BY seq DESC)[1:5], ',') AS recent FROM d""",
    "recent_labelled": f"WITH {LOG}, l AS (SELECT * FROM log WHERE activity IS NOT NULL ORDER BY seq DESC LIMIT 150), r AS (SELECT *, row_number() OVER (PARTITION BY activity ORDER BY seq DESC) AS k FROM l) SELECT seq, activity FROM r WHERE k <= 20",
    "null_numbers": "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 < 3 AS nothing, count(*) AS n FROM events GROUP BY 1",
    "json_round_trip": f"WITH {_ATTR} SELECT seq, CAST(count(*) AS INTEGER) AS keys, max(CASE WHEN key = 'k' THEN v END) AS k FROM there GROUP BY 1",
    "wide_csv_round_trip": f"{_LOG_BACK}, json_extract_string(props, '$.k') AS k, round(value, 4) AS value FROM log",
    "ticket_csv_round_trip": f"{_LOG_BACK}, 1 AS keys FROM log",
    "audit_csv": f"""WITH {LOG}, t AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM log) SELECT seq, case_id, CASE WHEN k % 5 <> 0 THEN truth || '_' || (k % 7) || '_' || CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END END AS activity, CASE WHEN k % 3 <> 0 THEN (k % 3)::DOUBLE END AS low, 2.0::DOUBLE AS args FROM t""",
    "written_log": f"WITH {LOG} SELECT count(*) AS events, count(activity) AS labelled, count(DISTINCT case_id) AS cases, string_agg(DISTINCT activity, ',' ORDER BY activity) AS activities, CAST(count(*) AS INTEGER) AS read FROM log",
    "file_index": f"WITH {LOG} SELECT 'part-' || (CAST(case_id AS INTEGER) % 4) AS file_path, count(*) AS events, count(DISTINCT case_id) AS cases, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM log GROUP BY 1",
    "compressed_tables": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price, max(o_custkey + 1) AS top, 2 AS tables FROM orders GROUP BY 1",
    "batched_parts": "SELECT c_custkey // 40 AS part, count(*) AS n, CASE WHEN part < 2 THEN 0 ELSE count(*) END AS later FROM customer GROUP BY 1",
    "compressed_xes": f"WITH {LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS k FROM log WHERE activity IS NOT NULL) SELECT seq, case_id, activity FROM n WHERE k <= 30",
    "yaml_round_trip": f"{_LOG_BACK}, round(value, 4) AS value FROM log",
}
