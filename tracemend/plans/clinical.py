"""The log of hospital stays over the sales tables: customers stand for admissions, orders and lines for what happened in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.sources import clinical

ITEMS = [220045, 220210, 220277, 223761, 220052, 220181, 1, 220739]
LABS = [50912, 50813, 51301, 7]
ORDERS = ["Continuous Med", "Drug Push and bolus", "PO dose", "Polymer"]
CATEGORIES = ["Antibiotics", "Pain/Sedation", "Dialysis", "Labs", None]


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    o = read("orders").withColumns({"hadm_id": F.col("o_custkey"), "ed": F.col("o_custkey") + 1_000_000, "icu": F.col("o_custkey") + 2_000_000})
    li = read("lineitem").join(o.select("o_orderkey", "hadm_id", "icu"), F.col("l_orderkey") == F.col("o_orderkey")).where("hadm_id % 2 = 0 or l_returnflag = 'N'")
    hours = lambda c, n: c + F.make_dt_interval(hours=n)
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), by.cast("int"))
    adm = o.groupBy("hadm_id").agg(F.min("o_orderdate").alias("admittime"), (F.max("o_orderdate") + F.expr("interval 30 days")).alias("dischtime"))
    adm = adm.withColumn("deathtime", F.when(F.col("hadm_id") % 4 == 0, F.col("dischtime")))
    h, day = F.col("hadm_id"), F.col("l_shipdate")
    ed = adm.select("hadm_id", (h + 1_000_000).alias("stay_id"), (F.col("admittime") - F.expr("interval 12 hours")).alias("intime"), F.col("admittime").alias("outtime"))
    stay = li.where("hadm_id % 2 = 0")
    span = lambda flag: stay.where(F.col("l_returnflag") == flag).select(F.col("icu").alias("stay_id"), (F.col("l_partkey") % 6).alias("itemid"), hours(day, F.lit(20)).alias("starttime"), hours(day, F.lit(22)).alias("endtime"), F.col("l_quantity").alias("amount"), F.col("l_tax").alias("rate"), pick(ORDERS, F.col("l_orderkey") % 4).alias("ordercategorydescription"))
    labs = li.select("hadm_id", pick(LABS, F.col("l_linenumber") % 4).alias("itemid"), day.alias("day"), F.col("l_quantity").alias("v"), F.when(F.col("l_discount") > 0.05, "abnormal").alias("flag"), F.explode(F.array(F.lit(10), F.lit(15))).alias("at"))  # a second reading in place of a second join
    dims = spark.createDataFrame(list(enumerate(CATEGORIES)), "itemid long, category string").withColumn("label", F.concat(F.lit("item no "), F.col("itemid").cast("string")))
    return {
        "admissions": adm, "edstays": ed,
        "triage": ed.select("stay_id", (36.0 + h % 3).alias("temperature"), (80.0 * (h % 2)).alias("heartrate"), F.lit(None).cast("double").alias("resprate"), F.lit(98.0).alias("o2sat"), F.lit(120.0).alias("sbp"), F.lit(80.0).alias("dbp"), (h % 5).cast("double").alias("pain")),
        "vitalsign": o.select(F.col("ed").alias("stay_id"), F.col("o_orderdate").alias("charttime"), F.lit(70.0).alias("heartrate"), (F.col("o_orderkey") % 3).cast("double").alias("pain")),
        "pyxis": o.where("o_orderstatus = 'F'").select(F.col("ed").alias("stay_id"), F.col("o_orderdate").alias("charttime"), F.col("o_orderpriority").alias("name")),
        "transfers": o.select("hadm_id", F.nullif("o_orderstatus", F.lit("P")).alias("eventtype"), F.col("o_orderdate").alias("intime")),
        "icustays": adm.where("hadm_id % 2 = 0").select("hadm_id", (h + 2_000_000).alias("stay_id"), F.col("admittime").alias("intime"), F.col("dischtime").alias("outtime")),
        "chartevents": stay.select(F.col("icu").alias("stay_id"), pick(ITEMS, F.col("l_linenumber") % 8).alias("itemid"), hours(day, F.col("l_orderkey") % 24).alias("charttime"), F.col("l_quantity").alias("valuenum")),
        "inputevents": span("A"), "procedureevents": span("R").drop("amount", "rate"),
        "outputevents": stay.where("l_returnflag = 'N'").select(F.col("icu").alias("stay_id"), (F.col("l_partkey") % 6).alias("itemid"), day.alias("charttime"), F.col("l_quantity").alias("value")),
        "labevents": labs.select("hadm_id", "itemid", hours(F.col("day"), F.col("at")).alias("charttime"), F.when(F.col("at") == 15, F.col("v") + 1).otherwise(F.col("v")).alias("valuenum"), "flag"),
        "emar": o.select("hadm_id", F.col("o_orderdate").alias("charttime"), F.col("o_orderpriority").alias("medication"), F.when(F.col("o_orderstatus") == "F", "Started").when(F.col("o_orderstatus") == "O", "Stopped").otherwise("Given").alias("event_txt")),
        "microbiologyevents": o.where("o_orderstatus = 'O'").select("hadm_id", F.col("o_orderdate").alias("charttime"), F.col("o_orderpriority").alias("test_name")),
        "d_items": dims, "d_labitems": dims.drop("category"),
    }


FULL = frozenset(clinical.OPTIONAL) - {"context", "all_items"}


def clinical_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of events with all sensors: how many of each a case has, their sensors, and the sum of their values."""
    t = clinical.stays(tables(spark, sf_dir), optional=FULL)
    total = F.aggregate(F.map_values("sensors"), F.lit(0.0), lambda a, v: a + v)
    return t.groupBy("case_id", "activity").agg(F.count("*").alias("n"), F.sum(F.size("sensors")).alias("sensors"), F.round(F.sum(total), 2).alias("total"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm").alias("first"))


def clinical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default parts in order, with the case's clock as sensors and some attributes."""
    t = clinical.stays({k: v for k, v in tables(spark, sf_dir).items() if k in ("admissions", "edstays", "triage", "transfers", "icustays", "microbiologyevents")}, optional=frozenset({"context"}))
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    return t.select("case_id", "seq", "activity", "lifecycle", F.round("hours", 4).alias("hours"), F.round(at("sensors", "case_context/time_since_admission"), 4).alias("since"), at("attributes", "outcome").alias("outcome"), F.size("sensors").alias("sensors"))


def clinical_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of laboratory hours, infusions and outputs."""
    t = clinical.stays({k: v for k, v in tables(spark, sf_dir).items() if k in ("icustays", "inputevents", "outputevents", "labevents", "d_items", "d_labitems")}, optional=frozenset({"labs", "outputs", "infusion_ends"}))
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    t = t.select("activity", at("item_label").alias("item"), at("category").alias("category"), at("lab_flags").alias("flags"), at("lab_tests").alias("tests"), at("measurement_type").alias("measured"))
    return t.groupBy(*t.columns).agg(F.count("*").alias("n"))


_pick = lambda values, by: "CASE " + by + " " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)) for i, v in enumerate(values)) + " END"
_super = _pick([clinical.SUPER_CATEGORIES.get(c, "OTHER_TREATMENT") for c in [*CATEGORIES, None]], "itemid")
_BASE = f"""o AS (SELECT *, o_custkey AS hadm_id FROM orders), li AS (SELECT l.*, hadm_id FROM lineitem l JOIN o ON l_orderkey = o_orderkey WHERE hadm_id % 2 = 0 OR l_returnflag = 'N'),
adm AS (SELECT hadm_id, min(o_orderdate) AS admittime, max(o_orderdate) + INTERVAL 30 DAY AS dischtime FROM o GROUP BY 1),
chart AS (SELECT hadm_id, {_pick(ITEMS, "l_linenumber % 8")} AS itemid, l_shipdate + to_hours(l_orderkey % 24) AS t, l_quantity AS v FROM li WHERE hadm_id % 2 = 0),
lab0 AS (SELECT hadm_id, {_pick(LABS, "l_linenumber % 4")} AS itemid, l_shipdate AS d, l_quantity AS v, l_discount > 0.05 AS flagged, l_partkey FROM li),
lab AS (SELECT hadm_id, itemid, d + INTERVAL 10 HOUR AS t, v, flagged FROM lab0 UNION ALL SELECT hadm_id, itemid, d + INTERVAL 15 HOUR, v + 1, flagged FROM lab0),
spans AS (SELECT row_number() OVER () AS rid, hadm_id, l_returnflag AS flag, l_partkey % 6 AS itemid, l_shipdate + INTERVAL 20 HOUR AS t, l_shipdate + INTERVAL 22 HOUR AS t2, l_quantity AS amount, l_tax AS rate, lower({_pick(ORDERS, "l_orderkey % 4")}) AS ord FROM li WHERE hadm_id % 2 = 0 AND l_returnflag IN ('A', 'R'))"""
_has = lambda *words: "(" + " OR ".join(f"contains(ord, '{w}')" for w in words) + ")::INT"
_where = lambda unit, t: f"{int(unit == 'ICU')} + {int(unit == 'ED')} + hour({t}) + isodow({t}) - 1"
_items = lambda names: ", ".join(map(str, names))
_specs = "(VALUES " + ", ".join(f"('lab', {i}, {h}, '{op}')" for _, i, h, op in clinical.LAB_EXTREMES) + ", " + ", ".join(f"('chart', {i}, {h}, '{op}')" for _, i, h, op in clinical.VITAL_EXTREMES) + ") s(kind, itemid, h, op)"
_TRACE = f"""WITH {_BASE}, readings AS (SELECT 'lab' AS kind, hadm_id, itemid, t, v FROM lab UNION ALL SELECT 'chart', hadm_id, itemid, t, v FROM chart),
hist AS (SELECT *, lag(t) OVER w AS old_t, lag(v) OVER w AS old FROM readings WHERE (kind = 'lab' AND itemid IN ({_items(clinical.LABS)})) OR (kind = 'chart' AND itemid IN ({_items(clinical.SCORES)})) WINDOW w AS (PARTITION BY kind, hadm_id, itemid ORDER BY t, v)),
near AS (SELECT rid, s.t - old_t <= to_hours(CASE WHEN kind = 'lab' THEN 24 ELSE 12 END) AS both_near, v, v - old AS change, row_number() OVER (PARTITION BY rid, kind, h.itemid ORDER BY h.t DESC, v DESC) AS k
  FROM spans s JOIN hist h ON s.hadm_id = h.hadm_id AND h.t <= s.t AND s.t - h.t <= to_hours(CASE WHEN kind = 'lab' THEN 24 ELSE 12 END) WHERE flag = 'A'),
state AS (SELECT rid, count(*) + count(change) FILTER (both_near) AS n, sum(v) + coalesce(sum(change) FILTER (both_near), 0) AS total FROM near WHERE k = 1 GROUP BY 1),
ext AS (SELECT rid, x.itemid, CASE WHEN op = 'max' THEN max(v) ELSE min(v) END AS v FROM spans s JOIN readings r ON s.hadm_id = r.hadm_id AND r.t <= s.t JOIN {_specs.replace(") s(", ") x(")} ON x.kind = r.kind AND x.itemid = r.itemid AND s.t - r.t <= to_hours(h) WHERE flag = 'A' GROUP BY rid, x.itemid, op),
exts AS (SELECT rid, count(*) AS n, sum(v) AS total FROM ext GROUP BY 1),
hours AS (SELECT hadm_id, date_trunc('hour', t) AS h, itemid, t, max(v) AS v FROM chart WHERE itemid IN ({_items(clinical.CORE_VITALS)}) GROUP BY ALL),
ev AS (
  SELECT hadm_id, 'ED_Arrival' AS activity, admittime - INTERVAL 12 HOUR AS ts, 0 AS sensors, 0::DOUBLE AS total FROM adm UNION ALL SELECT hadm_id, 'ED_Departure', admittime, 0, 0 FROM adm
  UNION ALL SELECT hadm_id, 'Triage_Assessment', admittime - INTERVAL 719 MINUTE, 8 + (hadm_id % 2 > 0)::INT + (hadm_id % 5 > 0)::INT, 36 + hadm_id % 3 + 80 * (hadm_id % 2) + 98 + 120 + 80 + hadm_id % 5 + {_where("ED", "admittime - INTERVAL 719 MINUTE")} FROM adm
  UNION ALL SELECT hadm_id, 'ED_Vital_Measurement', o_orderdate, 5 + (o_orderkey % 3 > 0)::INT, 70 + o_orderkey % 3 + {_where("ED", "o_orderdate")} FROM o
  UNION ALL SELECT hadm_id, 'ED_Medication_Dispensed', o_orderdate, 0, 0 FROM o WHERE o_orderstatus = 'F'
  UNION ALL SELECT hadm_id, 'Hospital_Admission', admittime, 0, 0 FROM adm UNION ALL SELECT hadm_id, 'Hospital_Discharge', dischtime, 0, 0 FROM adm
  UNION ALL SELECT hadm_id, 'Transfer_' || o_orderstatus, o_orderdate, 0, 0 FROM o WHERE o_orderstatus <> 'P'
  UNION ALL SELECT hadm_id, 'ICU_Admission', admittime, 0, 0 FROM adm WHERE hadm_id % 2 = 0 UNION ALL SELECT hadm_id, 'ICU_Discharge', dischtime, 0, 0 FROM adm WHERE hadm_id % 2 = 0
  UNION ALL SELECT hadm_id, 'ICU_Vital_Measurement', h, count(*) + 4, sum(v) + {_where("ICU", "h")} FROM hours GROUP BY hadm_id, h
  UNION ALL SELECT hadm_id, 'START ' || {_super}, t, CASE WHEN flag = 'A' THEN 2 + 4 + 4 + coalesce(s.n, 0) + coalesce(e.n, 0) ELSE 0 END,
    CASE WHEN flag = 'A' THEN amount + rate + coalesce(s.total, 0) + coalesce(e.total, 0) + {_where("ICU", "t")} + {_has("continuous", "drip")} + {_has("push")} + {_has("bolus")} + {_has("oral", "po ", "non iv")} ELSE 0 END FROM spans LEFT JOIN state s USING (rid) LEFT JOIN exts e USING (rid)
  UNION ALL SELECT hadm_id, 'END ' || {_super}, t2, 0, 0 FROM spans
  UNION ALL SELECT hadm_id, 'ICU_Output_Measurement', l_shipdate, 0, 0 FROM li WHERE l_returnflag = 'N' AND hadm_id % 2 = 0
  UNION ALL SELECT hadm_id, 'Lab_Results_Received', date_trunc('hour', t), 1, count(*) FROM lab GROUP BY 1, 3
  UNION ALL SELECT hadm_id, CASE o_orderstatus WHEN 'F' THEN 'START ' WHEN 'O' THEN 'END ' ELSE '' END || 'MEDICATION_OTHER', o_orderdate, 0, 0 FROM o
  UNION ALL SELECT hadm_id, 'Microbiology_Result', o_orderdate, 0, 0 FROM o WHERE o_orderstatus = 'O'
) SELECT CAST(hadm_id AS VARCHAR) AS case_id, activity, count(*) AS n, CAST(sum(sensors) AS BIGINT) AS sensors, round(sum(total), 2) AS total, strftime(min(ts), '%Y-%m-%d %H:%M') AS first FROM ev GROUP BY 1, 2"""

_ORDER = f"""WITH {_BASE}, ev AS (
  SELECT 0 AS kind, hadm_id, 'ED_Arrival' AS activity, admittime - INTERVAL 12 HOUR AS ts, 0 AS own FROM adm UNION ALL SELECT 1, hadm_id, 'ED_Departure', admittime, 0 FROM adm
  UNION ALL SELECT 2, hadm_id, 'Triage_Assessment', admittime - INTERVAL 719 MINUTE, 4 + (hadm_id % 2 > 0)::INT + (hadm_id % 5 > 0)::INT FROM adm
  UNION ALL SELECT 3, hadm_id, 'Hospital_Admission', admittime, 0 FROM adm UNION ALL SELECT 4, hadm_id, 'Hospital_Discharge', dischtime, 0 FROM adm
  UNION ALL SELECT 5, hadm_id, 'Transfer_' || o_orderstatus, o_orderdate, 0 FROM o WHERE o_orderstatus <> 'P'
  UNION ALL SELECT 6, hadm_id, 'ICU_Admission', admittime, 0 FROM adm WHERE hadm_id % 2 = 0 UNION ALL SELECT 7, hadm_id, 'ICU_Discharge', dischtime, 0 FROM adm WHERE hadm_id % 2 = 0
) SELECT CAST(hadm_id AS VARCHAR) AS case_id, row_number() OVER w - 1 AS seq, activity, 'complete' AS lifecycle, round(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9, 0), 4) AS hours,
round(greatest(0, (epoch_us(ts) - epoch_us(admittime)) / 3.6e9), 4) AS since, CASE WHEN activity = 'Hospital_Discharge' THEN CASE WHEN hadm_id % 4 = 0 THEN 'deceased' ELSE 'alive' END END AS outcome, own + 3 AS sensors
FROM ev JOIN adm USING (hadm_id) WINDOW w AS (PARTITION BY hadm_id ORDER BY ts, kind, activity)"""

_category = _pick([*CATEGORIES, None], "itemid")
_ATTRIBUTES = f"""WITH {_BASE}, tests AS (SELECT hadm_id, t, list(CASE WHEN itemid <= 4 THEN 'item no ' || itemid ELSE 'lab_' || itemid END ORDER BY t, itemid)[1:20] AS names, bool_or(flagged) AS flagged FROM lab GROUP BY 1, 2),
rows AS (
  SELECT 'Lab_Results_Received' AS activity, NULL AS item, NULL AS category, CASE WHEN flagged THEN 'abnormal' END AS flags, array_to_string(names, ';') AS tests, NULL AS measured FROM tests
  UNION ALL SELECT unnest(['START ', 'END ']) || {_super}, CASE WHEN itemid <= 4 THEN 'item no ' || itemid ELSE 'item_' || itemid END, {_category}, NULL, NULL, NULL FROM spans WHERE flag = 'A'
  UNION ALL SELECT 'ICU_Output_Measurement', NULL, NULL, NULL, NULL, CASE WHEN l_partkey % 6 <= 4 THEN 'item no ' || (l_partkey % 6) ELSE 'item_' || (l_partkey % 6) END FROM li WHERE l_returnflag = 'N' AND hadm_id % 2 = 0
  UNION ALL SELECT unnest(['ICU_Admission', 'ICU_Discharge']), NULL, NULL, NULL, NULL, NULL FROM adm WHERE hadm_id % 2 = 0
) SELECT *, count(*) AS n FROM rows GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (clinical_trace, clinical_order, clinical_attributes)}
ORACLES = {"clinical_trace": _TRACE, "clinical_order": _ORDER, "clinical_attributes": _ATTRIBUTES}
