"""Parts that SQL cannot express, against small expectations."""

import math
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemend.functions import columns as C
from tracemend.operators import autoencoder, calibration, clusters, cooccurrence, discovery, drift, features, inject, metrics, prefixes, sequence, temporal
from tracemend.plans import clinical as clinical_plans
from tracemend.plans import models
from tracemend.schema import from_events
from tracemend.sources import clinical, syscalls, tables, xes
from tracemend.streaming import cases, snapshot

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def small_log(spark, n=200):
    draw = random.Random(1)
    return spark.createDataFrame([(i, f"c{i % 7}", draw.choice("abc") if i % 10 != 7 else None, datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(n)], "seq long, case_id string, activity string, ts timestamp")


@pytest.mark.parametrize(("text", "want"), [("2024-01-02T03:04:05.123+02:00", datetime(2024, 1, 2, 3, 4, 5, 123000)), ("2024-01-02T03:04:05Z", datetime(2024, 1, 2, 3, 4, 5)), ("2024-01-02 03:04:05", datetime(2024, 1, 2, 3, 4, 5)), ("2024/01/02 03:04:05.500", datetime(2024, 1, 2, 3, 4, 5, 500000)), ("no time", None)])
def test_timestamps_lose_their_zone(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(C.naive_timestamp(F.col("t"))).first()[0] == want


def test_text_functions(spark):
    t = spark.createDataFrame([("['a', 'b']", "nan"), ("zz", " x "), (None, None)], "a string, b string").select(C.text_list(F.col("a")).alias("l"), C.is_null_text(F.col("b")).alias("n"))
    assert [(r["l"], r["n"]) for r in rows(t)] == [(["a", "b"], True), ([], False), ([], True)]


def test_autoencoder_gradients():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(8, 5))
    m = autoencoder.fit(x, latent=3, hidden=4, epochs=1)
    _, gw, _ = m.loss_and_gradients(x, x, 0.01)
    for i in range(4):
        w, e = m.weights[i], 1e-6
        w[0, 0] += e
        up = m.loss_and_gradients(x, x, 0.01)[0]
        w[0, 0] -= 2 * e
        down = m.loss_and_gradients(x, x, 0.01)[0]
        w[0, 0] += e
        assert abs((up - down) / (2 * e) - gw[i][0, 0]) < 1e-5


def test_autoencoder_learns(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 2)) @ draw.normal(size=(2, 10))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "seq long, x array<double>")
    errors = [np.mean([r["error"] for r in rows(autoencoder.encode(df, autoencoder.train(df, epochs=e)))]) for e in (1, 60)]
    assert errors[1] < 0.5 * errors[0]


def test_clusters_merge_and_find_their_points(spark):
    draw = np.random.default_rng(4)
    pts = [(i, i % 3, (draw.normal(size=4) + 6 * (i % 3)).tolist()) for i in range(90)]
    df = spark.createDataFrame(pts, "vec_id long, label int, z array<double>")
    halves = [clusters.sufficient(df.where(F.col("vec_id") % 2 == r)) for r in (0, 1)]
    key = lambda d: sorted((r["label"], r["i"], r["n"], round(r["s"], 6), round(r["q"], 6)) for r in rows(d))
    assert key(clusters.merge(*halves)) == key(clusters.sufficient(df))
    full = clusters.full_distances(df, clusters.full_clusters(df))
    best = {r["vec_id"]: r["label"] for r in rows(clusters.confidence(clusters.memberships(full), "plain"))}
    assert all(best[i] == label for i, label, _ in pts)
    assert sum(r["u"] for r in rows(clusters.memberships(full))) == pytest.approx(90)


def test_shrinkage_lies_between():
    x = np.random.default_rng(5).normal(size=(6, 4))
    s = clusters.shrunk_covariance(x)
    assert np.all(np.linalg.eigvalsh(s) > 0) and np.trace(s) == pytest.approx(np.trace(np.cov(x.T, bias=True)))


def test_adaptive_window():
    draw = random.Random(6)
    w = drift.AdaptiveWindow()
    calm = [w.add(draw.gauss(0, 1)) for _ in range(3000)]
    moved = [w.add(draw.gauss(3, 1)) for _ in range(600)]
    assert sum(calm) <= 1 and any(moved[:200]) and len(w.buckets) < 80
    assert abs(w.totals()[1] / w.totals()[0] - 3) < 0.5


def test_drift_by_key(spark):
    draw = random.Random(7)
    data = [(k, i, draw.gauss(5 if k == "b" and i > 800 else 0, 1)) for k in "ab" for i in range(1500)]
    got = rows(drift.detect(spark.createDataFrame(data, "k string, i long, v double").repartition(3), "k", "i", "v"))
    assert {r["k"] for r in got} == {"b"} and all(800 < r["i"] < 1000 for r in got[:1])


def test_drift_rules(spark):
    t = spark.range(4).select(drift.severity(F.col("id")).alias("s"), drift.combined({"a": F.col("id") > 0, "b": F.col("id") > 2}, "majority").alias("m"), drift.combined({"a": F.col("id") > 0, "b": F.col("id") > 2}, "all").alias("x"))
    assert [(r["s"], r["m"], r["x"]) for r in rows(t)] == [("none", False, False), ("low", False, False), ("medium", False, False), ("high", True, True)]


def test_discovery(spark):
    draw = np.random.default_rng(8)
    z = [(i, (draw.normal(scale=0.2, size=3) + [10 * (i % 2), 0, 0]).tolist()) for i in range(60)] + [(99, [50.0, 50.0, 50.0])]
    df = spark.createDataFrame(z, "seq long, z array<double>").repartition(3)
    got = rows(discovery.discover(df, np.array([[10.0, 0, 0]]), radius=2.0))
    assert [(r["label"], r["n"]) for r in got] == [("UNDISCOVERED_1", 30)]
    d = spark.createDataFrame([("UNDISCOVERED_1", "known", 1.5), ("UNDISCOVERED_1", "other", 1.2), ("a", "b", 0.1)], "a string, b string, distance double")
    n = spark.createDataFrame([("UNDISCOVERED_1", 30), ("known", 40), ("other", 5)], "label string, n long")
    merged = discovery.reconcile(d, n)
    assert rows(merged) == [{"label": "UNDISCOVERED_1", "into": "known"}]
    res = spark.createDataFrame([(1, "UNDISCOVERED_1", "RECOVERED_ML"), (2, "known", "NORMAL")], "seq long, recovered string, provenance string")
    assert {(r["seq"], r["recovered"], r["reconciled_from"]) for r in rows(discovery.corrected(res, merged))} == {(1, "known", "UNDISCOVERED_1"), (2, "known", None)}


def test_calibration(spark):
    draw = random.Random(9)
    df = spark.createDataFrame([(c := draw.random(), int(draw.random() < c)) for _ in range(2000)], "c double, r int")
    a, b = calibration.platt(df, "c", "r")
    assert a > 3 and b < 0
    assert calibration.platt(df.where("r = 1"), "c", "r") == (1.0, 0.0)
    assert calibration.isotonic(df, "c", "r").boundaries is not None
    logits = spark.createDataFrame([([4.0, 0.0, 0.0], y) for y in (0, 0, 1, 0)], "s array<double>, y int")
    assert calibration.temperature(logits, "s", "y") > 1.5
    p = logits.select(calibration.softmax(F.col("s"), 1.0, (2,)).alias("p")).first()["p"]
    assert p[2] == 0 and sum(p) == pytest.approx(1)


def test_sequence_model_learns_a_rule(spark):
    data = [(i, f"c{i % 5}", "abc"[(i // 5) % 3] if (i // 5) % 6 != 5 or i < 100 else None, datetime(2024, 1, 1)) for i in range(600)]
    log = spark.createDataFrame(data, "seq long, case_id string, activity string, ts timestamp")
    ex = sequence.examples(log, 2)
    got = rows(sequence.rescue(ex, sequence.train(ex, 3), 0.5))
    assert got and np.mean([r["class"] == 2 for r in got]) > 0.9


def test_embeddings(spark):
    log = small_log(spark)
    v = cooccurrence.embed(cooccurrence.ppmi(cooccurrence.pair_counts(log)), 4)
    assert set(v) == {"a", "b", "c"} and all(len(x) == 4 for x in v.values())
    assert cooccurrence.word2vec(log).count() == 3


def test_mask_and_metrics(spark):
    log = small_log(spark).withColumn("truth", F.col("activity"))
    masked = inject.apply_mask(log, inject.mask_share(log, 0.2, 3))
    assert masked.where("activity is null and truth is not null").count() == int(180 * 0.2)
    got = metrics.accuracy(prefixes.repair(masked, ["a", "b", "c"], 1, 0.0, 1)).first()
    assert got["total"] == 36 and got["tp"] + got["fp"] + got["abstained"] == 36


def test_as_of_against_brute_force(spark):
    draw = random.Random(10)
    left = [(draw.choice("xy"), datetime(2024, 1, 1) + timedelta(minutes=draw.randrange(5000)), i) for i in range(80)]
    right = [(draw.choice("xy"), datetime(2024, 1, 1) + timedelta(minutes=draw.randrange(5000)), float(i) if i % 9 else None) for i in range(60)]
    got = rows(temporal.as_of(spark.createDataFrame(left, "k string, ts timestamp, i int"), spark.createDataFrame(right, "k string, ts timestamp, v double"), "k", "ts", "v", 10))
    assert len(got) == 80
    for r in got:
        past = [(t, v) for k, t, v in right if k == r["k"] and t <= r["ts"] and v is not None]
        newest = max(past, default=None)
        want = newest[1] if newest and r["ts"] - newest[0] <= timedelta(hours=10) else None
        assert r["last_v"] == want or (newest and sum(t == newest[0] for t, _ in past) > 1)


def test_stream_repair_by_micro_batches(spark, tmp_path):
    """Batches of one event give what the causal batch query gives."""
    log = small_log(spark, 40)
    target = snapshot.SnapshotRepair(spark, f"file://{tmp_path}/s", order=1, dominance=0.4, support=2)
    for n, lo in enumerate(range(0, 40, 8)):
        target(log.where(f"seq >= {lo} and seq < {lo + 8}"), n)
    got = {r["seq"]: r for r in rows(target.results())}
    want = {r["seq"]: r for r in rows(log)}
    assert len(got) == 40 and all(got[s]["recovered"] == w["activity"] for s, w in want.items() if w["activity"])
    assert all(got[s]["provenance"] in ("RECOVERED_ML_SEQ", "UNRECOVERED_ML") for s, w in want.items() if not w["activity"])
    again = {r["seq"]: r for r in rows(target.results())}
    target(log.where("seq >= 32"), 4)  # a batch that runs again writes the same
    assert {r["seq"]: r for r in rows(target.results())} == again


@pytest.mark.parametrize("n", [289, 300])
def test_decay_by_additions(spark, n):
    """Against the sequential rule: masked events don't count, and a pair that lapses and comes back starts from 0."""
    draw = random.Random(7)
    data = [(i, "c", None if i % 10 == 7 else "z" if i in (3, 4, 260, 261) else draw.choice("ab")) for i in range(n)]
    table, added, last = {}, 0, ""
    for _, _, a in data:
        if a:
            table[last, a] = table.get((last, a), 0.0) + 1
            added += 1
            if added % 9 == 0:
                table = {k: v * 0.9 for k, v in table.items() if v * 0.9 >= 0.1}
        last = a or "?"
    df = spark.createDataFrame(data, "seq long, case_id string, activity string")
    got = {(r["prefix"], r["activity"]): r["weight"] for r in rows(prefixes.decayed_by_additions(df, 1, 9, 0.9, 0.1))}
    assert got.keys() == table.keys() and all(abs(got[k] - v) < 1e-5 for k, v in table.items())


def by_pieces(events, cuts, order=2, dominance=0.25, support=5):
    """The repair of rows (seq, case_id, activity) piece by piece, each with the counts and tails of those before."""
    counts, tails, want = {}, {}, {}
    for lo, hi in zip([-math.inf, *cuts], [*cuts, math.inf], strict=True):
        new = []
        for seq, case, activity in sorted(e for e in events if lo <= e[0] < hi):
            tail = tails.setdefault(case, [])
            prefix = ">".join(([""] * order + tail)[-order:])
            tail.append(activity or "?")
            if activity:
                want[seq] = activity
                new.append((prefix, activity))
            else:
                n, best = max(((n, a) for a, n in counts.get(prefix, {}).items()), default=(0, None))
                total = sum(counts.get(prefix, {}).values())
                want[seq] = best if total >= support and n >= dominance * total else None
        for prefix, activity in new:
            mine = counts.setdefault(prefix, {})
            mine[activity] = mine.get(activity, 0) + 1
    return want


@pytest.mark.parametrize("parts", [1, 5])
def test_registered_stream_repairs_by_pieces(spark, tmp_path, parts):
    """A table of one file or of part files in no order: labels are recovered, and are those of the batch form."""
    draw = random.Random(2)
    data = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), draw.randrange(12), "abcd"[(i // 12 + draw.randrange(2)) % 4], 1.0, "{}") for i in range(900)]
    draw.shuffle(data)
    df = spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.repartition(parts).write.parquet(f"file://{tmp_path}/events.parquet")
    got = {r["seq"]: r for r in rows(models.stream_repair_snapshot(spark, f"file://{tmp_path}"))}
    cuts = snapshot.bounds(from_events(spark, f"file://{tmp_path}"))
    want = by_pieces([(i, str(u), a if i % 10 != 7 else None) for i, _, u, a, *_ in data], cuts)
    assert len(cuts) == snapshot.LEAST_PIECES - 1 and {s: r["recovered"] for s, r in got.items()} == want
    assert sum(r["provenance"] == "RECOVERED_ML_SEQ" for r in got.values()) > 40


def test_registered_stream_of_no_events(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"file://{tmp_path}/events.parquet")
    assert rows(models.stream_repair_snapshot(spark, f"file://{tmp_path}")) == []


def test_case_state_on_a_stream(spark, tmp_path):
    log = small_log(spark, 60)
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = cases.with_state(spark.readStream.schema(cases.FIELDS).parquet(f"{tmp_path}/in"), 2)
    run = q.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["seq"]: r for r in rows(spark.read.parquet(f"{tmp_path}/out"))}
    seen: dict = {}
    for r in sorted(rows(log), key=lambda r: r["seq"]):
        before = seen.setdefault(r["case_id"], [])
        assert got[r["seq"]]["prefix"] == ">".join((["", ""] + before)[-2:]) and got[r["seq"]]["so_far"] == len(before)
        before.append(r["activity"] or "?")


XES = """<?xml version="1.0"?><log><trace><string key="concept:name" value="case1"/>
<event><string key="concept:name" value="start"/><date key="time:timestamp" value="2024-01-01T10:00:00.000+01:00"/><int key="cost" value="3"/>
<list key="stream:datastream"><list key="stream:point" stream:source="oven" stream:id="temp"><string key="stream:value" value="21.5"/></list>
<list key="stream:point" stream:system="belt" stream:observation="http://x#speed"><string key="stream:value" value="fast"/></list></list></event>
<event><string key="concept:name" value=" "/><date key="time:timestamp" value="2024-01-01T09:00:00Z"/></event></trace></log>"""


def test_xes(spark, tmp_path):
    (tmp_path / "a.xes").write_text(XES)
    got = sorted(rows(xes.ordered(xes.read_xml(spark, str(tmp_path)))), key=lambda r: r["seq"])
    assert [(r["seq"], r["case_id"], r["activity"]) for r in got] == [(0, "case1", None), (1, "case1", "start")]
    assert got[1]["ts"] == datetime(2024, 1, 1, 10) and got[1]["attributes"] == {"cost": "3"}
    assert got[1]["sensors"] == {"oven/temp": 21.5} and got[1]["sensors_raw"] == {"oven/temp": "21.5", "belt/speed": "fast"}


def test_xes_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.xes.yaml").write_text("log:\n  trace:\n    concept:name: c9\n---\nevent:\n  concept:name: go\n  time:timestamp: '2024-01-01T10:00:00'\n  cost: 4\n  stream:datastream:\n  - stream:point: {stream:source: s, stream:id: t, stream:value: 1.5}\n---\nevent:\n  concept:name: stop\n")
    got = rows(xes.read_yaml(spark, str(tmp_path)))
    assert [(r["case_id"], r["activity"]) for r in got] == [("c9", "go"), ("c9", "stop")]
    assert got[0]["sensors"] == {"s/t": 1.5} and got[0]["attributes"] == {"cost": "4"}


def test_csv_logs(spark, tmp_path):
    (tmp_path / "w.csv").write_text("seq,case_id,activity,timestamp,attr_a,sensor_s\n1,c,go,2024-01-01T00:00:00,x,2.5\n2,c,,,,bad\n")
    got = rows(tables.read_wide_csv(spark, str(tmp_path / "w.csv")))
    assert [(r["activity"], r["attributes"], r["sensors"]) for r in got] == [("go", {"a": "x"}, {"s": 2.5}), (None, {}, {})]
    (tmp_path / "t.csv").write_text("Case ID,Activity,Complete Timestamp,Variant.1,Seriousness\n7,open,2024/01/01 00:00:00.000,v,high\n")
    got = rows(tables.read_ticket_csv(spark, str(tmp_path / "t.csv"), {"Case ID": "case_id", "Activity": "activity", "Complete Timestamp": "timestamp"}, ("Variant.1",)))
    assert [(r["case_id"], r["activity"], r["ts"], r["attributes"]) for r in got] == [("7", "open", datetime(2024, 1, 1), {"Seriousness": "high"})]
    tables.write_log(tables.read_wide_csv(spark, str(tmp_path / "w.csv")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/events")).count() == 2


def test_syscalls(spark):
    df = spark.createDataFrame([("1", "open", "0", "yes", "2024-01-01 00:00:00", "3", "['a','b']"), ("1", "read", "0", None, "2024-01-01 00:00:01", "0", "")], "pid string, syscall string, uid string, success string, time string, n string, args string")
    got = rows(syscalls.from_audit(df, ["n"], ["args"]))
    assert [(r["activity"], r["sensors"]) for r in got] == [("open_0_yes", {"counter/n": 3.0, "list/args": 2.0}), (None, {})]


def test_super_categories_are_looked_up_as_written(spark):
    some = spark.createDataFrame([("Antibiotics",), ("antibiotics",), (None,), ("General",), ("CVL Insertion",), ("new",)], "c string")
    got = {r["c"]: r["super"] for r in clinical.super_category(F.col("c"), clinical.mapping_table(spark), some).collect()}
    assert got == {"Antibiotics": "MEDICATION_ABX", "antibiotics": "OTHER_TREATMENT", None: "OTHER_TREATMENT", "General": "OTHER_TREATMENT", "CVL Insertion": "VASCULAR_ACCESS", "new": "OTHER_TREATMENT"}


def test_clinical_tables_are_joined_once(spark):
    """Infusions, outputs and readings are read once each, whatever they make."""
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    plan = clinical_plans.clinical_attributes(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 3


def test_both_ends_of_an_infusion(spark):
    """An end needs both times; at one time a start comes first, and an input before a procedure."""
    icu = spark.createDataFrame([(1, 10)], "stay_id long, hadm_id long")
    spans = "stay_id long, itemid long, starttime string, endtime string"
    when = lambda rows: spark.createDataFrame(rows, spans).withColumns({c: F.col(c).cast("timestamp") for c in ("starttime", "endtime")})
    a, b = "2024-01-01 01:00:00", "2024-01-01 02:00:00"
    tables = {"icustays": icu.withColumns({"intime": F.lit(None).cast("timestamp"), "outtime": F.lit(None).cast("timestamp")}), "inputevents": when([(1, 1, a, a), (1, 2, b, None), (1, 3, None, b)]), "procedureevents": when([(1, 4, a, b)])}
    got = [(r["activity"][:5].strip(), r["attributes"]["item_label"], r["lifecycle"], r["ts"].hour) for r in clinical.stays(tables, optional=frozenset({"infusion_ends"})).orderBy("seq").collect()]
    assert got == [("START", "item_1", "start", 1), ("END O", "item_1", "complete", 1), ("START", "item_4", "start", 1), ("START", "item_2", "start", 2), ("END O", "item_4", "complete", 2)]
    assert clinical.stays(tables).where("activity like 'END%'").count() == 1


def test_clinical_log(spark):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    make = lambda data, schema: spark.createDataFrame(data, schema)
    got = clinical.stays({
        "admissions": make([(1, t(2), t(20))], "hadm_id long, admittime timestamp, dischtime timestamp"),
        "edstays": make([(1, 5, t(0), t(2))], "hadm_id long, stay_id long, intime timestamp, outtime timestamp"),
        "triage": make([(5, 37.0, 0.0, None, 99.0, 120.0, 80.0)], "stay_id long, temperature double, heartrate double, resprate double, o2sat double, sbp double, dbp double"),
        "icustays": make([(1, 9, t(3), t(10))], "hadm_id long, stay_id long, intime timestamp, outtime timestamp"),
        "chartevents": make([(9, 220045, t(4, 5), 80.0), (9, 220045, t(4, 50), 85.0), (9, 1, t(4), 1.0)], "stay_id long, itemid long, charttime timestamp, valuenum double"),
        "inputevents": make([(9, 7, t(5), t(6))], "stay_id long, itemid long, starttime timestamp, endtime timestamp"),
        "d_items": make([(7, "Antibiotics")], "itemid long, category string"),
    }, make([("Antibiotics", "ANTI")], "category string, super string"))
    got = sorted(rows(got), key=lambda r: r["seq"])
    assert [r["activity"] for r in got] == ["ED_Arrival", "Triage_Assessment", "ED_Departure", "Hospital_Admission", "ICU_Admission", "ICU_Vital_Measurement", "START ANTI", "ICU_Discharge", "Hospital_Discharge"]
    assert got[1]["sensors"] == {"vital/temperature": 37.0, "vital/o2sat": 99.0, "vital/sbp": 120.0, "vital/dbp": 80.0} and len(got[5]["sensors"]) == 2
    starts = make([(1, t(5))], "hadm_id long, ts timestamp")
    labs = make([(1, 11, t(4), 2.5), (1, 11, t(1), 9.0)], "hadm_id long, itemid long, charttime timestamp, valuenum double")
    assert clinical.with_snapshots(starts, labs, [11], 24).first()["lab_11"] == 2.5


def test_arbitration(spark):
    label, conf = clusters.arbitrate(F.col("a"), F.col("x"), F.col("b"), F.col("y"), alpha=0.5, alpha_other=0.6)
    t = spark.createDataFrame([("p", 0.55, "q", 0.9), ("p", 0.9, "q", 0.95), ("p", 0.2, "q", 0.1)], "a string, x double, b string, y double").select(label.alias("l"), conf.alias("c"))
    assert [r["l"] for r in rows(t)] == ["q", "p", None]


def test_warmup_end(spark):
    data = [(i, "c", "abcde"[min(i // 10, 4)] if i < 300 else "e") for i in range(900)]
    assert features.warmup_end(spark.createDataFrame(data, "seq long, case_id string, activity string")).first()[0] == 900 + 100


def test_payload_cells_are_those_of_the_plain_functions(spark):
    """Numbers and hashes, for hashes of any width."""
    from tracemend.functions import columns as C
    from tracemend.operators import payload

    texts = ["12", " -1.5e2 ", "yes", "['a', 'b']", "{'a': '1'}", "", "NaN", "inf", "+.5", "0x", "né", None, "n", "x" * 300]
    log = spark.createDataFrame([(i, {"a": t} if i else {}) for i, t in enumerate(texts)], "seq long, attributes map<string,string>")
    for size in (4, 7, 8, 16):
        got = {r["seq"]: r["payload"] for r in payload.payload(log, ["a", "b"], size).collect()}
        v, keys = F.try_element_at("attributes", F.lit("a")), F.array_join(F.map_keys("attributes"), "|")
        want = log.where("seq > 0").select("seq", v.try_cast("double").alias("n"), C.hash_vector(F.substring(F.coalesce(v, F.lit("None")), 1, 200), size).alias("h"), C.hash_vector(keys, size).alias("k")).collect()
        for r in want:
            p = got[r["seq"]]
            assert p[6 : 6 + size] == r["h"] and p[6 + size : 6 + 2 * size] == [0.0] * size and p[6 + 2 * size : 6 + 3 * size] == r["k"] and p[-1] == 1.0
            assert p[4] == float(r["n"] is not None or (texts[r["seq"]] or "")[:1] in ("[", "{")) and (r["n"] is None or repr(p[2]) == repr(r["n"]))
        assert got[0] == [0.0] * len(got[0])


def test_payload_vectors_are_made_once(spark):
    """No filter of the exploded vectors makes each of them once more."""
    from tracemend.plans import extras

    plan = extras.payload_vectors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and "Filter" not in plan
