"""The cascade on a planted log, running sums in blocks, discovery without caps, settings, and finding of files."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemend import config
from tracemend.operators import autoencoder, cascade, clusters, discovery, drift, evaluation, metrics, payload, running
from tracemend.operators.cascade import Gates
from tracemend.sources import clinical, files, xes


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def planted(spark, n=3000):
    """Labels follow each other in a ring, mostly; vectors lie near their label's place; one label in eight is gone."""
    draw = random.Random(3)
    at, out = {}, []
    for i in range(n):
        case = draw.randrange(9)
        k = at[case] = (at.get(case, 0) + (1 if draw.random() < 0.9 else 2)) % 4
        out.append((i, f"c{case}", "abcd"[k], None if draw.random() < 0.125 else "abcd"[k], [k % 2 + draw.gauss(0, 0.4), k // 2 + draw.gauss(0, 0.4)]))
    return spark.createDataFrame(out, "seq long, case_id string, truth string, activity string, z array<double>")


def test_the_cascade_beats_the_majority_label(spark):
    log = planted(spark)
    g = Gates(alpha_cluster=0.55, alpha_seq=0.7, margin=0.2, arbitration=True, agreement="topk", mode="plain", override=(0.85, 20), emit=(0.8, 20))
    got = cascade.cascade(log, list("abcd"), 2, g, warmup=200)
    assert got.count() == 3000
    f1 = metrics.accuracy(got.where("seq >= 200")).first()["f1"]
    gone = [r["truth"] for r in rows(log.where("activity is null and seq >= 200"))]
    majority = max(gone.count(a) for a in "abcd") / len(gone)
    assert f1 > 0.75 > 2 * majority
    steps = {r["step"] for r in rows(got.select("step").distinct())}
    assert {"given", "warm-up", "cluster", "rescued"} <= steps
    back = cascade.retro(log, list("abcd"), 2, g, 200, alpha_cluster=0.5)
    assert metrics.accuracy(back).first()["f1"] > 0.6 and back.count() == 200


def test_each_gate(spark):
    base = {"activity": None, "best": "a", "cluster_conf": 0.6, "cluster_margin": 0.3, "tops": ["a", "b"], "seq_label": "b", "seq_conf": 0.9, "cache_label": "c", "cache_dom": 0.5, "cache_sup": 100}
    schema = "activity string, best string, cluster_conf double, cluster_margin double, tops array<string>, seq_label string, seq_conf double, cache_label string, cache_dom double, cache_sup long"

    def step(gates, **changes):
        r = cascade.decide(spark.createDataFrame([tuple((base | changes).values())], schema), gates).first()
        return r["step"], r["recovered"], r["provenance"]

    g = Gates(alpha_seq=0.8)
    assert step(g, activity="z") == ("given", "z", "NORMAL")
    assert step(g) == ("cluster", "a", "RECOVERED_ML")
    assert step(g, cluster_conf=0.4) == ("rescued", "b", "RECOVERED_ML_SEQ")
    assert step(g, cluster_conf=0.4, seq_conf=0.5) == ("unsure", None, "UNRECOVERED_ML")
    assert step(g, cluster_conf=0.4, seq_conf=0.5, cache_dom=0.96) == ("counted", "c", "RECOVERED_ML_SEQ")
    assert step(g, cache_dom=0.92, seq_conf=0.5) == ("vetoed", None, "UNRECOVERED_ML")
    assert step(Gates(margin=0.5, alpha_seq=0.95)) == ("near tie", None, "UNRECOVERED_ML")
    assert step(Gates(arbitration=True, arbitration_margin=0.2, alpha_seq=0.8)) == ("arbitrated", "b", "RECOVERED_ML_SEQ")
    assert step(Gates(arbitration=True, arbitration_margin=0.05, alpha_seq=0.8)) == ("cluster", "a", "RECOVERED_ML")
    low = {"cluster_conf": 0.1}
    assert step(Gates(alpha_seq=0.8, agreement="argmax"), **low)[0] == "unsure"
    assert step(Gates(alpha_seq=0.8, agreement="argmax", agreement_override=0.9), **low)[0] == "rescued"
    assert step(Gates(alpha_seq=0.8, agreement="topk", agreement_k=1), **low)[0] == "unsure"
    assert step(Gates(alpha_seq=0.8, agreement="topk", agreement_k=2), **low)[0] == "rescued"
    assert step(Gates(alpha_seq=0.8, agreement="tiered", alpha_seq_high=0.95), **low)[0] == "unsure"
    assert step(Gates(alpha_seq=0.8, agreement="tiered", alpha_seq_high=0.85), **low)[0] == "rescued"
    assert step(g, best=None, tops=[], cluster_conf=0.0, cluster_margin=None, seq_label=None, cache_label=None) == ("unsure", None, "UNRECOVERED_ML")


@pytest.mark.parametrize(("block", "deep"), [(1, False), (7, False), (1000, False), (3, True), (1000, True)])
def test_running_sums_do_not_depend_on_blocks(spark, block, deep):
    draw = random.Random(4)
    data = [(i, draw.choice(["x", "y", None]), draw.choice([1, 2, None])) for i in range(120)]
    t = running.running_sums(spark.createDataFrame(data, "seq long, k string, v int").repartition(3), ["k"], "seq", {"before": F.col("v"), "n": F.lit(1)}, block, deep)
    got = {r["seq"]: (r["before"], r["n"]) for r in rows(t)}
    for i, k, _ in data:
        own = [v or 0 for j, q, v in data if j < i and q == k]
        assert got[i] == (sum(own), len(own))


def test_smallest_rows(spark):
    draw = random.Random(5)
    data = [(i, draw.random(), draw.choice("ab")) for i in range(300)] + [(300, 0.5, "a"), (301, 0.5, "a")]
    df = spark.createDataFrame(data, "seq long, u double, k string")
    for n in (0, 1, 150, 302, 400):
        assert {r["seq"] for r in rows(running.sure_cut(df, "u", "seq", n, 16))} == {i for i, *_ in sorted(data, key=lambda x: (x[1], x[0]))[:n]}
    quota = spark.createDataFrame([("a", 20), ("b", 1000)], "k string, quota long")
    got = rows(running.smallest_of_each(df, "k", "u", "seq", quota, 16))
    assert {r["seq"] for r in got if r["k"] == "a"} == {i for i, _, k in sorted(data, key=lambda x: (x[1], x[0])) if k == "a"} & {i for i, *_ in sorted((x for x in data if x[2] == "a"), key=lambda x: (x[1], x[0]))[:20]}
    assert sum(r["k"] == "b" for r in got) == sum(k == "b" for *_, k in data)


@pytest.mark.parametrize("parts", [1, 5])
def test_discovery_has_no_cap(spark, parts):
    draw = np.random.default_rng(9)
    centres = [(x * 10.0, y * 10.0) for x in range(28) for y in range(25)]
    pts = [(i, (np.array(centres[i % 700]) + draw.normal(scale=0.1, size=2)).tolist()) for i in range(3500)]
    got = discovery.discover(spark.createDataFrame(pts, "seq long, z array<double>").repartition(parts), np.array([[1000.0, 1000.0]]), radius=1.0, least=5, persist=5)
    assert got.count() == 700 and {r["n"] for r in rows(got)} == {5}


def test_drift_in_blocks_agrees_with_row_by_row(spark):
    draw = random.Random(8)
    data = [("k", i, draw.gauss(4 if i > 2000 else 0, 1)) for i in range(4000)]
    window, alarms = drift.AdaptiveWindow(), []
    for _, i, v in data:
        if window.add(v):
            alarms.append(i)
    got = [r["i"] for r in rows(drift.detect(spark.createDataFrame(data, "k string, i long, v double").repartition(4), "k", "i", "v"))]
    assert got and alarms and abs(min(got) - min(alarms)) <= 2 * drift.BLOCK


def test_settings():
    a, b = config.get("bpic2012"), config.get("nothing known", alpha=0.7)
    assert a["warmup_events"] == 40000 and a["latent_dim"] == 48 and a["enable_count_cache"] and b["alpha"] == 0.7 and b["warmup_events"] == 1000
    a["hidden_dims"].append(1)
    assert config.get("bpic2012")["hidden_dims"] == [256, 128] and len(config.LOGS) == 20
    assert config.gates(config.get("vienna")).alpha_seq == 0.30 and config.gates(config.get("mimiciv")).override is None
    assert config.path("/logs", "chess") == "/logs/chess/"


def test_files_are_found_by_name(spark, tmp_path):
    for name in ("b.xes", "a.xes", "deep/c.xes.yaml", "d.yaml.gz", "e.txt", "x.xes/x.xes"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("")
    got = [f.rpartition(str(tmp_path))[2] for f in files.find_logs(spark, f"file://{tmp_path}")]
    assert got == ["/deep/c.xes.yaml", "/a.xes", "/b.xes", "/x.xes/x.xes", "/d.yaml.gz"] and files.find_logs(spark, f"file://{tmp_path}/none") == []
    assert files.resolve(spark, f"file://{tmp_path}/x.xes").endswith("/x.xes/x.xes") and files.resolve(spark, f"file://{tmp_path}/a.xes").endswith("/a.xes")
    (tmp_path / "y.xes").mkdir()
    with pytest.raises(FileNotFoundError):
        files.resolve(spark, f"file://{tmp_path}/y.xes")
    (tmp_path / "y.xes.gz").write_text("")
    assert files.resolve(spark, f"file://{tmp_path}/y.xes").endswith("/y.xes.gz")
    assert xes.read_logs(spark, f"file://{tmp_path}/none").count() == 0


def test_long_yaml_logs_are_split(spark, tmp_path):
    text = "".join(f"---\nlog:\n  trace:\n    concept:name: t{c}\n" + "".join(f"---\nevent:\n  concept:name: a{k}\n  n: {k}\n" for k in range(40)) for c in range(30))
    (tmp_path / "long.yaml").write_text(text + "---\n- odd\n---\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = rows(xes.read_yaml(spark, f"file://{tmp_path}"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["case_id"], int(r["attributes"]["n"])) for r in got) == sorted((f"t{c}", k) for c in range(30) for k in range(40))


def test_runs_are_kept(spark, tmp_path):
    log = spark.createDataFrame([(i, "c", None if i % 7 == 0 else "ab"[i % 2]) for i in range(50)], "seq long, case_id string, truth string")
    with pytest.raises(FileNotFoundError):
        evaluation.load_run(spark, f"file://{tmp_path}", 0.2, 1)
    evaluation.keep_run(log, f"file://{tmp_path}", 0.2, 1)
    t = rows(evaluation.load_run(spark, f"file://{tmp_path}", 0.2, 1))
    known = sum(r["truth"] is not None for r in t)
    assert sum(r["injected"] for r in t) == int(known * 0.2) and all(r["activity"] is None or r["activity"] == r["truth"] for r in t)
    assert sorted(r["seq"] for r in rows(evaluation.load_run(spark, f"file://{tmp_path}", 0.2, 1, True))) == list(range(known))


def test_clinical_details(spark):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    make = lambda data, schema: spark.createDataFrame(data, schema)
    kinds = rows(make([("Continuous Med drip",), ("PO dose",), ("Polymer",), (None,)], "t string").select("t", clinical.order_kinds(F.col("t")).alias("k")))
    assert [sorted(k.partition("/")[2] for k, v in r["k"].items() if v) for r in kinds] == [["is_continuous"], ["is_oral"], [], []]
    twice = clinical.stays({
        "icustays": make([(1, 9, t(3), t(10))], "hadm_id long, stay_id long, intime timestamp, outtime timestamp"),
        "chartevents": make([(9, 220045, t(4, 5), 80.0), (9, 220045, t(4, 5), 82.0)], "stay_id long, itemid long, charttime timestamp, valuenum double"),
    })
    hour = next(r for r in rows(twice) if r["activity"] == "ICU_Vital_Measurement")
    assert list(hour["sensors"].values()) == [82.0] and hour["attributes"]["reading_count"] == "2"
    with pytest.raises(ValueError, match="no such part"):
        clinical.stays({"icustays": twice}, optional=frozenset({"nothing"}))
    assert len(clinical.mapping_table(spark).collect()) == 83


def test_a_repeated_reading_is_no_change(spark):
    """Two readings of one time and value: the change is from the one before both."""
    t = lambda h: datetime(2024, 1, 1, h)
    starts = spark.createDataFrame([(1, t(9), "s")], "key long, ts timestamp, name string")
    for values in ([5.0, 7.0, 7.0], [5.0, 7.0, 7.0, 7.0]):
        seen = spark.createDataFrame([(1, t(5 + (v > 5)), 50912, v) for v in values], "key long, ts timestamp, itemid long, value double")
        got = clinical.seen_before(starts, seen, {50912: "Creatinine"}, 24, ("lab_state", "lab_delta")).first()["snapshot"]
        assert got == {"lab_state/Creatinine": 7.0, "lab_delta/Creatinine": 2.0}


def test_rounding_as_sql(spark):
    """1.22575 lies under the half, as a binary number times 10000 shows."""
    from tracemend.functions import columns as C

    t = spark.createDataFrame([(1.22575,), (-1.22575,), (0.5,), (None,)], "d double")
    assert [r[0] for r in t.select(C.rounded(F.col("d"), 4)).collect()] == [1.2257, -1.2257, 0.5, None]


def test_a_part_is_one_file(spark, tmp_path):
    """However many tasks hold rows of it."""
    files.write_batches(spark.range(1000).withColumnRenamed("id", "k").repartition(7), "k", 40, f"file://{tmp_path}/parts")
    found = [p for p in (tmp_path / "parts").rglob("*.parquet")]
    assert len(found) == 25 and spark.read.parquet(f"file://{tmp_path}/parts").count() == 1000


@pytest.mark.parametrize(("dims", "chunk"), [(2, 3), (5, 7), (5, 1000)])
def test_links_in_chunks(spark, dims, chunk):
    """The components of all near pairs, from no more links than a star in each pair of chunks has."""
    from tracemend.operators.graphs import Scratch, components

    draw = np.random.default_rng(dims)
    z = np.concatenate([draw.normal(size=(60, dims)) * 0.2, draw.normal(size=(60, dims)) * 3])
    cubes = spark.createDataFrame([(i, 2, (2 * v).tolist()) for i, v in enumerate(z)], "id long, n long, s array<double>").repartition(5)
    scratch = Scratch(spark, "links")
    links = discovery.linked(scratch, cubes, 1.0, chunk)
    near = ((z[:, None] - z[None]) ** 2).sum(axis=2) <= 1.0
    group = list(range(len(z)))
    for _ in z:  # the least number among the near ones, until nothing changes
        group = [min(group[j] for j in np.flatnonzero(n)) for n in near]
    got = {r["id"]: r["component"] for r in rows(components(scratch, links))}
    assert [got.get(i, i) for i in range(len(z))] == group
    assert chunk < 1000 or links.count() < 8 * len(z)


def test_full_distances_of_odd_vectors(spark):
    """Null vectors, null, infinite and undefined entries, another width: in no cluster, and at no distance."""
    plain = [[float(i), float(i * i % 7)] for i in range(8)]
    odd = [None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], []]
    make = lambda zs: spark.createDataFrame([(i, 1, z) for i, z in enumerate(zs)], "vec_id long, label int, z array<double>").repartition(9)
    both, alone = make(plain + odd), make(plain)
    want = {r["vec_id"]: r["d"] for r in rows(clusters.full_distances(alone, clusters.full_clusters(alone)))}
    got = {r["vec_id"]: (r["n"], r["d"]) for r in rows(clusters.full_distances(both, clusters.full_clusters(both)))}
    assert len(got) == len(plain + odd) and {n for n, _ in got.values()} == {len(plain)}
    assert all(got[i][1] == pytest.approx(want[i]) for i in want) and all(got[i][1] is None for i in range(len(plain), len(got)))
    assert clusters.full_clusters(make(odd[:1])) == {} and rows(clusters.full_distances(both, {})) == []


def test_yaml_is_parsed_once(spark, tmp_path):
    """Each document once, whatever reads the log; events before any trace of their block belong to the trace of the blocks before."""
    events = "".join(f'---\nevent:\n  "concept:name": "e{i}"\n  "time:timestamp": "2024-01-01T00:00:{i % 60:02d}"\n' for i in range(300))
    (tmp_path / "a.xes.yaml").write_text('---\nlog:\n  trace:\n    "concept:name": "one"\n' + events + '---\nlog:\n  trace:\n    "concept:name": "two"\n' + events[:1000].rpartition("---")[0])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        log = xes.read_yaml(spark, f"file://{tmp_path}/a.xes.yaml")
        assert log.groupBy("case_id").count().orderBy("case_id").collect()[0][:] == ("one", 300)
        (tmp_path / "a.xes.yaml").unlink()  # what is asked for now comes from what was stored
        assert sorted(r["activity"] for r in rows(log.where("case_id = 'one'"))) == sorted(f"e{i}" for i in range(300)) and log.where("case_id = 'two'").count() > 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sensor_names():
    assert payload.sensor_names(["t", "p"])[:3] == ["iot_val_p", "iot_val_t", "iot_pres_p"] and len(payload.sensor_names(["t", "p"])) == 12


def test_case_history_outlives_order(spark, tmp_path):
    from tracemend.streaming import cases

    log = spark.createDataFrame([(i, "c", "ab"[i % 2] if i % 3 else None, datetime(2024, 1, 1) + timedelta(hours=i), float(i)) for i in range(20)], "seq long, case_id string, activity string, ts timestamp, value double")
    log.write.parquet(f"{tmp_path}/in")
    q = cases.with_history(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"), 3)
    q.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted(rows(spark.read.parquet(f"{tmp_path}/out")), key=lambda r: r["seq"])
    assert [r["so_far"] for r in got] == list(range(20)) and got[5]["mean"] == 4.0 and got[0]["provenances"] == "" and got[4]["provenances"] == "NORMAL,NORMAL,MISSING"


def test_label_losses_by_differences():
    draw = np.random.default_rng(2)
    z, labels = draw.normal(size=(12, 3)), np.array([0, 0, 1, 1, 1, 2, 2, 2, 2, 3, 0, 1])
    _, grad = autoencoder.cluster_loss(z, labels)
    for i, j in ((0, 0), (5, 1), (9, 2), (11, 0)):
        e = np.zeros_like(z)
        e[i, j] = 1e-6
        assert abs((autoencoder.cluster_loss(z + e, labels)[0] - autoencoder.cluster_loss(z - e, labels)[0]) / 2e-6 - grad[i, j]) < 1e-6
    assert autoencoder.cluster_loss(z, np.zeros(12))[0] == 0.0
    x = draw.normal(size=(12, 5))
    m, head = autoencoder.fit(x, latent=3, hidden=4, epochs=1), autoencoder.Head.of(labels.tolist(), 3)
    _, gw, gb = m.loss_and_gradients(x, x, 0.01, labels, head)
    for p, g in [(m.weights[0], gw[0]), (m.weights[1], gw[1]), (head.weights, gw[4]), (head.bias, gb[4])]:
        at = tuple(0 for _ in p.shape)
        before = p[at]
        p[at] = before + 1e-6
        up = m.loss_and_gradients(x, x, 0.01, labels, head)[0]
        p[at] = before - 1e-6
        down = m.loss_and_gradients(x, x, 0.01, labels, head)[0]
        p[at] = before
        assert abs((up - down) / 2e-6 - g[at]) < 1e-5
    head.grow([3, 7, 9])
    assert head.labels == [0, 1, 2, 3, 7, 9] and head.weights.shape == (3, 6) and head.loss(z, head.numbers([7] * 12))[0] > 0
    assert np.all(autoencoder.masked(x, 2, 1.0, draw)[:, :2] == 0) and np.all(autoencoder.masked(x, 2, 1.0, draw)[:, 2:] == x[:, 2:])


def test_labels_draw_clusters_apart(spark):
    draw = np.random.default_rng(6)
    pts = [(i, i % 3, (draw.normal(size=6) + 1.2 * np.eye(6)[i % 3]).tolist()) for i in range(300)]
    df = spark.createDataFrame(pts, "seq long, label int, x array<double>")

    def score(model):
        z = {r["seq"]: np.array(r["z"]) for r in rows(autoencoder.encode(df, model))}
        own = [np.array([z[i] for i, k, _ in pts if k == c]) for c in range(3)]
        return np.mean([o.std(axis=0).mean() for o in own]) / np.std([o.mean(axis=0) for o in own])

    plain, told = autoencoder.train(df, epochs=20, latent=4), autoencoder.train_labelled(df, 2, epochs=20, latent=4)
    assert score(told) < score(plain)
    assert autoencoder.tune(df.limit(10), told) is told
    tuned = autoencoder.tune(df, told, epochs=3)
    assert tuned is not told and np.array_equal(tuned.mean, told.mean) and not np.array_equal(tuned.weights[0], told.weights[0])


def test_logs_as_streams(spark, tmp_path):
    """XES files that a stream reads give what a batch reads; a single compressed file is found from its folder."""
    import gzip

    event = lambda c, k: f'<event><string key="concept:name" value="a{k}"/><date key="time:timestamp" value="2024-01-01T10:00:0{k}Z"/><int key="cost" value="{c}"/></event>'
    (tmp_path / "in").mkdir()
    for c in range(3):
        (tmp_path / "in" / f"{c}.xes").write_text(f'<?xml version="1.0"?><log><trace><string key="concept:name" value="t{c}"/>{"".join(event(c, k) for k in range(4))}</trace></log>')
    at = f"file://{tmp_path}"
    xes.read_xml(spark, f"{at}/in", streaming=True).drop("attributes", "sensors", "sensors_raw").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    want = sorted((f"t{c}", f"a{k}") for c in range(3) for k in range(4))
    assert sorted((r["case_id"], r["activity"]) for r in rows(spark.read.parquet(f"{at}/out"))) == want
    few = xes.read_logs(spark, f"{at}/in", where=F.col("activity") != "a0", most_files=2, most_events=2)
    assert sorted((r["case_id"], r["activity"]) for r in rows(few)) == [("t0", "a1"), ("t0", "a2"), ("t1", "a1"), ("t1", "a2")]
    (tmp_path / "one.xes").mkdir()
    with gzip.open(tmp_path / "one.xes" / "one.xes.gz", "wt") as f:
        f.write((tmp_path / "in" / "1.xes").read_text())
    assert sorted(r["attributes"]["cost"] for r in rows(xes.read_single(spark, f"{at}/one.xes"))) == ["1"] * 4


def test_a_batch_of_files_keeps_all_cores_at_work(spark, monkeypatch):
    """A file is one task: three at a time would leave the other cores idle, however many files there are."""
    from tracemend.plans import streams
    from tracemend.sources import xes

    class Enough(Exception):
        pass

    told = []

    def read(*args, files_a_batch, **rest):
        told.append(files_a_batch)
        raise Enough

    monkeypatch.setattr(xes, "write_xml", lambda *args: None)
    monkeypatch.setattr(xes, "read_xml", read)
    with pytest.raises(Enough):
        streams.stream_xes(spark, "/root/testdata/sf0.001")
    assert told == [spark.sparkContext.defaultParallelism] == [4]
