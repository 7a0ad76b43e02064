"""The cascade over trained sources: running full covariances against a loop, the warm-up and its versions, quality on a planted log."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemend.operators import drift, feedback, metrics, trained
from tracemend.operators.graphs import Scratch
from tracemend.plans import trained as plans

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("block_rows", [16, 50, 1000])
def test_running_covariances(spark, block_rows):
    """Blocks of any size; a label that is seen once, one that comes late, one whose vectors all agree."""
    draw = np.random.default_rng(2)
    rows = []
    for i in range(400):
        label = draw.choice(["a", "b", "late" if i > 250 else "a", "flat"])
        z = [1.0, 2.0, 3.0] if label == "flat" else (draw.normal(size=3) * [1, 2, 0.1] + (label == "b")).tolist()
        rows.append((i, "once" if i == 33 else str(label), z, bool(i % 3 == 0)))
    rows = [(i, None if asked and i % 2 else label, z, asked) for i, label, z, asked in rows]
    frame = spark.createDataFrame(rows, "seq long, label string, z array<double>, asked boolean").repartition(5)
    got = {r["seq"]: {c["label"]: (c["n"], c["d"]) for c in r["candidates"]} for r in trained.running_full(frame, least=2, epsilon=1e-3, block_rows=block_rows).collect()}
    seen: dict[str, list] = {}
    for i, label, z, asked in rows:
        if asked:
            assert set(got[i]) == set(seen)
            for name, past in seen.items():
                x = np.array(past)
                assert got[i][name][0] == len(x)
                if len(x) < 2:
                    assert got[i][name][1] is None
                    continue
                c = x - x.mean(axis=0)
                inverse = np.linalg.inv(c.T @ c / len(x) + 1e-3 * np.eye(3))
                assert got[i][name][1] == pytest.approx(float(np.sqrt((z - x.mean(axis=0)) @ inverse @ (z - x.mean(axis=0)))), rel=1e-6, abs=1e-6)
        if label is not None:
            seen.setdefault(label, []).append(z)
    assert len(got) == sum(a for *_, a in rows)


def test_sums_of_blocks_are_made_once(spark):
    """The vectors go through Python twice: for the sums of blocks and for the rows in order."""
    frame = spark.createDataFrame([(0, "a", [1.0], True)], "seq long, label string, z array<double>, asked boolean")
    plan = trained.running_full(frame, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_few_products_are_held_at_once(spark, monkeypatch):
    """Batches cut smaller give the same rows; null entries and vectors have no distance."""
    draw = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2] if i % 3 else None, draw.normal(size=2).tolist(), i % 3 == 0) for i in range(200)] + [(200, None, [None, 1.0], True), (201, None, None, True)]
    frame = spark.createDataFrame(rows, "seq long, label string, z array<double>, asked boolean")
    found = lambda: {r["seq"]: [tuple(c) for c in r["candidates"]] for r in trained.running_full(frame, 2, block_rows=64).collect()}
    whole = found()
    monkeypatch.setattr(trained, "CELLS", 30)
    assert found() == whole and len(whole) == 69
    assert [(a, d) for a, _, d in whole[200]] == [(a, d) for a, _, d in whole[201]] == [("a", None), ("b", None)]


def test_warmup_end(spark):
    log = spark.createDataFrame([(i, "ab"[i > 40]) for i in range(100)], "seq long, activity string")
    assert [trained.warmup_end(log, *a) for a in ((10, 90, 2), (60, 90, 2), (10, 30, 2), (10, 90, 1), (10, 90, 3))] == [42, 60, 30, 10, 90]


@pytest.fixture(scope="module")
def run(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    scratch = Scratch(spark, "trained")
    log = scratch.keep(plans.ring_log(spark, SF))
    return log, scratch.keep(plans.cascade_trained(spark, SF))


def test_better_than_counts_and_the_majority(spark, run):
    log, out = run
    assert out.count() == log.count() == out.select("seq").distinct().count()
    f1 = metrics.accuracy(out).first()["f1"]
    counts = feedback.settle(Scratch(spark, "t"), log.select("seq", "case_id", "truth", "activity"), feedback.Gate(2, 0.8, 20, feed=False), plans.RULE).rows
    gone = Counter(r["truth"] for r in log.where("activity is null").collect())
    assert f1 > metrics.accuracy(counts).first()["f1"] > 2 * max(gone.values()) / sum(gone.values())
    steps = {r["step"] for r in out.select("step").distinct().collect()}
    assert {"given", "cluster", "rescued", "near tie"} <= steps and {r["phase"] for r in out.select("phase").distinct().collect()} == {"online", "retro"}


def test_models_are_read_as_they_were_stored(spark, run, tmp_path):
    """A run that stops after the warm-up goes on with the same rows."""
    log = run[0].where("seq < 1500")
    scratch = Scratch(spark, "t")
    end = trained.warmup_end(log, 600, 900, 5)
    made = trained.fit(scratch, log, end, plans.GATES, latent=4, hidden=8, epochs=3)
    trained.save(spark, f"file://{tmp_path}", 3, made)
    read = trained.load(spark, f"file://{tmp_path}", 3)
    assert (read.labels, read.cluster_scale, read.head_scale, read.end) == (made.labels, made.cluster_scale, made.head_scale, made.end)
    one, two = ([tuple(r) for r in trained.cascade(scratch, log, m, plans.GATES, plans.RULE).orderBy("seq").collect()] for m in (made, read))
    assert one == two
    held = {r["seq"] for r in trained.held_out(log, end, 0.1, 7).collect()}
    known = log.where((F.col("seq") < end) & F.col("activity").isNotNull()).count()
    assert len(held) == int(known * 0.1)


def test_no_labels_at_all(spark):
    frame = spark.createDataFrame([(i, None, [float(i)], True) for i in range(5)], "seq long, label string, z array<double>, asked boolean")
    assert {r["seq"]: r["candidates"] for r in trained.running_full(frame, 2).collect()} == {i: [] for i in range(5)}


def test_alarms_are_those_of_a_window_after_another(spark):
    """Each metric of each label, and of all events, against one adaptive window that reads its sums in order."""
    draw = np.random.default_rng(4)
    rows = [(i, [None, "a", "b"][i % 3], float(draw.normal() + 3 * (i > 2000 and i % 3 == 1)), float(draw.normal())) for i in range(4000)]
    got = {(r["activity"], r["metric"], r["seq"]) for r in drift.families(spark.createDataFrame(rows, "seq long, activity string, error double, norm double"), ["error", "norm"]).coalesce(1).collect()}
    want = set()
    for label in ("a", "b", None):
        for m, metric in ((2, "error"), (3, "norm")):
            mine = [(r[0], r[m]) for r in rows if label is None or r[1] == label]
            window = drift.AdaptiveWindow(0.002)
            for k in range(0, len(mine), drift.BLOCK):
                some = mine[k : k + drift.BLOCK]
                v = np.array([x for _, x in some])
                if window.add_block(len(v), v.sum(), (v * v).sum()):
                    want.add((label, metric, some[-1][0]))
    near = lambda s: {(a, m, q // 400) for a, m, q in s}
    assert {(a, m) for a, m, _ in got} == {(a, m) for a, m, _ in want} == {("a", "error"), (None, "error")}
    assert near(got) & near(want) and min(q for *_, q in got) > 2000
    found = {(r["activity"], r["kinds"], r["severity"]) for r in drift.verdicts(spark.createDataFrame(list(got), "activity string, metric string, seq long"), 10_000, "error").collect()}
    assert found == {("a", 1, "low"), (None, 1, "low")}


def test_reactions_look_back_over_places(spark):
    rows = [(i, "ab"[i % 2], 1.0 if i < 300 else 5.0, i in (20, 41, 351, 399)) for i in range(400)]
    got = {r["seq"]: (round(r["before"], 6), round(r["after"], 6), r["reaction"]) for r in drift.tiers(spark.createDataFrame(rows, "seq long, activity string, error double, alarm boolean")).collect()}
    want = {}
    for i, label, _, alarm in rows:
        e = [x for j, a, x, _ in rows if a == label and j <= i][-100:]
        if alarm:
            b, a = np.mean(e[: len(e) // 2]), np.mean(e[len(e) // 2 :])
            want[i] = (round(b, 6), round(a, 6), "none" if len(e) < 20 else "decay_and_tune" if a / b > 2 else "tune")
    assert got == want and {r for *_, r in got.values()} == {"none", "tune", "decay_and_tune"}


def test_the_moved_label_is_found(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    got = plans.drift_alarms(spark, SF).collect()
    late = {r["activity"] for r in got if r["at"] * 500 >= 6500}
    assert plans.LABELS[-1] in late and late <= {plans.LABELS[-1], None}
