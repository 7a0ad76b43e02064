"""Whitening against eigenvectors of the covariance, exact sums against whole numbers, awkward vectors."""

import math

import numpy as np
import pytest

from tracemend.llm import whitening

NAN, INF = float("nan"), float("inf")


def plain(rows: list, components: int = 4):
    """{vec_id: [(n, deviation, whitened up to sign, explained)]} from the covariance matrix."""
    left = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) and abs(256 * c) < 2**63 for c in v)]
    d = max((len(v) for _, v in left), default=0)
    left = [(i, v + [0] * (d - len(v))) for i, v in left]
    fit = sorted({tuple(v) for _, v in left})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, float) - np.array([s / n for s in sums])
    cov = x.T @ x / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, row in left:
        y = [(np.array(row, float) - np.array([s / n for s in sums])) @ v[:, k] / math.sqrt(e[k]) for k in range(components) if e[k] > e[0] * 1e-12]
        out.setdefault(i, []).append((n, sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)), y, [e[k] / np.trace(cov) for k in range(len(y))]))
    return out


def vectors(draw, n, d):
    base = draw.normal(size=(n, d)) * np.linspace(3, 0.5, d) + draw.normal(size=d) * 50
    return [(i, [float(c) for c in v]) for i, v in enumerate(base)]


def test_query(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = vectors(draw, 300, 7)
    rows += [(5, rows[5][1]), (900, rows[5][1]), (None, rows[7][1]), (901, None), (902, [1.0, None, *[0.0] * 5]), (903, [NAN] * 7), (904, [INF, *[0.0] * 6]), (905, rows[9][1][:4]), (906, []), (907, [1e300] * 7)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of all
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'a' AS n", "1 AS Whitened", "2 AS x", "3 AS `odd name`")
    frame.repartition(19).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in whitening.op12_whitening(spark, str(tmp_path)).collect():
        got.setdefault(r["vec_id"], []).append(r)
    want = plain(rows)
    assert got.keys() == want.keys() and len(want) == 300 + 4 + 150
    signs = [np.sign(y) * np.sign(next(r["whitened"] for r in got[0] if r["component"] == k + 1)) for k, y in enumerate(want[0][0][2])]
    for i, cases in want.items():
        assert len(got[i]) == 4 * len(cases)
        for r in got[i]:
            n, deviation, y, share = cases[0]
            k = r["component"] - 1
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert abs(r["whitened"] - signs[k] * y[k]) < 1e-8 * max(1, abs(y[k])) and abs(r["explained"] - share[k]) < 1e-10 and 0 <= r["identity_error"] < 1e-8


def test_all_columns_stay(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [3.0, 0.0], "b"), (3, [0.0, 0.0], None)], "id long, v array<double>, `x` string")
    out = whitening.whiten(frame, "v", components=9)
    assert out.columns == ["id", "v", "x", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted((r["id"], r["x"] or "", len(r["whitened"])) for r in out.collect()) == [(1, "a", 2), (2, "b", 2), (3, "", 2)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [2.0]), (2, [2.0])], [(1, []), (2, [])]])
def test_nothing_varies(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(frame).collect()
    assert [(r["vec_id"], r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in got] == [(i, 1, 0, [], 0.0) for i, v in rows if v is not None]


def test_merge_is_lossless():
    """Whatever the order of merging, the factor gives the scatter matrix of all rows, directions of tiny variance included."""
    draw = np.random.default_rng(8)
    x = (draw.normal(size=(500, 12)) * 10.0 ** -np.arange(12) * 1e9).astype(np.int64)
    whole = whitening.summary(x)
    parts = [whitening.summary(p) for p in np.array_split(x, [1, 2, 50, 51, 300])]
    left = whitening.merge_all(parts)
    right = whitening.merge_all([whitening.merge_all(parts[3:]), whitening.merge_all(parts[:3])])
    for s in (left, right):
        assert (s.n, s.sums) == (whole.n, whole.sums) and s.factor.shape == (12, 12)
        assert np.allclose(np.linalg.svd(s.factor)[1], np.linalg.svd(whole.factor)[1], rtol=1e-6)


def test_whole_numbers_beyond_doubles():
    x = np.array([[2**62, -(2**62)], [2**62 - 1, 5]], np.int64)
    sums = whitening.exact_sums(x)
    assert sums == [2**63 - 1, 5 - 2**62]
    assert whitening.exact_deviation(x, 2, sums) == [sum((2 * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x.tolist()]
