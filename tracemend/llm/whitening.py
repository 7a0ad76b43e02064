"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Each partition keeps the number, the exact sums and the full-rank singular values and vectors of its own centred rows. Two
such summaries merge by stacking both factors and one row that corrects for the difference of the means, and decomposing
the stack again; no dimension is dropped, so the last summary is that of all rows. No covariance matrix is formed on the
way, which would square the condition number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.llm.common import Scratch, fresh, map_arrow, quoted, table

SCALE = 256
FAN = 8  #: summaries merged in one task
CHUNK_BYTES = 16 << 20  #: centred rows decomposed at once
SAFE = 1 << 62
STATE = "part long, n long, sums array<string>, factor array<double>"


def integers(vector: str = "embedding") -> F.Column:
    """Entries as floor(SCALE * entry), from double."""
    return F.transform(vector, lambda v: F.floor(SCALE * v.cast("double")).cast("long"))


def usable(vector: str = "embedding") -> F.Column:
    """Vectors without null or non-finite entries; an entry whose integer doesn't fit a long counts as non-finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda v: F.coalesce(F.abs(SCALE * v.cast("double")) < F.lit(2.0**63), F.lit(False)))


def matrix(lists: pa.Array, dims: int, kind: type = np.int64) -> np.ndarray:
    """Rows of a list array, shorter ones filled up with zeros."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims).astype(kind, copy=False)
    out = np.zeros((len(sizes), dims), kind)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


@dataclass
class Summary:
    """Of some rows: their number, exact sums, and a factor whose product with its transpose is their scatter matrix."""

    n: int
    sums: list[int]
    factor: np.ndarray  #: singular values times right singular vectors

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # of two integers: rounded once


def exact_sums(x: np.ndarray) -> list[int]:
    small = len(x) == 0 or max(int(x.max(initial=0)), -int(x.min(initial=0))) * len(x) < SAFE
    return [int(s) for s in (x if small else x.astype(object)).sum(axis=0)]


def decomposed(rows: np.ndarray) -> np.ndarray:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def summary(x: np.ndarray) -> Summary:
    out = Summary(len(x), exact_sums(x), np.zeros((0, x.shape[1])))
    out.factor = decomposed(x - out.mean())
    return out


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of both sets of rows."""
    n = a.n + b.n
    apart = np.array([(s * b.n - t * a.n) / (a.n * b.n) for s, t in zip(a.sums, b.sums, strict=True)])
    row = np.sqrt(a.n / n * b.n) * apart
    return Summary(n, [s + t for s, t in zip(a.sums, b.sums, strict=True)], decomposed(np.vstack([a.factor, b.factor, row])))


def merge_all(some: Iterable[Summary]) -> Summary | None:
    out = None
    for s in some:
        out = s if out is None else merge(out, s)
    return out


def stored(part: int, s: Summary) -> dict:
    return {"part": [part], "n": [s.n], "sums": [[str(x) for x in s.sums]], "factor": [s.factor.ravel()]}


def summaries(fit: DataFrame, dims: int) -> DataFrame:
    """A summary for each partition of (x)."""
    most = max(dims + 1, CHUNK_BYTES // (8 * dims))

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        def chunks() -> Iterator[np.ndarray]:
            held: list[np.ndarray] = []
            for b in batches:
                held.append(matrix(b["x"], dims))
                if sum(map(len, held)) >= most:
                    yield np.vstack(held)
                    held = []
            if held:
                yield np.vstack(held)

        out = merge_all(map(summary, chunks()))
        if out is not None:
            yield stored(TaskContext.get().partitionId(), out)

    return map_arrow(fit, STATE, each)


def merged(states: DataFrame, dims: int) -> Summary | None:
    """One summary of all, by rounds of FAN to one; the driver gets the last, whose size is that of dims x dims."""

    def several(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["part"])
        out = merge_all(Summary(r["n"], [int(s) for s in r["sums"]], np.array(r["factor"]).reshape(-1, dims)) for r in rows)
        return pa.table(stored(key[0].as_py(), out), schema=t.schema)

    width = (states.agg(F.max("part")).first()[0] or 0) + 1
    while width > 1:
        states = states.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(several, STATE)
        width = -(-width // FAN)
    last = states.first()
    return last and Summary(last["n"], [int(s) for s in last["sums"]], np.array(last["factor"]).reshape(-1, dims))


@dataclass
class Whitening:
    """Directions of falling variance: (components x dims) unit rows, their variances, each one's share of all variance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    shares: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ self.directions.T / np.sqrt(self.variances)


def whitening(s: Summary, components: int) -> Whitening:
    """Of a summary. Directions along which the rows don't vary, up to rounding, are no components. The largest entry of each is positive."""
    _, values, v = np.linalg.svd(s.factor, full_matrices=False)
    variances = values**2 / s.n
    some = int((values > values.max(initial=0) * 1e-12).sum())
    k = min(some, components)
    v = v[:k]
    v = v * np.sign(v[np.arange(k), np.abs(v).argmax(axis=1)])[:, None] if k else v
    return Whitening(s.n, s.sums, v, variances[:k], variances[:k] / variances.sum() if k else variances[:k])


def identity_error(fit: DataFrame, w: Whitening, dims: int) -> float:
    """The largest absolute entry of the covariance of the whitened rows of `fit` minus the identity, from sums of products by partition."""
    k = len(w.variances)

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            y = w.apply(matrix(b["x"], dims))
            first += y.sum(axis=0)
            second += y.T @ y
        yield {"i": range(k + k * k), "s": [*first, *second.ravel()]}

    got = {r["i"]: r["s"] for r in map_arrow(fit, "i int, s double", each).groupBy("i").agg(F.sum("s").alias("s")).collect()}  # k + k * k rows
    first = np.array([got[i] for i in range(k)]) / w.n
    second = np.array([got[k + i] for i in range(k * k)]).reshape(k, k) / w.n
    return float(np.abs(second - np.outer(first, first) - np.eye(k)).max())


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n * x - sums) squared, in whole numbers."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0)), 1) + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < SAFE:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 4) -> DataFrame:
    """rows with a usable vector, with n, deviation, whitened (array), explained (array) and identity_error.

    Vectors that are null or hold null or non-finite entries are left out; entries become whole numbers first (`integers`).
    Summaries are taken over each distinct vector once; repeated rows each stay, as do ties and null ids. Shorter vectors,
    empty ones among them, count as filled up with zeros. Of vectors that are all alike, or one only, there are no
    components: the arrays are empty and identity_error is 0. A deviation beyond a long is null. Columns in excess stay; one
    with the name of a result is replaced. An empty table gives an empty one.
    """
    scratch = Scratch(rows.sparkSession, "whiten")
    x_name = fresh(rows.columns, "x")
    kept = rows.where(usable(quoted(vector))).withColumn(x_name, integers(quoted(vector)))
    fit = scratch.keep(kept.select(F.col(x_name).alias("x")).distinct())
    dims = fit.agg(F.max(F.size("x"))).first()[0] or 0
    results = {"n": "long", "deviation": "long", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double"}
    others = [c for c in kept.columns if c.lower() not in results and c != x_name]
    state = merged(scratch.keep(summaries(fit, dims)), dims) if dims else None
    w = whitening(state, components) if state else Whitening(fit.count(), [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    error = identity_error(fit, w, dims) if len(w.variances) else 0.0

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            x = matrix(b[x_name], dims)
            size = len(x)
            yield {c: b[c] for c in others} | {
                "n": [w.n] * size, "deviation": [v if v < 1 << 63 else None for v in exact_deviation(x, w.n, w.sums)], "whitened": w.apply(x).tolist() if len(w.variances) else [[]] * size,
                "explained": [w.shares.tolist()] * size, "identity_error": [error] * size,
            }

    fields = ", ".join([*(f"{quoted(c)} {t}" for c, t in kept.select(*map(quoted, others)).dtypes), *(f"{c} {t}" for c, t in results.items())])
    return map_arrow(kept.select(*map(quoted, others), quoted(x_name)), fields, each)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four components of each vector, whitened. Nulls, repeats and vectors without variance as in `whiten`."""
    done = whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long")))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    out = done.select("vec_id", "n", "deviation", "identity_error", each)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


QUERIES = {"op12_whitening": op12_whitening}
