"""A sparse denoising autoencoder: fitted on a bounded sample, applied to Arrow batches with broadcast weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 5_000  #: rows that a fit uses at most


def cluster_loss(z: np.ndarray, labels: np.ndarray, separation: float = 1.0, compactness: float = 0.5) -> tuple[float, np.ndarray]:
    """Mean of exp(-distance) over pairs of label centroids, plus the mean distance of points to their own; and its gradient by z. 0 for one label."""
    names, of = np.unique(labels, return_inverse=True)
    grad = np.zeros_like(z)
    if len(names) < 2:
        return 0.0, grad
    size = np.bincount(of).astype(float)
    centre = np.zeros((len(names), z.shape[1]))
    np.add.at(centre, of, z)
    centre /= size[:, None]
    apart = centre[:, None] - centre[None]
    far = np.sqrt((apart**2).sum(axis=2))
    pair = np.triu(np.ones_like(far), 1) > 0
    near = np.where(pair, np.exp(-far), 0.0)
    pairs = pair.sum()
    both = near + near.T
    pull = np.divide(both, far, out=np.zeros_like(far), where=far > 0)
    to_centre = -(pull[:, :, None] * apart).sum(axis=1) * separation / pairs
    step = z - centre[of]
    length = np.sqrt((step**2).sum(axis=1))
    several = size[of] > 1
    unit = np.divide(step, length[:, None], out=np.zeros_like(step), where=length[:, None] > 0) * several[:, None]
    mean = np.zeros_like(centre)
    np.add.at(mean, of, unit)
    mean /= size[:, None]
    grad = (unit - mean[of]) / size[of][:, None] * compactness / len(names) + to_centre[of] / size[of][:, None]
    spread = (length * several / size[of]).sum() / len(names)
    return float(separation * near.sum() / pairs + compactness * spread), grad


@dataclass
class Head:
    """A linear classifier on latent vectors, with a weight for each class; labels that are new later get a column of their own."""

    labels: list
    weights: np.ndarray
    bias: np.ndarray
    cost: np.ndarray

    @classmethod
    def of(cls, labels: list, latent: int, seed: int = 2) -> Head:
        names, count = np.unique(np.array(labels), return_counts=True)
        return cls(names.tolist(), np.random.default_rng(seed).normal(0, 0.1, (latent, len(names))), np.zeros(len(names)), count.sum() / (len(names) * count))

    def grow(self, labels: list) -> None:
        """Columns for labels that are not known yet; all classes then weigh alike."""
        new = sorted(set(labels) - set(self.labels))
        if new:
            self.labels += new
            self.weights = np.hstack([self.weights, np.random.default_rng(len(self.labels)).normal(0, 0.1, (len(self.weights), len(new)))])
            self.bias, self.cost = np.append(self.bias, np.zeros(len(new))), np.ones(len(self.labels))

    def numbers(self, labels: list) -> np.ndarray:
        at = {a: i for i, a in enumerate(self.labels)}
        return np.array([at[a] for a in labels], np.int64)

    def loss(self, z: np.ndarray, own: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Weighted cross-entropy and its gradients by z, weights and bias."""
        logits = z @ self.weights + self.bias
        logits = logits - logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        cost = self.cost[own]
        at = np.arange(len(z))
        loss = -(cost * np.log(np.maximum(p[at, own], 1e-300))).sum() / cost.sum()
        g = p * cost[:, None] / cost.sum()
        g[at, own] -= cost / cost.sum()
        return float(loss), g @ self.weights.T, z.T @ g, g.sum(axis=0)


def masked(x: np.ndarray, flow: int, share: float, draw: np.random.Generator) -> np.ndarray:
    """x with the first `flow` cells, those of the control flow, taken from a share of the rows."""
    out = x.copy()
    out[draw.random(len(x)) < share, :flow] = 0.0
    return out


@dataclass
class Autoencoder:
    """One hidden layer each way, ReLU; z is the ReLU latent. Inputs are standardised and clipped."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]  # of encoder 1, 2 and decoder 1, 2
    biases: list[np.ndarray]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -10, 10)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            h = out[-1] @ w + b
            out.append(h if i == 3 else np.maximum(h, 0))
        return out

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Latent vectors and mean squared reconstruction errors."""
        x = self.standard(x)
        layers = self.forward(x)
        return layers[2], ((layers[4] - x) ** 2).mean(axis=1)

    def loss_and_gradients(self, noisy: np.ndarray, clean: np.ndarray, sparsity: float, labels: np.ndarray | None = None, head: Head | None = None) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
        """Mean squared error plus sparsity times the mean latent; with labels also how clusters lie and how well the head tells them.

        The gradients of the head, where there is one, come after those of the layers.
        """
        a = self.forward(noisy)
        n, d = clean.shape
        loss = ((a[4] - clean) ** 2).mean() + sparsity * np.abs(a[2]).mean()
        extra, hw, hb = np.zeros_like(a[2]), [], []
        if labels is not None:
            own, extra = cluster_loss(a[2], labels)
            loss += own
        if head is not None:
            own, gz, gw_head, gb_head = head.loss(a[2], labels)
            loss, extra, hw, hb = loss + own, extra + gz, [gw_head], [gb_head]
        g, gw, gb = 2 * (a[4] - clean) / (n * d), [None] * 4, [None] * 4
        for i in (3, 2, 1, 0):
            gw[i], gb[i] = a[i].T @ g, g.sum(axis=0)
            g = g @ self.weights[i].T
            if i == 2:
                g = g + sparsity * np.sign(a[2]) / a[2].size + extra
            if i:
                g = g * (a[i] > 0)
        return float(loss), gw + hw, gb + hb


def fit(x: np.ndarray, latent: int = 16, hidden: int = 64, noise: float = 0.1, sparsity: float = 0.01, epochs: int = 40, rate: float = 1e-3, batch: int = 64, seed: int = 1, labels: list | None = None, flow: int = 0, mask: float = 0.15, start: Autoencoder | None = None) -> Autoencoder:
    """Adam on noisy batches.

    labels: of the rows; then clusters are drawn apart, a head learns to tell them, and a share `mask` of the rows lose their
    first `flow` cells. start: a model that is tuned further, with its own standardisation.
    """
    draw = np.random.default_rng(seed)
    sizes = [x.shape[1], hidden, latent, hidden, x.shape[1]]
    weights = [draw.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    model = Autoencoder(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), weights, [np.zeros(b) for b in sizes[1:]])
    if start is not None:
        model = Autoencoder(start.mean, start.scale, [w.copy() for w in start.weights], [b.copy() for b in start.biases])
    z = model.standard(x)
    head = Head.of(labels, model.weights[1].shape[1]) if labels is not None else None
    numbers = head.numbers(labels) if head else None
    params = model.weights + ([head.weights] if head else []) + model.biases + ([head.bias] if head else [])
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = draw.permutation(len(z))
        for i in range(0, len(z), batch):
            clean = z[order[i : i + batch]]
            own = numbers[order[i : i + batch]] if head else None
            seen = masked(clean, flow, mask, draw) if head else clean
            _, gw, gb = model.loss_and_gradients(seen + draw.normal(0, noise, clean.shape), clean, sparsity, own, head)
            t += 1
            for p, g, mi, vi in zip(params, gw + gb, m, v, strict=True):
                mi += 0.1 * (g - mi)
                vi += 0.001 * (g * g - vi)
                p -= rate * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.999**t)) + 1e-8)
    return model


def train(rows: DataFrame, column: str = "x", most: int = SAMPLE_ROWS, **options) -> Autoencoder:
    """From at most `most` rows, by a hash of the vector."""
    some = rows.where(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column)).limit(most).collect()
    return fit(np.array([r[0] for r in some], float), **options)


def train_labelled(rows: DataFrame, flow: int, column: str = "x", label: str = "label", most: int = SAMPLE_ROWS, **options) -> Autoencoder:
    """From at most `most` labelled rows, by a hash of the vector."""
    some = rows.where(F.col(column).isNotNull() & F.col(label).isNotNull()).select(column, label).orderBy(F.xxhash64(column), label).limit(most).collect()
    return fit(np.array([r[0] for r in some], float), labels=[r[1] for r in some], flow=flow, **options)


def tune(rows: DataFrame, model: Autoencoder, column: str = "x", order: str = "seq", most: int = 200, least: int = 50, **options) -> Autoencoder:
    """The model trained on with the last `most` labelled rows by `order`; as it is where there are under `least`."""
    some = rows.where(F.col(column).isNotNull()).select(column, order).orderBy(F.desc(order)).limit(most).collect()
    return model if len(some) < least else fit(np.array([r[0] for r in some], float), start=model, **options)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of `width` numbers as rows; a null list, or a null in one, is nan."""
    out, there = np.full((len(lists), width), np.nan), lists.drop_null()
    if len(there) and set(there.value_lengths().unique().to_pylist()) != {width}:
        raise ValueError(f"vectors that are not {width} wide")
    if len(there):
        out[lists.is_valid().to_numpy(zero_copy_only=False)] = there.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(there), width)
    return out


def encode(rows: DataFrame, model: Autoencoder, column: str = "x") -> DataFrame:
    """rows with z and error in place of the vector."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in rows.schema.fields if f.name != column]
    width = len(model.mean)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                if b[column].null_count:
                    raise ValueError("a row without a vector")
                z, error = shared.value.encode(matrix(b[column], width))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(np.ascontiguousarray(z).ravel()))
                yield pa.RecordBatch.from_arrays([*(b[f.name] for f in kept), lists, pa.array(error)], names=[*(f.name for f in kept), "z", "error"])

    return rows.mapInArrow(each, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", z array<double>, error double")
