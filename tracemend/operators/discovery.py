"""New activities from events that no cluster explains.

Points are rounded to cells of a grid; events of a cell are summed where they are read, so what is shuffled is a row for
each cell a task has met. Cells that touch, and whose means lie within the radius, belong to one group; groups are the
connected components of such cells. Nothing is capped and no centre meets on the driver, so the result does not depend on
how the events were dealt. Groups that are large, last, and stand apart from the known clusters get a label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY_DIMS = 3  #: projections that make the cells by which near ones are found
CHUNK = 1 << 11  #: cells that meet as many others at a time


def directions(dims: int, keys: int = KEY_DIMS) -> np.ndarray:
    """Unit vectors, the same in each run, on which points are projected; for few dimensions the axes themselves."""
    if dims <= keys:
        return np.eye(dims)
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(dims, keys)))
    return q.T


def cells(points: DataFrame, radius: float) -> DataFrame:
    """(cell, home, n, s, first_seq, last_seq): events (seq, z) of each cell summed; two points of a cell are within the radius of each other.

    A cell is a cube of diagonal `radius` in all dimensions; home is the place of its projections on a grid of width radius.
    """

    def each(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            if not len(pdf):
                continue
            z = np.stack(pdf["z"].to_numpy()).astype(float)
            cube = np.floor(z / (radius / np.sqrt(z.shape[1]))).astype(np.int64)
            _, first, of = np.unique(cube, axis=0, return_index=True, return_inverse=True)
            of = of.ravel()
            sums = np.zeros((len(first), z.shape[1]))
            np.add.at(sums, of, z)
            seq = pdf["seq"].to_numpy()
            low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
            np.minimum.at(low, of, seq)
            np.maximum.at(high, of, seq)
            yield pd.DataFrame({"cube": [c.tobytes() for c in cube[first]], "n": np.bincount(of, minlength=len(first)), "s": list(sums), "first_seq": low, "last_seq": high})

    parts = points.where("seq is not null and z is not null").select("seq", "z").mapInPandas(each, "cube binary, n long, s array<double>, first_seq long, last_seq long")
    add = F.aggregate(F.slice(F.collect_list("s"), 2, F.size(F.collect_list("s"))), F.collect_list("s")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))  # a row for each batch that met the cell
    return parts.groupBy("cube").agg(F.sum("n").alias("n"), add.alias("s"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


def forest(near: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a matrix of who is near whom, the number of their component, -1 for those near none; own: rows and columns are the same."""
    a = np.full(near.shape[0], -1)
    b = a if own else np.full(near.shape[1], -1)
    for i in np.flatnonzero(near.any(axis=1)):
        if a[i] >= 0:
            continue
        a[i], front = i, np.array([i])
        while len(front):
            hit = np.flatnonzero(near[front].any(axis=0) & (b < 0))
            b[hit] = i
            front = hit if own or not len(hit) else np.flatnonzero(near[:, hit].any(axis=1) & (a < 0))
            a[front] = i
    return a, b


def within(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Which rows of x and y lie within the radius of each other; where the product leaves it open, by the sum of squares itself."""
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    far = square - 2 * (x @ y.T)
    near = far <= radius * radius
    i, j = np.nonzero(np.abs(far - radius * radius) <= 1e-12 * (square + radius * radius))
    near[i, j] = np.cumsum((x[i] - y[j]) ** 2, axis=1)[:, -1] <= radius * radius
    return near


def linked(scratch, cubes: DataFrame, radius: float, chunk: int = CHUNK) -> DataFrame:
    """(a, b): cells by number, that have the components of all pairs whose means lie within the radius of each other.

    Two means that near have projections in the same or in neighbouring places of the grid, so each cell meets those of the
    places around its own: a place is cut into chunks, a task takes one pair of chunks at a time as a product of matrices, and
    of what is near there only a star for each component leaves it. The work still grows with the cells of such places: where
    the radius is as wide as all points lie apart, that is each cell with each, so the radius should be that of one group.
    """

    def place(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            if not len(pdf):
                continue
            mean = np.stack(pdf["s"].to_numpy()) / pdf["n"].to_numpy()[:, None]
            home = np.floor(mean @ directions(mean.shape[1]).T / radius).astype(np.int64)
            yield pd.DataFrame({"id": pdf["id"], "mean": list(mean), "home": [h.tolist() for h in home]})

    placed = scratch.keep(cubes.select("id", "n", "s").mapInPandas(place, "id long, mean array<double>, home array<long>"))
    dims = placed.select(F.size("home")).first()
    around = [[]]
    for _ in range(dims[0] if dims else 0):
        around = [[*p, d] for p in around for d in (-1, 0, 1)]
    places = scratch.keep(placed.groupBy("home").agg(F.ceil(F.count("*") / chunk).alias("chunks")))
    chunked = placed.join(places, "home").select("id", "mean", "home", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"))
    every = places.select("home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))  # a row for each chunk
    here = every.select(F.col("home").alias("x"), F.col("chunk").alias("i"), F.explode(F.array(*(F.array(*(F.get("home", F.lit(k)) + d for k, d in enumerate(p))) for p in around))).alias("y"))
    pairs = here.join(every.select(F.col("home").alias("y"), F.col("chunk").alias("j")), "y").where((F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("i") <= F.col("j"))))
    pairs = scratch.keep(pairs.select("x", "i", "y", "j", F.monotonically_increasing_id().alias("pair")))
    own = (F.col("x") == F.col("y")) & (F.col("i") == F.col("j"))
    ends = pairs.select("pair", F.lit(0).alias("side"), F.col("x").alias("home"), F.col("i").alias("chunk")).unionByName(pairs.where(~own).select("pair", F.lit(1).alias("side"), F.col("y").alias("home"), F.col("j").alias("chunk")))
    met = chunked.join(ends, ["home", "chunk"]).select("pair", "side", "id", "mean").repartition("pair").sortWithinPartitions("pair")

    def stars(pdf):
        import pandas as pd

        side, ids = pdf["side"].to_numpy(), pdf["id"].to_numpy()
        z = np.stack(pdf["mean"].to_numpy())
        alone = not side.any()
        x, y = z[side == 0], z if alone else z[side == 1]
        near = within(x, y, radius)
        if alone:
            np.fill_diagonal(near, False)
        a, b = forest(near, alone)
        t = pd.DataFrame({"c": a if alone else np.concatenate([a, b]), "b": ids if alone else np.concatenate([ids[side == 0], ids[side == 1]])})
        t = t[t["c"] >= 0]
        t["a"] = t.groupby("c")["b"].transform("min")
        return t.loc[t["a"] < t["b"], ["a", "b"]]

    def each(batches: Iterator) -> Iterator:
        import pandas as pd

        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf["pair"] == pdf["pair"].iloc[-1]
            rest = pdf[last]
            for _, g in pdf[~last].groupby("pair", sort=False):
                yield stars(g)
        if rest is not None and len(rest):
            yield stars(rest)

    return scratch.keep(met.mapInPandas(each, "a long, b long").distinct())


def discover(points: DataFrame, known: np.ndarray, radius: float, least: int = 10, persist: int = 5, separation: float = 3.0, first_number: int = 1) -> DataFrame:
    """(label, n, first_seq, last_seq): groups of `least` events over `persist` positions, apart from known centroids by `separation`.

    Groups are numbered by their first event. Events without a vector take no part.
    """
    from tracemend.operators.graphs import Scratch, components

    scratch = Scratch(points.sparkSession, "discovery")
    found = cells(points, radius).orderBy("first_seq", "cube").withColumn("id", F.monotonically_increasing_id())
    cubes = scratch.keep(found)
    groups = components(scratch, linked(scratch, cubes, radius))
    t = cubes.join(groups, "id", "left").withColumn("group", F.coalesce("component", "id"))
    add = F.aggregate(F.slice(F.collect_list("s"), 2, F.size(F.collect_list("s"))), F.collect_list("s")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    t = t.groupBy("group").agg(F.sum("n").alias("n"), add.alias("s"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))
    t = t.where((F.col("n") >= least) & (F.col("last_seq") - F.col("first_seq") >= persist))
    apart = F.lit(True)
    for c in known:  # a row for each label
        centre = F.array(*(F.lit(float(x)) for x in c))
        apart &= F.aggregate(F.zip_with(F.transform("s", lambda x: x / F.col("n")), centre, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x) > separation * separation
    good = t.where(apart)
    number = F.row_number().over(Window.orderBy("first_seq")) + (first_number - 1)  # a row for each new label
    return good.select(F.concat(F.lit("UNDISCOVERED_"), number.cast("string")).alias("label"), "n", "first_seq", "last_seq")


def reconcile(distances: DataFrame, sizes: DataFrame, threshold: float = 2.0, least: int = 20) -> DataFrame:
    """(label, into): discovered labels that merge into the nearest known cluster, where both are large enough.

    distances: a, b, distance of cluster pairs; sizes: label, n.
    """
    new = F.col("a").startswith("UNDISCOVERED_")
    both = distances.unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).where(new & ~F.col("b").startswith("UNDISCOVERED_") & (F.col("distance") < threshold))
    big = sizes.where(F.col("n") >= least).select("label")
    both = both.join(big.withColumnRenamed("label", "a"), "a", "left_semi").join(big.withColumnRenamed("label", "b"), "b", "left_semi")
    return both.groupBy(F.col("a").alias("label")).agg(F.min_by("b", F.struct("distance", "b")).alias("into"))


def corrected(results: DataFrame, merges: DataFrame) -> DataFrame:
    """Results with the labels of merged clusters replaced, and what they were in reconciled_from."""
    hit = results.join(F.broadcast(merges.withColumnRenamed("label", "recovered")), "recovered", "left")  # a row for each discovered label
    own = F.col("into").isNotNull() & (F.col("provenance") == "RECOVERED_ML")
    return hit.select(*(c for c in results.columns if c != "recovered"), F.when(own, F.col("into")).otherwise(F.col("recovered")).alias("recovered"), F.when(own, F.col("recovered")).alias("reconciled_from"))
