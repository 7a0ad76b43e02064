"""Near-duplicate groups by min-max hashing.

Each permutation gives two signature values, its minimum and its maximum over the shingle set, so half as many hash
evaluations fill the bands. Equal sets form one class first. In each bucket a pivot is compared with all members;
links are confirmed on the full sets. Buckets that still hold several components are compared whole, in blocks of
bounded size, by products of membership matrices; each block returns a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.llm.common import Scratch, components, map_arrow, row_keys, table, text_slices

BLOCK = 1000  #: members of a block; two blocks meet in one task
BLOCK_SHINGLES = 500_000  #: and their shingles, about
BROADCAST_ROWS = 500_000  #: up to so many ids are broadcast; more are joined by a shuffle


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __init__(self, most: int = 200_000):
        import xxhash

        self.hash, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self.hash(word)
        if len(word) < 64:
            self[word] = h
        return h


def shingle_set(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, one of none is empty."""
    words = text.encode().lower().split()  # A-Z only; cuts at 20 and 09-0D
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


class Bands:
    """Band keys of a set: rows of a band come from different permutations, all minima or all maxima."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        n = -(-bands * rows // 2)
        self.bands, self.rows = bands, rows
        self.mul = draw.integers(0, 1 << 63, n, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.add = draw.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]
        self.fold = draw.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        low = high = None
        for at in range(0, len(values), 1024):
            h = (values[None, at : at + 1024] ^ self.add) * self.mul
            a, b = h.min(axis=1), h.max(axis=1)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        signature = np.concatenate([low, high])[: self.bands * self.rows].reshape(self.bands, self.rows)
        return mix((mix(signature) * self.fold).sum(axis=1) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, md5 of the text, n_shingles, digest of the set, band keys, the set itself."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        hashes, keys = WordHashes(), Bands(bands, rows)
        for b in batches:
            for ids, texts in text_slices(b["doc_id"], b["text"], 2 << 20):
                sets = [shingle_set(t, width, hashes) for t in texts]
                yield {
                    "doc_id": ids, "text_md5": [hashlib.md5(t.encode()).digest() for t in texts], "n_shingles": [len(s) for s in sets], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                    "bands": [keys(s) if len(s) else [] for s in sets], "shingles": [s.tobytes() for s in sets],
                }

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, text_md5 binary, n_shingles long, digest binary, bands array<long>, shingles binary", each)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as alike as asked."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("shingles").alias("sb"))
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    both = pairs.join(a, "a").join(b, "b").where(fits).select("a", "b", "sa", "sb")

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for x in batches:
            out = {"a": [], "b": []}
            for a, b, sa, sb in zip(x["a"], x["b"], x["sa"], x["sb"], strict=True):
                u, v = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                n = len(np.intersect1d(u, v, assume_unique=True))
                if 100 * n >= percent * (len(u) + len(v) - n):
                    out["a"].append(a.as_py())
                    out["b"].append(b.as_py())
            yield out

    return map_arrow(both, "a long, b long", each)


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the sets, all of which are compared exactly."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    at = (np.cumsum(shared) - 1)[column]
    owner, at = owner[shared[column]], at[shared[column]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    inter = np.zeros((m, m), np.float32)  # exact up to 2**24
    for c in range(0, int(shared.sum()), 2048):
        lo, hi = np.searchsorted(at, [c, c + 2048])
        part = np.zeros((m, 2048), np.float32)
        part[owner[lo:hi], at[lo:hi] - c] = 1
        inter += part @ part.T
    inter = inter.astype(np.int64)
    linked = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    np.fill_diagonal(linked, False)
    new, out = np.ones(m, bool), []
    for root in range(m):
        if new[root]:
            new[root], todo = False, [root]
            while todo:
                u = todo.pop()
                for v in np.flatnonzero(linked[u] & new):
                    new[v] = False
                    out.append((u, int(v)))
                    todo.append(int(v))
    return out


def rest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets between members of different components (key, rep, n_shingles, component): a spanning forest of each pair of blocks.

    A bucket's largest component is dealt to blocks of its own, which meet the other members' blocks but not each other,
    so a hot bucket of one large family and some outsiders costs its size times the outsiders. Blocks are bounded by
    members and by shingles; no pair is emitted that isn't a link.
    """
    parts = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    blocks = lambda n, weight: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(weight / BLOCK_SHINGLES)).cast("int")
    largest = F.max(F.struct("n", "component", "weight"))
    plan = parts.groupBy("key").agg(largest.alias("m"), (F.sum("n") - F.max(F.struct("n", "component", "weight"))["n"]).alias("n"), (F.sum("weight") - F.max(F.struct("n", "component", "weight"))["weight"]).alias("weight"))
    plan = plan.select("key", F.col("m.component").alias("main"), blocks(F.col("m.n"), F.col("m.weight")).alias("ours"), blocks(F.col("n"), F.col("weight")).alias("others"))
    few = plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    at = members.join(F.broadcast(plan) if few else plan, "key")
    inside = F.col("component") == F.col("main")
    own = F.when(inside, F.pmod(F.xxhash64("rep"), "ours")).otherwise(F.col("ours") + F.pmod(F.xxhash64("rep"), "others")).cast("int")
    at = at.select("key", "rep", inside.alias("inside"), "ours", "others", own.alias("own"))
    # a block of outsiders is compared with itself where it meets the first block of the largest component
    every = F.sequence(F.when(F.col("inside"), F.col("ours")).otherwise(F.lit(0)), F.col("ours") + F.col("others") - 1)
    partners = F.filter(every, lambda o: o != F.col("own"))
    dealt = at.select("key", "rep", F.explode(F.transform(partners, lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))).alias("p")).select("key", "p.i", "p.j", "rep")
    full = dealt.join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")

    def compare(pdf):
        import pandas as pd

        ids = pdf["rep"].to_list()
        found = forest([np.frombuffer(s, np.uint64) for s in pdf["shingles"]], percent)
        return pd.DataFrame({"a": [ids[i] for i, _ in found], "b": [ids[j] for _, j in found]}, dtype="int64")

    return full.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 33, rows: int = 5) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id, kept, text_md5 (binary; of a null text as of an empty one).

    Linked are documents with 100 * intersection >= percent * union of their shingle sets, `width` words each. Two
    such documents miss each other in all bands with a chance of (1 - (percent/100)**rows)**bands at most: 2e-6 for
    80 in 33 bands of 5, and for 85 in 28 of 6. Null, empty and white texts have no shingles and are linked with
    nothing. A row with a null doc_id takes no part: its component is null and it is kept. Repeated rows are one class
    and get one result each; rows of an id with several texts are classes of their own, and the smallest id names a group.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    sketch = scratch.keep(sketches(docs, width, bands, rows))
    some = sketch.where("n_shingles > 0 and doc_id is not null")
    keys = row_keys(scratch, some.select("doc_id", "digest"))
    if keys is not None:  # some id has several texts: a key for each stands for it, in the same order
        some = scratch.keep(some.join(keys, ["doc_id", "digest"]).drop("doc_id").withColumnRenamed("key", "doc_id"))
    classes = scratch.keep(some.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    first = some.join(classes, (F.col("doc_id") == F.col("rep")) & (some["digest"] == classes["digest"])).select("rep", "n_shingles", "bands").dropDuplicates(["rep"])
    banded = first.select("rep", "n_shingles", F.explode("bands").alias("key"))
    # the pivot is the member least after a mix with the key, so that the buckets of a group have different pivots
    mixed = F.col("rep").bitwiseXOR(F.col("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.min(mixed).alias("least")).where("n > 1")
    multi = scratch.keep(banded.join(buckets, "key").select("key", "rep", "n_shingles", F.col("least").bitwiseXOR(F.col("key")).alias("pivot"), "n"))
    needed = scratch.keep(multi.select(F.col("rep").alias("doc_id")).distinct())
    few = needed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sets = scratch.keep(some.select("doc_id", "n_shingles", "shingles").join(F.broadcast(needed) if few else needed, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    pairs = multi.where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    stars = scratch.keep(confirmed(pairs, sets, percent))
    found = components(scratch, stars)
    # buckets of two are done; larger ones are, if the stars joined all their members
    apart = scratch.keep(multi.where("n > 2").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("component")))
    open_ = scratch.keep(apart.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"))
    few = open_.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # a hot bucket then stays in the tasks that read it
    more = scratch.keep(rest(apart.join(F.broadcast(open_) if few else open_, "key", "left_semi"), sets, percent).distinct())
    scratch.drop(multi, needed, sets, apart, open_)
    found = components(scratch, stars.unionByName(more)).withColumnRenamed("id", "rep")
    named = classes.join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    if keys is not None:
        named = named.join(keys.select(F.col("key").alias("component_id"), "doc_id"), "component_id").select("digest", F.col("doc_id").alias("component_id"))
    out = sketch.select("doc_id", "text_md5", "n_shingles", "digest").join(named, "digest", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_md5")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: the size of its set, its group, whether it is kept. Cases as in near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=3, percent=85, bands=28, rows=6).drop("text_md5")


QUERIES = {"op9_minhash": op9_minhash}

ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN twoway l ON r.b = l.a),
least_ AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m AS component_id, m = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least_ ON a = d.doc_id
"""
ORACLES = {"op9_minhash": ORACLE}
