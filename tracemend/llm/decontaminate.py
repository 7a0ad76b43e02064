"""Benchmark decontamination with a distributed positional inverted index.

The training text is indexed in shards of a few MB: for each term that occurs in the benchmark, the sorted word
positions in the shard. The index is stored in the shared folder and counted over the whole corpus. Each benchmark
window then intersects its terms' lists, shifted by their offsets, beginning with the term that is rarest in the
corpus; most windows end at an empty first list. No posting leaves its shard, so no term is too frequent for a task.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.llm.common import Scratch, map_arrow, table, text_slices

WINDOW = 10
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20  #: benchmark text that is broadcast at once; a larger benchmark takes several rounds

#: a-z, 0-9 and all above 7F are word characters; A-Z are lower-cased
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def build_index(docs: DataFrame, terms: dict[bytes, int], gap: int) -> DataFrame:
    """A row for each shard: its documents, their lengths and the md5 of their texts, and the concatenated postings of each term."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        shard, find = TaskContext.get().partitionId() << 32, known.value.get
        for b in batches:
            for ids, texts in text_slices(b["doc_id"], b["text"], SHARD_BYTES):
                found, sizes = [], []
                for t in texts:
                    w = words(t)
                    sizes.append(len(w))
                    found.append(np.fromiter((find(x, -1) for x in w), np.int32, len(w)))
                    found.append(np.full(gap, -1, np.int32))
                flat = np.concatenate(found)
                at = np.flatnonzero(flat >= 0).astype(np.int32)
                at = at[np.argsort(flat[at], kind="stable")]
                term, count = np.unique(flat[at], return_counts=True)
                yield {"shard": [shard], "docs": [ids], "prints": [[hashlib.md5(t.encode()).digest() for t in texts]], "sizes": [sizes], "terms": [term], "counts": [count], "positions": [at.tobytes()]}
                shard += 1

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "shard long, docs array<long>, prints array<binary>, sizes array<int>, terms array<int>, counts array<int>, positions binary", each)


def near(first: np.ndarray, lists: list[np.ndarray], slop: int) -> np.ndarray:
    """Of the starts `first`, those that have a start of each list within `slop`."""
    for other in lists:
        if not len(first) or not len(other):
            return first[:0]
        i = np.searchsorted(other, first - slop)
        first = first[(i < len(other)) & (other[np.minimum(i, len(other) - 1)] <= first + slop)]
    return first


def search(index: DataFrame, windows: list[tuple[list[int], list[str]]], counts: dict[int, int], gap: int, slop: int, hits_only: bool) -> DataFrame:
    """For each document, or each with a hit: n_words, merged runs of hit words, items with an exact window, items with a loose one only."""
    order = []
    for ids, items in windows:
        offsets = sorted(range(len(ids)), key=lambda i: (counts.get(ids[i], 0), i))
        if all(counts.get(t, 0) for t in ids):
            order.append(([(ids[i], i) for i in offsets], len(ids), items))
    shared = index.sparkSession.sparkContext.broadcast(order)  # bounded by BLOCK_BYTES

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for shard, ids, prints, sizes, terms, counted, blob in zip(b["shard"], b["docs"], b["prints"], b["sizes"], b["terms"], b["counts"], b["positions"], strict=True):
                ids, prints, sizes = ids.as_py(), prints.as_py(), np.array(sizes.as_py(), np.int64)
                at, ends = np.frombuffer(blob.as_buffer(), np.int32).astype(np.int64), np.cumsum(np.array(counted.as_py(), np.int64))
                begins = np.concatenate([[0], np.cumsum(sizes + gap)])
                lists = {t: at[e - n : e] for t, e, n in zip(terms.as_py(), ends, counted.as_py(), strict=True)}
                edge = np.zeros(begins[-1] + 1, np.int32)
                exact, loose = defaultdict(set), defaultdict(set)
                for plan, length, items in shared.value:
                    (t, i), *more = plan
                    if t not in lists:
                        continue
                    starts = lists[t] - i
                    around = near(starts, [lists.get(t, at[:0]) - i for t, i in more], slop) if slop else starts
                    for t, i in more:
                        if not len(starts):
                            break
                        other = lists.get(t, at[:0]) - i
                        k = np.searchsorted(other, starts)
                        starts = starts[(k < len(other)) & (other[np.minimum(k, len(other) - 1)] == starts)] if len(other) else starts[:0]
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + length, -1)
                    for where, out in ((starts, exact), (around if slop else starts[:0], loose)):
                        for d in np.unique(np.searchsorted(begins, where, side="right") - 1):
                            out[int(d)].update(items)
                flags = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
                lo, hi = np.flatnonzero(flags == 1), np.flatnonzero(flags == -1)
                runs = defaultdict(list)
                for x, y in zip(lo, hi, strict=True):
                    d = int(np.searchsorted(begins, x, side="right") - 1)
                    runs[d].append([int(x - begins[d]), int(y - begins[d])])
                some = sorted(runs.keys() | exact.keys() | loose.keys()) if hits_only else range(len(ids))
                yield {
                    "shard": [shard.as_py()] * len(some), "nth": some, "doc_id": [ids[d] for d in some], "text_md5": [prints[d] for d in some], "n_words": sizes[list(some)],
                    "runs": [runs.get(d, []) for d in some], "items": [sorted(exact.get(d, ())) for d in some], "near_items": [sorted(loose.get(d, set()) - exact.get(d, set())) for d in some],
                }

    return map_arrow(index, "shard long, nth long, doc_id long, text_md5 binary, n_words long, runs array<array<int>>, items array<string>, near_items array<string>", each)


def merged(pdf):
    """Of several rounds over one benchmark: the union of runs and items of a document."""
    first = pdf.iloc[[0]].copy()
    runs: list[list[int]] = []
    for x, y in sorted(tuple(r) for many in pdf["runs"] for r in many):
        if runs and x <= runs[-1][1]:
            runs[-1][1] = max(y, runs[-1][1])
        else:
            runs.append([int(x), int(y)])
    exact = {i for many in pdf["items"] for i in many}
    first["runs"] = [runs]
    first["items"] = [sorted(exact)]
    first["near_items"] = [sorted({i for many in pdf["near_items"] for i in many} - exact)]
    return first


def item_terms(items: DataFrame) -> list[bytes]:
    """The distinct words of the benchmark: as many as its vocabulary, which is what the driver and the tasks hold of it at once."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for _, texts in text_slices(b["item_id"], b["text"]):
                yield {"word": sorted({w for t in texts for w in words(t)})}

    return sorted(bytes(r[0]) for r in map_arrow(items, "word binary", each).distinct().collect())


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 2) -> DataFrame:
    """One row for each row of `docs`: doc_id, text_md5, n_words, runs of hit words [from, to), items, near_items.

    A window is `window` consecutive words of an item, or all of a shorter one; runs cover each occurrence of each.
    near_items have a window whose words all stand within `slop` of their places, but none exactly. Null and empty
    texts have no words; items with a null id or text are left out; repeated rows of either table count as they are.
    The index is built once; a large benchmark is searched in rounds over it, and what several rounds found in a
    document is united.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rounds = int(-(-size // BLOCK_BYTES)) or 1
    if rounds > 1:
        items = scratch.keep(items)
    terms = {t: i for i, t in enumerate(item_terms(items))}
    index = scratch.keep(build_index(docs, terms, window))
    counts = dict(index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts")).collect())  # the benchmark's terms at most
    hits = None
    for r in range(rounds):
        grams: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).collect():
            w = words(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                grams[tuple(w[i : i + window])].add(item)
        found = search(index, [([terms[t] for t in g], sorted(i)) for g, i in sorted(grams.items())], counts, window, slop, rounds > 1)
        if rounds == 1:
            return found.drop("shard", "nth")
        found = scratch.keep(found)
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("shard", "nth").applyInPandas(merged, hits.schema).select("shard", "nth", "runs", "items", "near_items")
    every = index.select("shard", F.posexplode(F.arrays_zip("docs", "prints", "sizes")).alias("nth", "d"))
    every = every.select("shard", F.col("nth").cast("long").alias("nth"), F.col("d.docs").alias("doc_id"), F.col("d.prints").alias("text_md5"), F.col("d.sizes").cast("long").alias("n_words"))
    none = {c: F.expr(f"cast(array() as {t})") for c, t in hits.dtypes}
    out = every.join(hits, ["shard", "nth"], "left")
    return out.select("doc_id", "text_md5", "n_words", *(F.coalesce(c, none[c]).alias(c) for c in ("runs", "items", "near_items")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its words, those hit, the items found. Nulls, empties and repeats as in find_contamination."""
    found = find_contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r[1] - r[0]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


QUERIES = {"op10_decontaminate": op10_decontaminate}

ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (SELECT doc_id, item_id, p.n, i FROM places p JOIN windows w ON p.g = w.g AND p.n = w.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
ORACLES = {"op10_decontaminate": ORACLE}
