"""SimHash document fingerprints.

Each term's 64-bit hash votes with the term's weight on 64 signed bits. Fingerprints within a small Hamming radius are
found through block tables: the bits are cut into blocks, and for each choice of blocks that must be equal a table
is keyed by them, permuted to the front.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemend.llm.common import Scratch, map_arrow, table, text_slices
from tracemend.llm.minhash import WordHashes, mix

BITS = 64
FADE_WORDS = 8  #: runs of four bytes vote too, with a weight that falls by e for each so many words
FADED = 2.0**-24  #: a weight beside which a word's is not changed in single precision


class Fingerprinter:
    def __init__(self):
        self.hashes = WordHashes()

    def __call__(self, text: str) -> bytes:
        """8 bytes; all 0 for a text without words."""
        raw = text.encode().lower()
        words = raw.split()
        if not words:
            return bytes(8)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            groups = [(np.concatenate([mix(h), mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])]), 1.0)]
            if (fade := math.exp(-len(words) / FADE_WORDS)) >= FADED:
                b = np.frombuffer(raw, np.uint8).astype(np.uint64)
                groups.append((mix(b[:-3] + (b[1:-2] << np.uint64(8)) + (b[2:-1] << np.uint64(16)) + (b[3:] << np.uint64(24)) + np.uint64(1 << 40)), fade))
        votes, total = np.zeros(BITS, np.float32), 0.0
        for terms, part in groups:
            term, count = np.unique(terms, return_counts=True)
            weight = (part * (1 + np.log2(count))).astype(np.float32)
            for at in range(0, len(term), 4096):
                bits = np.unpackbits(term[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1)
                votes += weight[at : at + 4096] @ bits
            total += weight.sum()
        return np.packbits(votes * 2 > total).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def edit(text: str, other: str) -> str:
    """The last half of the characters replaced by the first as many of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(make: Fingerprinter, doc_id, text: str, print_: bytes, other: str, other_print: bytes) -> tuple:
    changed = edit(text, other)
    made = make(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), print_.hex(), made.hex(), likeness(print_, made), likeness(print_, other_print)


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its text edited with the next one's, by descending doc_id.

    A range partition and a sort put neighbours side by side; each partition's last document meets the first of the
    next one in a join of as many rows as there are partitions. Null texts count as empty, null ids come last, rows
    that repeat an id stand side by side, by a hash of their texts. A single document is its own next.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc(), F.col("text").desc()]  # the hash spreads rows that repeat an id
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    names = [f.split()[0] for f in ROW.split(", ")]

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        make, part, last, head = Fingerprinter(), TaskContext.get().partitionId(), None, []
        for b in batches:
            for ids, texts in text_slices(b["doc_id"], b["text"], 2 << 20):
                out = []
                for i, t in zip(ids, texts, strict=True):
                    now = (i, t, make(t))
                    if last is None:
                        head = [now]
                    else:
                        out.append(compared(make, *last, *now[1:]))
                    last = now
                yield rows(out, part, [("first", x) for x in head])
                head = []
        if last is not None:
            yield rows([], part, [("last", last)])

    def rows(out: list[tuple], part: int, ends: list) -> dict:
        got = dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {c: [] for c in names}
        for _, (i, _, p) in ends:
            for c, v in zip(names, (i, None, None, p.hex(), None, None, None), strict=True):
                got[c].append(v)
        k = len(out)
        return {**got, "part": [part] * (k + len(ends)), "end": [None] * k + [e for e, _ in ends], "text": [None] * k + [x[1] for _, x in ends]}

    kept = scratch.keep(map_arrow(ranged, f"{ROW}, part int, end string, text string", each))
    first = kept.where("end = 'first'").select(F.col("part").alias("to"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    parts = kept.where("end = 'first'").select("part")
    order = parts.withColumn("to", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))))  # a number for each partition
    pairs = kept.where("end = 'last'").select("part", "doc_id", "text", "fingerprint").join(order, "part").join(first, "to")

    def meet(batches: Iterator[dict]) -> Iterator[dict]:
        make = Fingerprinter()
        for b in batches:
            got = zip(*(b[c].to_pylist() for c in ("doc_id", "text", "fingerprint", "next_text", "next_print")), strict=True)
            yield dict(zip(names, map(list, zip(*(compared(make, i, t, bytes.fromhex(p), u, bytes.fromhex(q)) for i, t, p, u, q in got), strict=True)), strict=True))

    return kept.where("end is null").select(*names).unionByName(map_arrow(pairs, ROW, meet))


def bits(fingerprint: str) -> F.Column:
    """A fingerprint in hex as a signed 64-bit number."""
    half = lambda at: F.conv(F.substring(fingerprint, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def block_keys(fingerprint: F.Column, radius: int, blocks: int) -> F.Column:
    """An array of keys, one for each table: its number and the bits of the blocks that must be equal."""
    edge = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.xxhash64(fingerprint.bitwiseAND(F.lit(mask)), F.lit(t)))
    return F.array(*keys)


def within_radius(queries: DataFrame, all_: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Rows (query, fingerprint, distance) of distinct 64-bit fingerprints (column fingerprint, long) that are close.

    With `blocks` blocks, two fingerprints that differ in `radius` bits agree in blocks - radius blocks at least, so
    one table finds each pair; none is lost. Keys are hashed to 64 bits and each candidate is checked. Nulls match nothing.
    """
    q = queries.select(F.col("fingerprint").alias("query")).where("query is not null").distinct()
    a = all_.select("fingerprint").where("fingerprint is not null").distinct()
    q, a = q.select("query", F.explode(block_keys(F.col("query"), radius, blocks)).alias("key")), a.select("fingerprint", F.explode(block_keys(F.col("fingerprint"), radius, blocks)).alias("key"))
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    return q.join(a, (q["key"] == a["key"]) & (distance <= radius)).select("query", "fingerprint", distance.cast("int").alias("distance")).distinct()


def neighbours(queries: DataFrame, all_: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(bits, n_near): for each distinct fingerprint `bits` of queries, how many rows of `all_` lie within `radius` bits of it.

    Only distinct fingerprints meet in the block tables, so a group of equal ones, however large, is one row there. Nulls
    match nothing and have no row; repeated rows of `all_` each count.
    """
    sizes = all_.where("bits is not null").groupBy("bits").agg(F.count("*").alias("rows"))
    near = within_radius(queries.select(F.col("bits").alias("fingerprint")), sizes.select(F.col("bits").alias("fingerprint")), radius, blocks)
    return near.join(sizes.withColumnRenamed("bits", "fingerprint"), "fingerprint").groupBy(F.col("query").alias("bits")).agg(F.sum("rows").alias("n_near"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; n_near, for ids divisible by 50 (null for others): how many other documents lie within 3 bits.

    Null, empty and repeated rows as in with_next.
    """
    prints = with_next(table(spark, sf_dir, "documents", "doc_id", "text")).withColumn("bits", bits("fingerprint"))
    asks = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    asked = prints.where(asks)
    found = asked.join(neighbours(asked, prints), "bits", "left").select(*prints.columns, (F.col("n_near") - 1).alias("n_near"))
    return found.unionByName(prints.where(~asks).withColumn("n_near", F.lit(None).cast("long"))).drop("bits")


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}
