"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes; a chunk ends where its top bits are 0, so boundaries follow the content and settle
again soon after an insertion. Chunks with equal digests are kept once, at the earliest place.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.llm.common import Scratch, table
from tracemend.llm.suffix_dedup import ASK, BUCKET_BYTES, SPANS, cut_spans, gather, keyed, named

GEAR = np.random.default_rng(23).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """Gear hash after each byte; 32 bits, so it covers the last 32 bytes. By doubling: h(2n) = h(n) + h(n, n back) << n."""
    h = GEAR[raw]
    for n in (1, 2, 4, 8, 16):
        h[n:] = h[n:] + (h[:-n] << np.uint32(n))
    return h


def boundaries(cuts: list[int], size: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of a text: the first cut at `least` bytes or more, at most `most`; a short tail joins the last."""
    ends, at = [], 0
    for c in cuts:
        while c - at > most and size - at >= most + least:
            at += most
            ends.append(at)
        if c - at >= least and size - c >= least:
            at = c
            ends.append(at)
    while size - at >= most + least:
        at += most
        ends.append(at)
    return [*ends, size]


def chunks(texts: list[bytes], ids: list[int], least: int, most: int, bits: int) -> np.ndarray:
    """The chunks of some texts, as records for the exchange."""
    out, digests = [], []
    for raw, i in zip(texts, ids, strict=True):
        if len(raw) < least or i is None:
            continue
        cuts = (np.flatnonzero(gear_hashes(np.frombuffer(raw, np.uint8)) >> np.uint32(32 - bits) == 0) + 1).tolist()
        at = 0
        for end in boundaries(cuts, len(raw), least, most):
            digests.append(hashlib.blake2b(raw[at:end], digest_size=16).digest())
            out.append((i, at, end - at - least))
            at = end
    x = np.zeros(len(out), ASK)
    if out:
        key = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        x["gram"], x["span"] = key[:, 0], key[:, 1]
        x["doc"], x["a"], x["more"] = (np.array(c, np.int64) for c in zip(*out, strict=True))
    return x


def repeated_chunks(docs: DataFrame, least: int = 32, most: int = 128, bits: int = 4, least_run: int = 100) -> DataFrame:
    """doc_id and spans of the chunks that also stand earlier: in a smaller doc_id or before in the same document.

    Chunks have `least` bytes and a mean of 2**bits more, `most` and a tail of under `least` at most (which must fit a byte above
    `least`). Repeated chunks go where they run on for `least_run` bytes together: a phrase of one chunk is no passage. Texts under `least` bytes, nulls among them, and rows with a null doc_id are left whole. Rows that repeat
    an id and text are one document; where an id has several texts, `digest` (md5) tells them apart and orders them. Only
    documents with such chunks get a row.
    """
    if most - 1 > 255 or bits > 16:
        raise ValueError("most - 1 must fit a byte")
    scratch = Scratch(docs.sparkSession, "chunks")
    docs, brief, keys = keyed(scratch, docs, least)
    total = brief.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    told = scratch.keep(gather(docs, max(8, -(-total // BUCKET_BYTES)), least, lambda texts, ids: chunks(texts, ids, least, most, bits)))
    long = F.filter("spans", lambda r: r["end"] - r["start"] >= least_run)  # spans of a document are its maximal runs
    return named(told.select("doc_id", long.alias("spans")).where(F.size("spans") > 0).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).cast(SPANS).alias("spans")), keys)


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its bytes, those removed, in how many spans, and the digest of the rest. Nulls, empties and repeats as in repeated_chunks."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    cut = cut_spans(docs, repeated_chunks(docs))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))
    return cut.select("doc_id", (F.octet_length("kept") + lost).alias("n_bytes"), lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_chunk_dedup": op6_chunk_dedup}
ORACLES: dict[str, str] = {}
