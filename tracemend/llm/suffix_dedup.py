"""Exact substring deduplication with a sparse suffix array.

A string of `length` bytes is removed where it also starts earlier. Each such string holds one anchor: the leftmost
position of the smallest hash among its `gram`-byte substrings. Equal strings have equal anchors at equal offsets, so
only suffixes that begin at anchors, one in about thirty, need sorting:

1. Anchors are gathered with the range of strings that each one owns and a hash of the bytes they span. Within slices,
   then within hash buckets, an anchor whose gram occurs once drops out, and one whose span occurred earlier is removed
   whole. A slice sends two records of a gram at most, so a gram that most documents share stays small.
2. The anchors left share their gram but not their span. Their suffixes are range-partitioned by leading bytes with
   sampled splitters, sorted in each bucket by multikey quicksort, and compared through the lengths of common prefixes.
3. Strings whose prefix class touches the edge of a bucket are compared across boundaries by their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.llm.common import Scratch, fields_of, fresh, map_arrow, row_keys, table, text_slices

SLICE_BYTES = 8 << 20  #: text whose anchors a task compares before it sends them
BUCKET_BYTES = 3 << 20  #: text for each hash bucket
SUFFIXES = 15_000  #: suffixes that a range bucket aims at
CELL_SUFFIXES = 20_000  #: suffixes for each cell of strings that meet across buckets
BROADCAST_ROWS = 500_000  #: up to so many ids are broadcast; more are joined by a shuffle
BROADCAST_SPANS = 1_000_000

ASK = np.dtype([("gram", "<u8"), ("span", "<u8"), ("doc", "<i8"), ("a", "<u4"), ("back", "u1"), ("more", "u1")])
TOLD = np.dtype([("doc", "<i8"), ("a", "<u4"), ("back", "u1"), ("more", "u1"), ("whole", "u1")])
EDGE = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("start", "<u4")])
SPANS = "array<struct<start:int,end:int>>"

_draw = np.random.default_rng(11)
LETTER, LETTER2 = (_draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
ODD = [int(x) * 2 + 1 for x in _draw.integers(1 << 61, 1 << 63, 16)]
BASE = np.uint64(ODD[15])
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each position, from hashes of halves."""
    level, out, done = LETTER[raw], None, 0
    for bit in range(gram.bit_length()):
        if gram >> bit & 1:
            n = 1 << bit
            # the parts of a gram lie end to end, the shortest first
            out = level.copy() if out is None else out[: len(level) - done] * np.uint64(ODD[bit]) + level[done:][: max(0, len(level) - done)]
            done += n
        if gram >> (bit + 1):
            level = level[: -(1 << bit)] * np.uint64(ODD[bit + 8]) + level[1 << bit :]
    return out[: len(raw) - gram + 1]


def leftmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Offset (0 to width - 1) of the leftmost smallest value among `width` values from each position."""
    value, offset, have = h, np.zeros(len(h), np.uint8), 1
    while have < width:
        step = min(have, width - have)
        left, right = value[:-step], value[step:]
        offset = np.where(left <= right, offset[:-step], offset[step:] + np.uint8(step))
        value = np.minimum(left, right)
        have += step
    return offset


def anchors(texts: list[bytes], ids: list[int], length: int, gram: int) -> np.ndarray:
    """The anchors of some texts as ASK records; `back` bytes before and `more` starts after the first owned string."""
    kept = [(t, i) for t, i in zip(texts, ids, strict=True) if len(t) >= length and i is not None]
    if not kept:
        return np.empty(0, ASK)
    raw = np.frombuffer(b"".join(t for t, _ in kept), np.uint8)
    sizes = np.array([len(t) for t, _ in kept], np.int64)
    begin = np.cumsum(sizes) - sizes
    h = gram_hashes(raw, gram)
    at = leftmost_minimum(h, length - gram + 1)  # for each start of `length` bytes
    anchor = np.arange(len(at), dtype=np.int64) + at
    inside = np.zeros(len(at) + 1, np.int32)
    np.add.at(inside, begin, 1)
    np.add.at(inside, np.minimum(begin + sizes - length + 1, len(at)), -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    owner = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    lo, a = starts[first], owner[first]
    hi = starts[np.append(first[1:], len(starts)) - 1]
    power = np.full(len(raw), BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER2[raw] * power)])
    inverse = np.full(len(raw), BASE_INVERSE, np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    out = np.empty(len(a), ASK)
    doc = np.searchsorted(begin, lo, side="right") - 1
    out["gram"] = h[a]
    out["span"] = (total[hi + length] - total[lo]) * inverse[lo] * np.uint64(ODD[14]) + (a - lo).astype(np.uint64) * np.uint64(ODD[13]) + (hi - lo).astype(np.uint64) * np.uint64(ODD[12])
    out["doc"] = np.array([i for _, i in kept], np.int64)[doc]
    out["a"] = a - begin[doc]
    out["back"], out["more"] = a - lo, hi - lo
    return out


def tell(x: np.ndarray, whole: bool) -> np.ndarray:
    out = np.empty(len(x), TOLD)
    for c in ("doc", "a", "back", "more"):
        out[c] = x[c]
    out["whole"] = whole
    return out


def settle(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in `x` of: repeats of an earlier span; the first of each span; whether its gram has several spans; rank of that span in its gram."""
    order = np.lexsort((x["a"], x["doc"], x["span"], x["gram"])) if len(x) else np.empty(0, np.int64)
    gram, span = x["gram"][order], x["span"][order]
    new_gram = np.ones(len(x), bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    new = new_gram.copy()
    new[1:] |= span[1:] != span[:-1]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))]
    later = (x["doc"][order] != x["doc"][lead]) | (x["a"][order] != x["a"][lead])  # a repeated row is no repeat
    first = np.flatnonzero(new)
    group = np.cumsum(new_gram)[first] - 1
    spans = np.bincount(group)
    rank = np.arange(len(first)) - (np.cumsum(spans) - spans)[group] if len(first) else np.empty(0, np.int64)
    return order[later], order[first], spans[group] > 1 if len(first) else np.empty(0, bool), rank


def gather(docs: DataFrame, buckets: int, length: int, find: Callable[[list[bytes], list[int]], np.ndarray]) -> DataFrame:
    """doc_id, spans that are removed whole, anchors whose suffixes must be sorted.

    find: the ASK records of some texts; a record spans `more` + `length` bytes from `back` bytes before `a`.
    """

    def send(batches: Iterator[dict]) -> Iterator[dict]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> dict:
            x = np.concatenate(held) if held else np.empty(0, ASK)
            repeats, first, several, rank = settle(x)
            mine = task * (1 << 31) + n
            ask = x[first[~several | (rank < 2)]]  # two spans show that a gram has several
            known = [tell(x[repeats], True), tell(x[first[several & (rank >= 2)]], False)]
            # anchors have small hashes, so they are mixed before they are dealt out
            bucket = ((ask["gram"] * np.uint64(ODD[8]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            out = {"bucket": [*some, (task * 7919 + n) % buckets], "slice": [mine] * (len(some) + 1)}
            out["asked"] = [*(ask[order[edges[b] : edges[b + 1]]].tobytes() for b in some), b""]
            out["told"] = [*([b""] * len(some)), np.concatenate(known).tobytes()]
            return out

        for b in batches:
            for ids, texts in text_slices(b["doc_id"], b["text"], 256 << 10):
                raw = [t.encode() for t in texts]
                held.append(find(raw, ids))
                size += sum(map(len, raw))
                if size >= SLICE_BYTES:
                    yield flush()
                    n, held, size = n + 1, [], 0
        if held:
            yield flush()

    def answer(rows: pa.Table) -> pa.Table:
        slices = np.asarray(rows["slice"])
        asked = [np.frombuffer(x.as_buffer(), ASK) for x in rows["asked"]]
        told = [np.frombuffer(x.as_buffer(), TOLD) for x in rows["told"]]
        x = np.concatenate(asked)
        of = np.repeat(slices, [len(y) for y in asked])
        repeats, first, several, _ = settle(x)
        found = np.concatenate([tell(x[repeats], True), tell(x[first[several]], False)])
        back = of[np.concatenate([repeats, first[several]])]
        order = np.argsort(back, kind="stable")
        names, begin = np.unique(back[order], return_index=True)
        ends = np.append(begin[1:], len(back))[: len(begin)]
        out_slice = [int(s) for s in names] + [int(s) for s, t in zip(slices, told, strict=True) if len(t)]
        out = [found[order[i:j]].tobytes() for i, j in zip(begin, ends, strict=True)] + [t.tobytes() for t in told if len(t)]
        return pa.table({"slice": pa.array(out_slice, pa.int64()), "told": pa.array(out, pa.binary())})

    def by_document(rows: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(r.as_buffer(), TOLD) for r in rows["told"]])
        x = x[np.lexsort((x["a"], x["doc"]))]
        docs, begin = np.unique(x["doc"], return_index=True)
        spans, rest = [], []
        for i, j in zip(begin, np.append(begin[1:], len(x))[: len(begin)], strict=True):
            d = x[i:j]
            w = d[d["whole"] == 1]
            lo = w["a"].astype(np.int64) - w["back"]
            spans.append(merge(lo, lo + w["more"] + length))
            rest.append(d[d["whole"] == 0].tobytes())
        struct = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "spans": pa.array(spans, pa.list_(struct)), "rest": pa.array(rest, pa.binary())})

    sent = map_arrow(docs, "bucket long, slice long, asked binary, told binary", send)
    told = sent.groupBy("bucket").applyInArrow(answer, "slice long, told binary")
    return told.groupBy("slice").applyInArrow(by_document, f"doc_id long, spans {SPANS}, rest binary")


def merge(lo: np.ndarray, hi: np.ndarray) -> list[dict]:
    """Sorted intervals as maximal runs."""
    if not len(lo):
        return []
    reach = np.maximum.accumulate(hi)
    first = np.flatnonzero(np.append(True, lo[1:] > reach[:-1]))
    return [{"start": int(s), "end": int(e)} for s, e in zip(lo[first], reach[np.append(first[1:], len(lo)) - 1], strict=True)]


def suffixes(docs: DataFrame, told: DataFrame, length: int) -> DataFrame:
    """The anchors to sort, each with the bytes from its first owned string to the end of its last."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {c: [] for c in ("doc_id", "a", "back", "more", "suffix", "before")}
            for i, t, rest in zip(b["doc_id"].to_pylist(), b["text"], b["rest"], strict=True):
                raw = t.as_buffer().to_pybytes()
                for d in np.frombuffer(rest.as_buffer(), TOLD):
                    a, back, more = int(d["a"]), int(d["back"]), int(d["more"])
                    for c, v in zip(out, (i, a, back, more, raw[a : a - back + more + length], raw[a - back : a]), strict=True):
                        out[c].append(v)
                if len(out["a"]) > 20_000:
                    yield out
                    out = {c: [] for c in out}
            yield out

    met = docs.join(told.where("octet_length(rest) > 0").select("doc_id", "rest"), "doc_id")
    return map_arrow(met, "doc_id long, a int, back int, more int, suffix binary, before binary", each)


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of 8-byte characters: each round orders, among ties only, by the next character."""
    order, group = np.arange(len(words)), np.zeros(len(words), np.int64)
    tied = np.arange(len(words))
    for d in range(words.shape[1]):
        if not len(tied):
            break
        rows, g = order[tied], group[tied]
        key = words[rows, d]
        p = np.lexsort((key, g))
        order[tied] = rows[p]
        g, key = g[p], key[p]
        new = np.ones(len(tied), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
    return order


def padded(parts: list[bytes], width: int, backwards: bool = False) -> np.ndarray:
    return np.frombuffer(b"".join((p[::-1] if backwards else p).ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def sort_bucket(doc: np.ndarray, a: np.ndarray, back: np.ndarray, more: np.ndarray, suffix: list[bytes], before: list[bytes], length: int, gram: int) -> tuple[np.ndarray, list[tuple]]:
    """Removed starts (doc, start) of a bucket, and the earliest of each string that may also lie beyond its edges."""
    order = np.lexsort((a, doc))
    doc, a, back, more = doc[order], a[order], back[order], more[order]
    suffix, before = [suffix[i] for i in order], [before[i] for i in order]
    n, offsets = len(doc), length - gram + 1
    text = padded(suffix, -(-length // 8) * 8)
    sa = multikey_sort(text.view(">u8"))
    differ = text[sa[1:]] != text[sa[:-1]]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1]) if n > 1 else np.empty(0, np.int64)
    lcp = np.append(0, lcp)
    # class of the prefix of each length from gram to length, as the number of the first suffix of the class
    classes = np.cumsum(lcp[None, :] < np.arange(gram, length + 1)[:, None], axis=1, dtype=np.int32)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    inf = np.array([text.shape[1]])
    to_first = np.minimum.accumulate(np.append(inf, lcp[1:]))[rank]
    to_last = np.minimum.accumulate(np.append(inf, lcp[1:][::-1]))[::-1][rank]
    left = padded(before, offsets, backwards=True)
    left_hash = np.zeros((n, offsets), np.uint64)
    for o in range(1, offsets):
        left_hash[:, o] = left_hash[:, o - 1] * BASE + LETTER2[left[:, o - 1]]
    count = more.astype(np.int64) + 1
    of = np.repeat(np.arange(n), count)
    start = a[of] - back[of] + (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    o = a[of] - start
    c = classes[offsets - 1 - o, rank[of]].astype(np.uint64)
    key = (left_hash[of, o] * np.uint64(ODD[11]) + c * np.uint64(ODD[10]) + o.astype(np.uint64)) * np.uint64(ODD[9])
    key ^= key >> np.uint64(29)
    by = np.argsort(key, kind="stable")  # starts are numbered in order, so the first of a key is the earliest
    new = np.ones(len(by), bool)
    new[1:] = key[by][1:] != key[by][:-1]
    lead = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    later = (doc[of[by]] != doc[of[lead]]) | (start[by] != start[lead])
    removed = np.sort(by[later])
    first = by[new]
    edge = first[np.maximum(to_first, to_last)[of[first]] >= length - o[first]]
    open_ = [(int(doc[of[i]]), int(start[i]), before[of[i]][len(before[of[i]]) - int(o[i]) :] + suffix[of[i]][: length - int(o[i])]) for i in edge]
    return np.stack([doc[of[removed]], start[removed]], axis=1), open_


def as_runs(doc: np.ndarray, start: np.ndarray, length: int) -> dict:
    """Removed starts, sorted by document and start, as spans (doc_id, start, end)."""
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return {"doc_id": doc[first], "start": start[first], "end": start[last] + length}


def compare_suffixes(scratch: Scratch, rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans (doc_id, start, end) that earlier strings cover, from anchors that share their gram.

    A bucket sends each distinct string that may also lie beyond its edges once, as a 128-bit digest, in cells by that digest.
    """
    n = rows.count()
    ranged = rows.repartitionByRange(max(1, -(-n // SUFFIXES)), "suffix", "doc_id", "a")
    cells = max(8, -(-n // CELL_SUFFIXES))

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        held = list(batches)
        if not held:
            return
        cat = lambda c: np.concatenate([np.asarray(b[c]) for b in held]).astype(np.int64)
        parts = lambda c: [x for b in held for x in b[c].to_pylist()]
        removed, open_ = sort_bucket(cat("doc_id"), cat("a"), cat("back"), cat("more"), parts("suffix"), parts("before"), length, gram)
        if len(removed):
            spans = as_runs(removed[:, 0], removed[:, 1], length)
            yield {**spans, "cell": [None] * len(spans["start"]), "edge": [None] * len(spans["start"])}
        if open_:
            x = np.empty(len(open_), EDGE)
            key = np.frombuffer(b"".join(hashlib.blake2b(o[2], digest_size=16).digest() for o in open_), "<u8").reshape(-1, 2)
            x["one"], x["two"] = key[:, 0], key[:, 1]
            x["doc"], x["start"] = [o[0] for o in open_], [o[1] for o in open_]
            cell = (x["one"] % np.uint64(cells)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            names, begin = np.unique(cell[order], return_index=True)
            none = [None] * len(names)
            yield {"doc_id": none, "start": none, "end": none, "cell": names, "edge": [x[order[i:j]].tobytes() for i, j in zip(begin, np.append(begin[1:], len(order)), strict=True)]}

    def later(rows: pa.Table) -> pa.Table:
        """Of a cell's strings all but the earliest of each."""
        x = np.concatenate([np.frombuffer(r.as_buffer(), EDGE) for r in rows["edge"]])
        x = x[np.lexsort((x["start"], x["doc"], x["two"], x["one"]))]
        new = np.ones(len(x), bool)
        new[1:] = (x["one"][1:] != x["one"][:-1]) | (x["two"][1:] != x["two"][:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        again = (x["doc"] != x["doc"][lead]) | (x["start"] != x["start"][lead])  # a repeated row is no repeat
        x = np.unique(x[again][["doc", "start"]])
        out = as_runs(x["doc"].astype(np.int64), x["start"].astype(np.int64), length)
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "start": pa.array(out["start"], pa.int32()), "end": pa.array(out["end"], pa.int32())})

    found = scratch.keep(map_arrow(ranged, "doc_id long, start int, end int, cell long, edge binary", each))
    met = found.where("edge is not null").select("cell", "edge").groupBy("cell").applyInArrow(later, "doc_id long, start int, end int")
    return found.where("edge is null").select("doc_id", "start", "end").unionByName(met)


def keyed(scratch: Scratch, docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Texts of at least `least` bytes with an id, as (doc_id: a key in order of ids, text); their (doc_id, digest, n bytes), stored; keys where some id has several texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= least))
    digest = F.unhex(F.md5("text")).alias("digest")
    brief = scratch.keep(docs.select("doc_id", digest, F.octet_length("text").alias("n")))
    keys = row_keys(scratch, brief)
    if keys is not None:
        docs = docs.select("doc_id", digest, "text").join(keys, ["doc_id", "digest"]).select(F.col("key").alias("doc_id"), "text")
        brief = scratch.keep(brief.join(keys, ["doc_id", "digest"]).select(F.col("key").alias("doc_id"), "digest", "n"))
    return docs, brief, keys


def named(spans: DataFrame, keys: DataFrame | None) -> DataFrame:
    """Spans by key as spans by doc_id, with the digest of the text where an id has several."""
    if keys is None:
        return spans
    return keys.join(spans.withColumnRenamed("doc_id", "key"), "key").select("doc_id", "digest", "spans")


def repeated_spans(docs: DataFrame, length: int = 100, gram: int = 36) -> DataFrame:
    """doc_id and spans: bytes covered by a string of `length` bytes that also starts earlier; only documents with some.

    Earlier means a smaller doc_id, or the same document and an earlier start. Texts are UTF-8 bytes, null counts as
    empty, and texts under `length` bytes have no strings. Rows with a null doc_id take no part. Rows that repeat an
    id and text are one document. Where an id has several texts, they are documents in order of their md5, and `digest`
    (that md5) tells them apart. Spans of a document may overlap and have no order. Equal strings are those with equal
    64-bit hashes of their grams and spans: two different ones are taken for equal with a chance of 2**-64 a pair that
    meets, or of 2**-128 for spans removed whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    docs, brief, keys = keyed(scratch, docs, length)
    first = scratch.keep(brief.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("copies > 1"))
    few = first.count() <= BROADCAST_ROWS  # a large group of copies then stays in the tasks that read it
    copies = scratch.keep(brief.join(F.broadcast(first) if few else first, "digest").where("doc_id > least").select("doc_id", "n"))
    few = copies.count() <= BROADCAST_ROWS
    total = brief.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ids = copies.select("doc_id")
    single = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")
    told = scratch.keep(gather(single, max(8, -(-total // BUCKET_BYTES)), length, lambda texts, ids: anchors(texts, ids, length, gram)))
    needed = told.where("octet_length(rest) > 0").select("doc_id").distinct()
    few = needed.count() <= BROADCAST_ROWS
    some = single.join(F.broadcast(needed), "doc_id", "left_semi") if few else single
    rows = scratch.keep(suffixes(some, told, length))
    found = scratch.keep(compare_suffixes(scratch, rows, length, gram))
    span = lambda start, end: F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
    every = (
        told.where(F.size("spans") > 0).select("doc_id", "spans")
        .unionByName(found.select("doc_id", span(F.col("start"), F.col("end")).alias("spans")))
        .unionByName(copies.select("doc_id", span(F.lit(0), F.col("n")).alias("spans")))
    )
    out = scratch.keep(named(every.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans")), keys))  # bounded by the document's length
    scratch.drop(brief, first, told, rows, found, copies)
    return out


def cut_spans(docs: DataFrame, spans: DataFrame, whole_characters: bool = False) -> DataFrame:
    """All columns of docs with text replaced by kept (binary), and removed: the maximal removed runs.

    Columns of docs named kept or removed give way to these. Spans are matched by doc_id, and by the text's digest where
    they have one; each of repeated rows is cut, a row with a null doc_id is kept whole, a null text gives an empty kept.
    whole_characters: a run gives back the bytes of characters that it covers in part, so that kept stays UTF-8.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    if not hasattr(spans, "scratch_path"):
        spans = scratch.keep(spans)
    few = spans.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0] <= BROADCAST_SPANS
    docs = docs.drop("kept", "removed")
    of, print_, got_ = (fresh(docs.columns, c) for c in ("of", "print", "spans"))
    fields = fields_of(docs, "text")
    on = F.col("doc_id").cast("long") == F.col(of)
    right = spans.select(F.col("doc_id").alias(of), F.col("spans").alias(got_), *([F.col("digest").alias(print_)] if "digest" in spans.columns else []))
    if print_ in right.columns:
        on &= F.unhex(F.md5("text")) == F.col(print_)
    met = docs.join(F.broadcast(right) if few else right, on, "left").drop(of, print_)

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            n = len(b["text"])
            step = max(1, min(n, n * (8 << 20) // max(1, b["text"].nbytes)))
            for i in range(0, n, step):
                kept, removed = [], []
                for t, got in zip(b["text"].slice(i, step), b[got_].slice(i, step).to_pylist(), strict=True):
                    raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                    got = sorted((s["start"], s["end"]) for s in got or ())
                    runs = merge(np.array([s for s, _ in got], np.int64), np.array([e for _, e in got], np.int64))
                    if whole_characters:
                        for r in runs:
                            while r["start"] < r["end"] and raw[r["start"]] & 0xC0 == 0x80:
                                r["start"] += 1
                            while r["end"] > r["start"] and r["end"] < len(raw) and raw[r["end"]] & 0xC0 == 0x80:
                                r["end"] -= 1
                    at, parts = 0, []
                    for r in runs:
                        parts.append(raw[at : r["start"]])
                        at = r["end"]
                    kept.append(b"".join([*parts, raw[at:]]))
                    removed.append(runs)
                yield {**{c: v.slice(i, step) for c, v in b.items() if c not in ("text", got_)}, "kept": kept, "removed": removed}

    return map_arrow(met, f"{fields}, kept binary, removed {SPANS}", each)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its bytes, those removed, in how many spans, and the digest of the rest. Nulls, empties and repeats as in repeated_spans."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    cut = cut_spans(docs, repeated_spans(docs))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))
    return cut.select("doc_id", (F.octet_length("kept") + lost).alias("n_bytes"), lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}

ORACLE = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
places AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 99)) AS i FROM h WHERE len(x) >= 200),
strings AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS s FROM places JOIN h USING (doc_id)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM strings) WHERE k > 1),
gaps AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS cut FROM later),
numbered AS (SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gaps),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi, g FROM numbered GROUP BY doc_id, g),
pieces AS (SELECT doc_id, g, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs),
cut AS (
  SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
    string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept
  FROM pieces JOIN h USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)
"""
ORACLES = {"op1_suffix_dedup": ORACLE}
