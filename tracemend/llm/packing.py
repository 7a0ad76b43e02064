"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of capacity/(k+1) to capacity/k tokens, and k of
them fill a sequence. A piece that would leave much of its slot empty is cut so that its head fills a slot of the
next class exactly; the rest shrinks so fast that a few cuts do. Pieces get their place within a class from counts
for each task, so tasks fill the bins of a class independently. What is left over of each class, fewer pieces than
one bin holds and so a number bounded by the capacity alone (some 20,000 pieces for 4096 tokens, however large the
input), is packed at the end, in groups of about LEFT_ROWS pieces that each leave one open sequence.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemend.llm.common import Scratch, map_arrow, table, text_slices

CUT_BELOW = 0.97  #: pieces that fill less of their slot than this are cut
LEFT_ROWS = 1000  #: left-over pieces that are packed in one task
LEAST_CUT = 48  #: pieces of at most so many tokens are not cut further


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens; their lengths add up to n."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if rest <= LEAST_CUT or rest * k >= CUT_BELOW * capacity:
            out.append((rest, k))
            break
        head = capacity // (k + 1)
        out.append((head, k + 1))
        rest -= head
    return out


#: Texts of white space, Latin letters without combining marks, digits and ASCII marks: lower-casing is plain there, there
#: is nothing to normalise, and the tokenizer's pattern for pre-tokens reads as SPLIT. The dotted capital I is left out.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"
PLAIN = re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de" + LETTERS + "0-9!-/:-@\\[-`{-~ \t\n\r\f\v]*").fullmatch
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[" + LETTERS + "]+|[0-9]|[!-/:-@\\[-`{-~]+").findall


#: What a tokenizer's file says if SPLIT and byte_letters() read plain texts as it does.
NORMALISES = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def reads_plainly(said: dict) -> bool:
    """Whether a tokenizer, by its own file, cuts plain texts as SPLIT does, adds nothing, and has special tokens with <| in them only."""
    normaliser, splitter = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}
    return (
        normaliser.get("normalizers") == NORMALISES and splitter.get("pretokenizers") == SPLITS and said["model"]["type"] == "BPE"
        and not any(said.get(k) for k in ("post_processor", "truncation", "padding")) and not said["model"].get("dropout") and all("<|" in t["content"] for t in said.get("added_tokens") or [])
    )


def byte_letters() -> dict[int, str]:
    """Characters below 0x180 as byte-level BPE writes their UTF-8 bytes: printable Latin-1 as itself, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x180)}


class WordIds(dict):
    """Little-endian 32-bit ids of pre-tokens, by the library's BPE model on first sight, kept up to a bound.

    Plain texts are cut into pre-tokens here. In others, the chunks between white space are taken one by one: no
    pre-token, normalisation or special token reaches across it; those that aren't plain go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 250_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most, self.letters = Tokenizer.from_file(path), most, byte_letters()
        self.model = self.library.model
        self.direct = reads_plainly(json.loads(self.library.to_str()))  # another kind of tokenizer takes the long way

    def whole(self, chunk: str) -> bytes:
        return array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __missing__(self, pre: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = array("I", [t.id for t in self.model.tokenize(pre.translate(self.letters))]).tobytes()
        if len(pre) < 64:
            self[pre] = ids
        return ids

    def of_plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, SPLIT(text.lower())))

    def of(self, text: str) -> bytes:
        plain = lambda t: self.direct and PLAIN(t) and "<|" not in t
        if plain(text):
            return self.of_plain(text)
        # str.split() also cuts at four control characters that the tokenizer keeps
        chunks = [text] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return b"".join(self.of_plain(c) if plain(c) else self.whole(c) for c in chunks)


def library_encoder(path: str) -> Callable[[], Callable[[str], bytes]]:
    return lambda: WordIds(path).of


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): each token of each row lies in one piece.

    `encoder()` is called once a task and gives a function from a text to its ids as little-endian 32-bit bytes.
    A null or empty text is the end id alone. Repeated rows and null ids are packed as rows of their own, each with all
    of its pieces; ties in length go by id and start. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        encode, end = encoder(), end_id.to_bytes(4, "little")
        task, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            for ids, texts in text_slices(b["doc_id"], b["text"]):
                out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "nth")}
                for i, t in zip(ids, texts, strict=True):
                    blob = encode(t) + end
                    n, at = len(blob) // 4, 0
                    for length, k in cut(n, capacity):
                        nth = seen.get(k, 0)
                        seen[k] = nth + 1
                        for c, v in zip(out, (i, at, length, zlib.crc32(blob[4 * at : 4 * (at + length)]), n, k, task, nth), strict=True):
                            out[c].append(v)
                        at += length
                yield out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long, task long, nth long"
    pieces = scratch.keep(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, each))
    per_task = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    w = Window.partitionBy("class").orderBy("task")
    before = per_task.select("class", "task", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("class")).alias("total"))
    placed = pieces.join(before, ["class", "task"]).withColumn("at", F.col("before") + F.col("nth")).withColumn("bin", F.expr("at div class"))
    full = F.col("bin") < F.expr("total div class")
    w = Window.partitionBy("class", "bin").orderBy("at")
    even = placed.where(full).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("class") * F.lit(1 << 44) + F.col("bin")).alias("sequence_id"), (F.sum("length").over(w) - F.col("length")).alias("offset"))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def fill(pdf):
        """First fit, longest first, over a group of the leftovers."""
        base = int(pdf["group"].iloc[0]) << 32
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        used: list[int] = []
        seq, off, first = [], [], 0
        for n in pdf["length"]:
            while first < len(used) and used[first] == capacity:
                first += 1
            at = next((j for j in range(first, len(used)) if used[j] + n <= capacity), None)
            if at is None:
                at = len(used)
                used.append(0)
            seq.append(at)
            off.append(used[at])
            used[at] += n
        return pdf[keep].assign(sequence_id=[base + s for s in seq], offset=off)

    over = per_task.groupBy("class").agg((F.sum("n") % F.col("class")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, over // LEFT_ROWS)
    left = placed.where(~full).select(*keep, F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)).alias("group")).groupBy("group").applyInPandas(fill, ", ".join(f"{c} long" for c in [*keep, "sequence_id", "offset"]))
    return even.unionByName(left)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each document in sequences of 4096 tokens. Nulls, empties and repeats as in pack."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), library_encoder(public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
