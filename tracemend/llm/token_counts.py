"""Token counts by the whole-token shortcut.

A sentencepiece BPE model with no piece that holds the space mark after another character never merges across the
start of a run of spaces, and never across a character that is in no longer piece. A text so falls into pre-tokens
whose counts add up. Which vocabulary strings encode alone as one token is proved once, on the driver; those
pre-tokens count 1 by a look-up and only the rest is merged, once for each distinct one that a task meets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.llm.common import map_arrow, table, text_slices

MARK = "▁"


def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def wire_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol-buffer message, in order."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            at += size
            yield tag >> 3, raw[at - size : at]


def separable(raw: bytes) -> bool:
    """Whether a model, by its own file, merges by pairs, leaves texts as they are but for one space put in front, and has no piece that is matched before merging.

    Field numbers and their defaults are those of sentencepiece's model format.
    """
    trainer, normaliser, kinds = {}, {}, set()
    for field, value in wire_fields(raw):
        if field == 1:
            kinds.add(dict(wire_fields(value)).get(3, 1))
        elif field == 2:
            trainer = dict(wire_fields(value))
        elif field == 3:
            normaliser = dict(wire_fields(value))
    merges, suffixed = trainer.get(3, 1) == 2, trainer.get(24, 0)
    maps, fronted, squeezed, marked = normaliser.get(2, b""), normaliser.get(3, 1), normaliser.get(4, 1), normaliser.get(5, 1)
    return bool(merges and not suffixed and not maps and fronted and not squeezed and marked and 4 not in kinds)


def prove(path: str) -> tuple[frozenset[str], bool]:
    """Pre-tokens (space marks as spaces) that are one token alone, and whether cutting at spaces and newlines is exact."""
    sp = _library(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    with open(path, "rb") as f:
        cuts = separable(f.read()) and not any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in pieces) and len(sp.encode("\n")) == 2
    count = merger(sp)
    return frozenset(q for p in pieces if count(q := p.replace(MARK, " ")) == 1) if cuts else frozenset(), cuts


def merger(sp) -> Callable[[str], int]:
    """Tokens of one pre-token by the library; a newline stands in front where the library would put a space."""

    def count(pre: str) -> int:
        if pre == " ":
            return len(sp.encode(" ")) - len(sp.encode("")) if not sp.encode("") and len(sp.encode(" ")) != 1 else 1
        return len(sp.encode(pre[1:])) if pre[0] == " " else len(sp.encode("\n" + pre)) - 2

    return count


class Counts(dict):
    """Counts of pre-tokens; those outside the proved set are merged on first sight and kept up to a bound."""

    def __init__(self, path: str, whole: frozenset[str], most: int = 300_000):
        super().__init__(dict.fromkeys(whole, 1))
        self.count, self.whole, self.most = merger(_library(path)), whole, most + len(whole)

    def __missing__(self, pre: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        n = self.count(pre)
        if len(pre) < 64:
            self[pre] = n
        return n


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 tokens; repeated rows and null ids are counted row by row; other columns are dropped.
    A model for which the cut cannot be proved exact is run whole on each text.
    """
    whole, cuts = prove(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(whole)  # at most the model's vocabulary

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        split = re.compile(r" *[^ \n]+|\n| +").findall
        if cuts:
            counts = Counts(model_path, shared.value)
        else:
            sp = _library(model_path)
        for b in batches:
            for ids, texts in text_slices(b["id"], b["text"]):
                if cuts:
                    n = [sum(map(counts.__getitem__, split(" " + t.replace(MARK, " ")))) if t else 0 for t in texts]
                else:
                    n = [len(x) for x in sp.encode(texts, num_threads=1)]
                yield {id_col: ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean", each)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each document, and whether they are over 4096. Nulls, empties and repeats as in token_counts."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
