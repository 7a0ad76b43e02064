"""A training corpus in five stages: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes what a stage returns
and reads it again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.llm import decontaminate, minhash, packing, quality, suffix_dedup
from tracemend.llm.common import Scratch, forget_since, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def text_md5() -> F.Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows named in gone (doc_id, text_md5), by id and text: rows of one id with other texts stay."""
    few = gone.count() <= minhash.BROADCAST_ROWS
    gone = gone.withColumnRenamed("doc_id", "gone_id")
    return docs.join(F.broadcast(gone) if few else gone, (F.col("doc_id") == F.col("gone_id")) & (text_md5() == F.col("text_md5")), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at the ranker's cut or above; it learns from all labels.

    Null and empty texts are scored like others, repeated rows stay or go alike, and so do rows with a null id, which have no
    label; a score equal to the cut stays; an empty table gives an empty one.
    """
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels)
    return quality.quality_scores(docs, model, *COLUMNS[1:]).where(F.col("score") >= quality.KEEP_AT).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; five words, a likeness of 0.8.

    Of rows that repeat an id in one group, the one with the least md5 stays, once. Texts without words and rows with a
    null id are in no group and stay.
    """
    scratch = Scratch(spark, "kept")
    found = scratch.keep(minhash.near_duplicates(docs))
    again = found.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text_md5").alias("least")).where("n > 1")
    again = scratch.keep(again.select("doc_id", "least"))
    others = found.where("kept and n_shingles > 0").join(again, "doc_id").where("text_md5 <> least")
    gone = scratch.keep(found.where(~F.col("kept")).select("doc_id", "text_md5").unionByName(others.select("doc_id", "text_md5")).distinct())
    out = without(docs.select(*COLUMNS), gone)
    if again.limit(1).count():
        twice = again.select(F.col("doc_id").alias("twice_id"), F.col("least").alias("text_md5"))
        same = (F.col("doc_id") == F.col("twice_id")) & (text_md5() == F.col("text_md5"))
        out = out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").dropDuplicates(["doc_id"]))
    return out.select(*COLUMNS)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that stand earlier, cut at whole characters; a document left empty goes.

    Empty and short texts stay as they are, a null text becomes an empty one; a row with a null id is not cut.
    """
    cut = suffix_dedup.cut_spans(docs.select(*COLUMNS), suffix_dedup.repeated_spans(docs), whole_characters=True)
    whole = F.size("removed") == 0
    out = cut.withColumn("text", F.col("kept").cast("string")).withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    return out.where(whole | (F.length(F.trim("text")) > 0)).select(*COLUMNS)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; texts without words, null and empty ones stay.

    Repeated rows go or stay alike. Rows with a null id are not told apart by id and text, so they stay. An empty table or an
    empty benchmark changes nothing.
    """
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    leaks = Scratch(spark, "leaks").keep(found.where(F.size("items") > 0).select("doc_id", "text_md5").distinct())
    return without(docs.select(*COLUMNS), leaks).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; a null or empty text is its end token alone.

    Repeated rows are packed each; a null id stays null in its pieces; an empty table gives no piece.
    """
    import public_tokenizers

    return packing.pack(docs, packing.library_encoder(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", passage_stage),
    ("benchmark_leaks", leak_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # a trained model and a tokenizer are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents; what a stage needed meanwhile is deleted when its result is stored."""
    docs, before = table(spark, sf_dir, "documents", *COLUMNS), None
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        mark = len(Scratch.roots)
        docs = scratch.keep(stage(spark, docs, sf_dir))
        forget_since(spark, mark)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
