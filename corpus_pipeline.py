"""From documents to packed training sequences: language, near copies, repeated passages, mixture, packing.

Each stage takes all rows that the one before kept; all but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm import langid, mixing, ngram_join, packing, repeats
from lexitide.llm.common import holding, prepare, sift, stage, unstage
from lexitide.llm.queries import weights_by_code_point

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language stay, lang is what was predicted; texts that are null or without letters go. With
    nothing to learn from, every text is of no language. Equal rows share their fate; no rows give no rows."""
    model = langid.fit(langid.sample(docs, ~langid.held_out()))
    judged = langid.identify(docs.select(*COLUMNS), model)
    return judged.where(F.col("lang_pred") != "und").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id, null last; rows that repeat an id or have
    none are told apart by a number of their own. Null and blank texts are copies of each other; no rows give no rows."""
    rows = stage(docs.select(*COLUMNS).withColumns({"_row": F.monotonically_increasing_id(), "_hash": F.xxhash64(*COLUMNS)}), "near-rows")
    found = ngram_join.join(rows.select("_row", "text"), id_col="_row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "_row")
    # A class of one row keeps it, so only rows with a copy are compared.
    several = found.where("n_links > 0").select("_row", "class_id").join(rows.select("_row", order.alias("_order")), "_row")
    least = stage(several.groupBy("class_id").agg(F.min("_order").alias("_least")), "near-least")  # else its plan would keep a large class in one task
    gone = stage(several.join(least, "class_id").where(F.col("_order") != F.col("_least")).select(F.col("_row").alias("_gone")), "near-gone")
    unstage(found, least)
    maybe, stays = sift(rows, F.col("_row"), gone, F.col("_gone"))
    out = stays.unionByName(maybe.join(gone, maybe["_row"] == gone["_gone"], "left_anti")).select(*COLUMNS)
    return holding(out, rows, gone)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every 200-byte passage that also starts elsewhere is cut out; a document of which nothing is left goes, and so do
    null and empty texts. Rows with equal or null ids are documents of their own; no rows give no rows."""
    cut = repeats.removed(docs, keep=("lang", "source"), kept_text=True)
    out = cut.where(F.octet_length("kept_text") > 0).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))
    return holding(out, cut)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, by the weights of their sources; those without words go, as they
    count nothing towards any target. A null source is one of its own; no rows give no rows."""
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    taken, _ = mixing.mix(docs.select(*COLUMNS).withColumns({"_size": size, "_sources": F.array("source")}), weights_by_code_point(docs), size_col="_size", sources_col="_sources")
    out = taken.where("copies > 0 and _size > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)
    return holding(out, taken)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens. A null or empty text is one piece, the end id; rows with equal
    or null ids are documents of their own; no rows give no rows."""
    import public_tokenizers

    packs = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return holding(packs.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), packs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packed", packed),
]
#: SQL expresses none of the learned, banded and packed stages; tests hold the rows against a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents; what a stage returns is written to the shared folder and read by the next one,
    and deleted with all that it was made from once the next one is written."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        made = step(spark, docs, sf_dir)
        after = stage(made, f"pipeline-{name}")
        unstage(made, docs)
        docs = after
    return docs
