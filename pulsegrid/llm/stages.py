"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import minhash, packing, quality, secrets
from pulsegrid.llm.store import documents, shared_folder

__all__ = ["drop_rejected", "near_dedup", "pack", "redact_secrets", "shared_folder"]

#: Similarity of word shingles from which documents are near copies.
NEAR = (80, 100)


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards good labelled ones draws.

    Null and empty texts weigh 0, as an even text does; repeated rows, and rows of one doc_id that weigh alike, go or
    stay together. An empty table gives an empty one, and without labels all stay. Further columns stay as they are.
    """
    return quality.keep_selected(docs, documents(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more, the one with the smallest doc_id; of its repeated rows all stay.

    Of a doc_id with several texts only those that are copies go. Null, empty and blank texts and rows without a
    doc_id stay. Texts may be as long as a row can be; an empty table gives an empty one, and further columns stay.
    """
    groups = minhash.near_duplicates(docs, threshold=NEAR, text_key=True)
    dropped = minhash.bounded_broadcast(groups.where("NOT kept").select("doc_id", "text_key").distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    return rows.join(dropped, ["doc_id", "text_key"], "left_anti").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret found and n_chars of the new text.

    Rows without secrets stay as they are: null and empty texts, repeats, further columns. An empty table gives an
    empty one.
    """
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in a batch of its length bucket.

    Null and empty texts count as one token, a text over the budget is a batch of its own, repeated rows are packed
    each. An empty table gives an empty one; columns named as those of ``packing.pack`` are replaced.
    """
    return packing.pack(docs)
