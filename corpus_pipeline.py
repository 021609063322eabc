"""The corpus preparation pipeline: each stage's rows are written as Parquet and reread as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import stages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", stages.drop_rejected),
    ("minhash near-dedup", stages.near_dedup),
    ("secret scans", stages.redact_secrets),
    ("packing", stages.pack),
]

#: SQL cannot express the trained and sampled stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared checkpoint folder.

    Nulls, empty and very long texts, ties, repeated rows and further columns are each stage's to settle (see
    ``pulsegrid.llm.stages``); an empty table gives an empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{stages.shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
