"""The corpus pipeline: stages that filter, deduplicate, scan, mix and encode documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import table
from tallyloom.llm.stages import deduplicated, encoded, filtered, mixed, scanned

STAGES = [
    ("weak_label_quality", filtered),
    ("order_minhash_dedup", deduplicated),
    ("secret_scan", scanned),
    ("soft_mixing", mixed),
    ("byte_bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
