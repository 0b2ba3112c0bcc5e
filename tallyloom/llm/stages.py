"""The stages of the corpus pipeline: each takes documents and applies one operator to all of them.

Every stage returns the columns of ``documents`` and gives extra ones up; only the last returns its
own. Nulls and empty texts are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, mixing, near_dedup, quality, secret_scan
from .common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def filtered(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the weak-label classifier rejects go; texts without a word are among them."""
    docs = docs.select(*COLUMNS)
    return quality.judge(docs, quality.train(docs)).where("kept").select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class stays: the one with the smallest id, once."""
    docs = docs.select(*COLUMNS)
    named = near_dedup.classes(docs)
    chosen = named.where("node = class_node").select(F.col("node").alias("__node"), F.col("class_id").alias("__first")).distinct()
    left = docs.withColumn("__node", near_dedup.node_of("text")).join(chosen, "__node").where(F.col("doc_id").eqNullSafe(F.col("__first")))
    return left.dropDuplicates(["__node"]).select(*COLUMNS)


def scanned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, ``n_chars`` follows the text."""
    marked = secret_scan.redact(secret_scan.scan(docs.select(*COLUMNS), out="__spans"), spans="__spans")
    changed = F.size("__spans") > 0
    return marked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until the languages have their target weights; none is lost.

    The classifier learns the languages of the documents in ``labels``.
    """
    docs = docs.select(*COLUMNS)
    known = table(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = docs.select("doc_id", "lang").join(known, "doc_id", "left_semi")
    return mixing.resample(docs, labelled, mixing.TARGETS, budget="no_loss")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    done = bpe.decode(bpe.encode(docs.select("doc_id", "text", "lang", "source"), packed=True))
    return done.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
