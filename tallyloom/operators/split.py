"""Training splits and boosted mixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from .rank import BUCKET_DIGITS, exact_rank, order_key, seeded_sample


def replicate(df: DataFrame, copies: Column, name: str = "copy") -> DataFrame:
    """Each row as often as ``copies`` says, numbered from 0."""
    return df.select("*", F.explode(F.sequence(F.lit(0), copies - 1)).alias(name))


def upsample_accepted(df: DataFrame) -> DataFrame:
    """accepted rows twice."""
    return replicate(df, F.when(F.col("dataset_accepted"), F.lit(2)).otherwise(F.lit(1)))


def exact_split(
    df: DataFrame, key: Sequence[str], seed: int, valid_ratio: float = 0.05, test_ratio: float = 0.05
) -> DataFrame:
    """exactly ``max(1, floor(n * ratio))`` test and valid rows, the rest train.

    ``key`` identifies a row; the number of rows comes from the bucket counts of the rank.
    """
    keyed = df.withColumn("__md5", order_key(seed, *key))
    ranked = exact_rank(
        keyed, [F.col("__md5"), *[F.col(k) for k in key]], [F.substring("__md5", 1, BUCKET_DIGITS)],
        name="__rank", max_offsets=16**BUCKET_DIGITS, size="__n",
    )
    n_test = F.greatest(F.lit(1), F.floor(F.col("__n") * test_ratio))
    n_valid = F.greatest(F.lit(1), F.floor(F.col("__n") * valid_ratio))
    side = (
        F.when(F.col("__rank") <= n_test, "test").when(F.col("__rank") <= n_test + n_valid, "valid").otherwise("train")
    )
    return ranked.withColumn("split", side).drop("__md5", "__rank", "__n")


def leakfree_split(
    df: DataFrame, content: Column, seed: int, valid_ratio: float = 0.05, test_ratio: float = 0.05
) -> DataFrame:
    """whole groups of equal content go to one side; ratios hold over distinct contents.

    Distinct hashes are ranked, so copies are never pulled together; the verdict per hash is
    joined back and a heavily repeated text is spread by the join's skew handling.
    """
    hashed = df.withColumn("__hash", content)
    hashes = hashed.select("__hash").distinct()
    sides = exact_split(hashes, ["__hash"], seed, valid_ratio, test_ratio)
    return hashed.join(sides, "__hash").drop("__hash")


def boosted_mix(
    harvest: DataFrame, others: Sequence[tuple[str, DataFrame, int]], key: str, seed: int
) -> DataFrame:
    """harvest once, once more when reviewed, once more from score 4; capped samples of the rest.

    Only rows with a specification of 40 characters and an opening tag are mixed.
    """
    copies = (
        F.lit(1)
        + F.coalesce(F.col("human_reviewed"), F.lit(False)).cast("int")
        + (F.coalesce(F.col("scores"), F.lit(0.0)) >= 4.0).cast("int")
    )
    columns = [key, "diagram_type", "technical_spec", "uml_code"]
    parts = [replicate(harvest, copies).select(*columns, F.lit("live_accepted").alias("mix_source"))]
    for name, df, most in others:
        parts.append(seeded_sample(df, key, seed, most).select(*columns, F.lit(name).alias("mix_source")))
    return reduce(DataFrame.unionByName, parts).where(_usable())


def _usable() -> Column:
    return (F.length("technical_spec") >= 40) & X.has_open_tag(F.col("uml_code"))


def mix_counts(harvest: DataFrame, others: Sequence[tuple[str, DataFrame, int]], mix: DataFrame) -> DataFrame:
    """rows each source brings, the harvest before and after its boost, and rows of the ``mix``."""
    boost = F.coalesce(F.col("human_reviewed"), F.lit(False)).cast("int") + (F.coalesce(F.col("scores"), F.lit(0.0)) >= 4.0).cast("int")
    own = harvest.agg(F.count("*").alias("live_accepted"), F.coalesce(F.sum(boost + 1), F.lit(0)).alias("live_after_boost"))
    parts = [own.unpivot([], ["live_accepted", "live_after_boost"], "mix_source", "rows")]
    for name, df, most in others:
        parts.append(df.agg(F.least(F.count("*"), F.lit(most)).alias("rows")).select(F.lit(f"{name}_sample").alias("mix_source"), "rows"))
    parts.append(mix.agg(F.count("*").alias("rows")).select(F.lit("row_count").alias("mix_source"), "rows"))
    return reduce(DataFrame.unionByName, parts)
