"""Keep-first deduplication, exclusion and overlap by content hash."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X


def keep_first(
    df: DataFrame, keys: Sequence[Column], order: Sequence[Column], copies: str | None = None, carry: Sequence[str] | None = None
) -> DataFrame:
    """The first row in ``order`` of every key.

    An aggregate rather than a window: map-side combining leaves at most one row per key and
    task, so a text that makes up a third of the table costs no more than any other. ``carry``
    names the columns of the result; without it whole rows travel, texts included. Who needs
    ids or counts only should name them: then hashes and ids are all that is sorted and shuffled.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = df.select(
        *[k.alias(n) for k, n in zip(keys, names)],
        F.struct(*order).alias("__order"),
        F.struct(*(carry or df.columns)).alias("__row"),
    )
    first = keyed.groupBy(*names).agg(
        F.min_by("__row", "__order").alias("__row"), F.count("*").alias("__copies")
    )
    extra = [F.col("__copies").alias(copies)] if copies else []
    return first.select("__row.*", *extra)


def dedupe_code(df: DataFrame, code: str, priority: Column, source: str, ordinal: str, carry: Sequence[str] | None = None) -> DataFrame:
    """exact text; higher priority first, then source and ordinal."""
    return keep_first(df, [F.sha1(F.col(code))], [-priority, F.col(source), F.col(ordinal)], carry=carry)


def dedupe_stripped(df: DataFrame, code: str, rank: str, ordinal: str, copies: str | None = None, carry: Sequence[str] | None = None) -> DataFrame:
    """text without outer whitespace; lower ``rank`` (declared source order) first."""
    return keep_first(df, [X.code_hash(F.col(code))], [F.col(rank), F.col(ordinal)], copies, carry)


def dedupe_fingerprint(df: DataFrame, code: str, order: Sequence[Column], carry: Sequence[str] | None = None) -> DataFrame:
    """every line stripped and blank lines removed."""
    return keep_first(df, [X.line_fingerprint(F.col(code))], order, carry=carry)


def dedupe_pair(df: DataFrame, first: str, second: str, order: Sequence[Column]) -> DataFrame:
    """code and spec together."""
    return keep_first(df, [F.sha1(F.col(first)), F.sha1(F.col(second))], order)


def merge_report(sources: DataFrame, kept: DataFrame, label: str = "merge_source") -> DataFrame:
    """Rows before and after a merge, per source and in total."""
    before = sources.groupBy(label).agg(F.count("*").alias("rows_in"), F.lit(0).cast("long").alias("rows_kept"))
    after = kept.groupBy(label).agg(F.lit(0).cast("long").alias("rows_in"), F.count("*").alias("rows_kept"))
    both = before.unionByName(after).rollup(label).agg(
        F.sum("rows_in").alias("rows_in"), F.sum("rows_kept").alias("rows_kept")
    )
    return both.select(
        F.coalesce(label, F.lit("total")).alias(label),
        "rows_in",
        "rows_kept",
        (F.col("rows_in") - F.col("rows_kept")).alias("rows_dropped"),
    )


def exclude_known(df: DataFrame, code: str, known: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose content is in none of the known corpora.

    Only 40-character hashes of the known side travel; they are made distinct first so that a
    repeated text adds one row.
    """
    hashes = reduce(
        DataFrame.unionByName,
        [k.select(X.code_hash(F.col(c)).alias("__hash")) for k, c in known],
    ).distinct()
    return df.withColumn("__hash", X.code_hash(F.col(code))).join(hashes, "__hash", "left_anti").drop("__hash")


def overlap(corpora: dict[str, DataFrame], code: str) -> DataFrame:
    """How many distinct texts each pair of corpora shares.

    One bit mask per hash instead of a join per pair; the pairs are counted over the few
    masks that occur.
    """
    names = list(corpora)
    tagged = reduce(
        DataFrame.unionByName,
        [
            df.select(X.code_hash(F.col(code)).alias("h"), F.lit(1 << i).cast("long").alias("bit"))
            for i, df in enumerate(corpora.values())
        ],
    )
    masks = tagged.groupBy("h").agg(F.bit_or("bit").alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))

    def has(i: int) -> Column:
        return F.col("mask").bitwiseAND(F.lit(1 << i)) != 0

    pairs = [
        F.struct(
            F.lit(a).alias("corpus"),
            F.lit(b).alias("other"),
            (has(i) & has(j)).alias("both"),
            has(i).alias("one"),
        )
        for i, a in enumerate(names)
        for j, b in enumerate(names)
        if i != j
    ]
    return (
        masks.select("n", F.inline(F.array(*pairs)))
        .groupBy("corpus", "other")
        .agg(
            F.coalesce(F.sum(F.when(F.col("one"), F.col("n"))), F.lit(0)).alias("texts"),
            F.coalesce(F.sum(F.when(F.col("both"), F.col("n"))), F.lit(0)).alias("shared"),
        )
        .withColumn("share", F.try_divide("shared", "texts"))
    )


def merge_into(
    base: DataFrame, new: DataFrame, code: str, ordinal: str, base_wins: bool = True, carry: Sequence[str] | None = None
) -> DataFrame:
    """union of two corpora, duplicates resolved for one side."""
    first, second = (0, 1) if base_wins else (1, 0)
    both = base.withColumn("__side", F.lit(first)).unionByName(
        new.withColumn("__side", F.lit(second)), allowMissingColumns=True
    )
    return keep_first(both, [F.sha1(F.col(code))], [F.col("__side"), F.col(ordinal)], carry=carry).drop("__side")
