"""Exact ranks without a window over a whole group.

A plain ``row_number`` over a type or over the whole table would hand one task all rows of the
group.  Here the order key is cut into coarse buckets that follow the order; the counts per
bucket are summed up front, and only the rank *inside* a bucket needs a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: hex digits of the order key used as bucket: 16**4 buckets
BUCKET_DIGITS = 4


def order_key(seed: int | str, *keys: str | Column) -> Column:
    """Seeded order that does not depend on partitioning: md5 over seed and key."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


#: the offsets are broadcast only where their number of rows provably stays below this
BROADCAST_ROWS = 1_000_000


def id_levels(key: str) -> list[Column]:
    """Coarse levels for ranks in the order of a whole-number id.

    At most 65,536 values below each parent for ids up to 2**56, and 1,024 ids in the last level.
    """
    return [F.shiftright(key, 40), F.shiftright(key, 25), F.shiftright(key, 10)]


def bucket_offsets(counts: DataFrame, by: Sequence[str], buckets: Sequence[str], n: str) -> DataFrame:
    """Rows standing before each bucket of its group, one level of buckets at a time.

    Each window sees only the buckets under one parent, so its size is bounded by the number of
    distinct values of one level and not by the number of rows. ``__size`` is the group's size.
    """
    out = counts
    parts: list[Column] = []
    for level, bucket in enumerate(buckets):
        parents = list(by) + list(buckets[:level])
        last = level == len(buckets) - 1
        totals = out if last else counts.groupBy(*parents, bucket).agg(F.sum(n).alias(n))
        w = W.partitionBy(*parents).orderBy(bucket) if parents else W.orderBy(bucket)
        before = F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        name = f"__before{level}"
        parts.append(F.col(name))
        extra = [F.sum(n).over(W.partitionBy(*parents)).alias("__size")] if level == 0 else []
        placed = totals.select("*", before.alias(name), *extra)
        if last:
            out = placed
        else:
            out = out.join(placed.drop(n), parents + [bucket])
    offset = reduce(lambda a, b: a + b, parts)
    return out.select(*by, *buckets, offset.alias("__offset"), "__size")


def exact_rank(
    df: DataFrame,
    order: Sequence[Column],
    coarse: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "rank",
    below: int | None = None,
    max_offsets: int | None = None,
    size: str | None = None,
) -> DataFrame:
    """Number the rows of every ``by`` group from 1 in ``order``.

    ``coarse`` are columns by which ``order`` is already sorted (compared left to right, rising),
    and ``by`` columns must not be null. ``max_offsets`` states how many (group, bucket) pairs can
    exist; where that bound is small the offsets are broadcast, and with ``below`` every bucket
    that starts past that rank is then dropped before any row is shuffled. The caller still
    filters on the rank. ``size`` names a column for the number of rows in the group.
    """
    buckets = [f"__b{i}" for i in range(len(coarse))]
    keyed = df.select("*", *[c.alias(b) for c, b in zip(coarse, buckets)])
    keys = list(by) + buckets
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("__n"))
    offsets = bucket_offsets(counts, by, buckets, "__n")
    if below is not None:
        offsets = offsets.where(F.col("__offset") < below)
    if max_offsets is not None and max_offsets <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    ranked = keyed.join(offsets, keys).withColumn(name, (inside + F.col("__offset")).cast("long"))
    if size is not None:
        ranked = ranked.withColumn(size, F.col("__size"))
    return ranked.drop(*buckets, "__offset", "__size")


def seeded_rank(
    df: DataFrame,
    key: str,
    seed: int,
    by: Sequence[str] = (),
    name: str = "rank",
    below: int | None = None,
    groups: int | None = None,
    size: str | None = None,
) -> DataFrame:
    """Exact rank in seeded md5 order of a unique ``key``; ``groups`` bounds the ``by`` groups."""
    keyed = df.withColumn("__md5", order_key(seed, key))
    bound = 1 if not by else groups
    ranked = exact_rank(
        keyed,
        [F.col("__md5"), F.col(key)],
        [F.substring("__md5", 1, BUCKET_DIGITS)],
        by=by,
        name=name,
        below=below,
        max_offsets=bound * 16**BUCKET_DIGITS if bound else None,
        size=size,
    )
    return ranked.drop("__md5")


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """Exactly ``min(n, rows)`` rows in seeded order (F9), for small and large ``n`` alike."""
    return seeded_rank(df, key, seed, name="__rank", below=n).where(F.col("__rank") <= n).drop("__rank")
