"""Compute costly expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def hold(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add computed columns the optimizer will not copy into later expressions.

    Filters and projections over an alias are normally merged into it, and a regular
    expression over a long text would then run once per use, inside a lambda even once per
    element. The output of a generator over a one-element array is opaque to that, stays in the
    same stage and needs no shuffle.
    """
    kept = [c for c in (keep if keep is not None else df.columns) if c not in columns]
    values = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(values)))


def hold_fields(df: DataFrame, fields: Column, keep: list[str] | None = None) -> DataFrame:
    """:func:`hold` of the fields of one struct, whose parts may be computed from each other."""
    return df.select(*(df.columns if keep is None else keep), F.inline(F.array(fields)))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give costly per-row work a task per core where the input arrives in fewer tasks.

    A table already read by at least as many tasks as there are cores is left alone, so a large
    input never pays for this shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def dealt(df: DataFrame, key: str, step: int = 8 << 20) -> DataFrame:
    """Deal rows out by key for much work per row: some tasks per core, and one per ``step`` bytes of input.

    A file is cut into as many tasks by its size, but one task gets all rows of a row group and the others
    none, so their number says nothing. What is joined by the key later stays where it is.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, min(size // step, 1 << 16)), key)
