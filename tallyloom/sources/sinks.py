"""Sinks, manifest and release."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.rank import order_key
from .readers import read_parquet


def export_dataset(df: DataFrame, path: str, fmt: str = "jsonl") -> str:
    """Write as csv, parquet or (also for an unknown format) JSON lines; returns the format."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        fmt = "jsonl"
        writer.option("ignoreNullFields", False).json(path)
    return fmt


def write_twin(df: DataFrame, path: str) -> tuple[str, str]:
    """The same rows as parquet and as JSON lines.

    The JSON side is written from the parquet side: the plan runs once, and a lost executor
    costs a re-read instead of a rebuild.
    """
    table, lines = f"{path}/parquet", f"{path}/jsonl"
    df.write.mode("overwrite").parquet(table)
    df.sparkSession.read.parquet(table).write.mode("overwrite").option("ignoreNullFields", False).json(lines)
    return table, lines


FACETS = {"by_type": "diagram_type", "by_source": "source_dataset", "by_mode": "input_mode", "by_language": "source_language"}


def manifest(df: DataFrame, kept: Column | None = None) -> DataFrame:
    """Totals and counts per facet in one pass, as (facet, key, rows, scored, accepted).

    ``kept`` says which rows a release holds; the others are only counted, in ``dropped`` of the total.
    """
    columns = list(FACETS.values())
    sets = [[], *[[c] for c in columns]]
    stays = F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))
    grouped = df.withColumn("__kept", stays).groupingSets(sets, *columns).agg(
        F.grouping_id().alias("g"), F.count_if("__kept").alias("rows"), F.count_if(F.col("__kept") & (F.col("composite_score") > 0)).alias("scored"),
        F.count_if(F.col("__kept") & F.col("dataset_accepted")).alias("accepted"), F.count_if(~F.col("__kept")).alias("dropped"),
    )
    # a grouping id has a zero bit for every column that is grouped by
    facet, key = F.lit("total"), F.lit("all")
    for i, (name, column) in enumerate(FACETS.items()):
        mine = F.col("g") == (2 ** len(columns) - 1) - 2 ** (len(columns) - 1 - i)
        facet = F.when(mine, F.lit(name)).otherwise(facet)
        key = F.when(mine, F.coalesce(F.col(column), F.lit("null"))).otherwise(key)
    out = grouped.select(facet.alias("facet"), key.alias("key"), "rows", "scored", "accepted", "dropped")
    out = out.where((F.col("rows") > 0) | (F.col("facet") == "total"))
    return out.drop("dropped") if kept is None else out.withColumn("dropped", F.when(F.col("facet") == "total", F.col("dropped")))


def schema_rows(df: DataFrame) -> DataFrame:
    """The columns of a release with their types and how many of their values are there, in one pass."""
    filled = df.agg(*[F.count(F.col(f"`{n}`")).alias(n) for n in df.columns])
    each = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("column"), F.lit(t).alias("type"), F.col(f"`{n}`").alias("filled")) for i, (n, t) in enumerate(df.dtypes)]
    return filled.select(F.inline(F.array(*each)))


def release_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts per column, nulls shown as ``null``, in one pass."""
    cast = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in columns])
    long = cast.unpivot([], list(columns), "column", "key")
    return long.groupBy("column", "key").agg(F.count("*").alias("n"))


def release_sample(df: DataFrame, key: str, n: int = 20, seed: int = 42) -> DataFrame:
    """A small seeded sample; a top-n, not a sort."""
    return df.orderBy(order_key(seed, key), key).limit(n)


def resume_partitions(
    spark: SparkSession, path: str, column: str, wanted: Sequence[str], target: int, build: Callable[[list[str]], DataFrame]
) -> list[str]:
    """Build the partitions that hold fewer than ``target`` rows; others stay untouched.

    ``build`` gives the rows of all values it is asked for, with ``column``; they are written in one
    job. Only one count per partition value reaches the driver. Returns what was built.
    """
    done = read_parquet(spark, path)
    have = {} if done is None else {r[column]: r["n"] for r in done.groupBy(column).agg(F.count("*").alias("n")).collect()}
    missing = [w for w in wanted if have.get(w, 0) < target]
    if missing:
        build(missing).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    return missing


def drop_heavy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without the named columns; the scan no longer reads them."""
    return df.drop(*columns)
