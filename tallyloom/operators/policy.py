"""Win rates and the choices drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .. import fixed
from .stats import types_frame


def win_rates(outcomes: DataFrame) -> DataFrame:
    """Wins, losses and the smoothed rate per (kind, key, name)."""
    return with_rate(
        outcomes.groupBy("kind", "key", "name").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail"))
    )


def with_rate(counts: DataFrame) -> DataFrame:
    n = F.col("ok") + F.col("fail")
    return counts.withColumn("n", n).withColumn("rate", (F.col("ok") + 1) / (n + 2))


def choose_generator(rates: DataFrame, types: Sequence[str] = fixed.APP_TYPES, tuned: bool = True) -> DataFrame:
    """The generator per type with the reason; unseen types keep the smoothed prior."""
    mine = rates.where(F.col("kind") == "generators").withColumnRenamed("key", "diagram_type")
    cells = [
        F.coalesce(F.sum(F.when(F.col("name") == name, F.col(c))), F.lit(0)).alias(f"{short}_{c}")
        for name, short in (("lora", "l"), ("spec-builder", "s"))
        for c in ("ok", "n")
    ]
    seen = mine.groupBy("diagram_type").agg(*cells)
    table = types_frame(rates.sparkSession, types).join(seen, "diagram_type", "left").fillna(0)
    l_rate = (F.col("l_ok") + 1) / (F.col("l_n") + 2)
    s_rate = (F.col("s_ok") + 1) / (F.col("s_n") + 2)
    l_n, s_n, kind = F.col("l_n"), F.col("s_n"), F.col("diagram_type")
    grounded = kind.isin("component", "package") & (l_n < 8)
    able = F.lit(tuned) & kind.isin(*fixed.EXTENDED_TYPES)
    better = able & (l_n >= fixed.MIN_SAMPLES_TO_ADAPT) & (s_n >= 2) & (s_rate > l_rate + 0.08)
    weak = able & (l_n >= 5) & (l_rate < 0.40)
    explore = (better | weak) & able & ((l_n + s_n) % 4 == 0)
    two = lambda c: F.format_string("%.2f", c)
    return table.select(
        "diagram_type",
        F.when(grounded, "spec-builder").when(explore, "lora").when(better | weak, "spec-builder")
        .when(able, "lora").otherwise("llm").alias("generator"),
        F.when(grounded, F.concat(F.lit("default: grounded "), kind, F.lit(" builder (LoRA n="), l_n, F.lit(" < 8 proven samples)")))
        .when(explore, F.concat(F.lit("explore: retry LoRA on "), kind, F.lit(" despite lower rate "), two(l_rate)))
        .when(better, F.concat(F.lit("adapted: spec-builder "), two(s_rate), F.lit(" (n="), s_n, F.lit(") > LoRA "), two(l_rate), F.lit(" (n="), l_n, F.lit(")")))
        .when(weak, F.concat(F.lit("adapted: LoRA weak on "), kind, F.lit(" ("), two(l_rate), F.lit(", n="), l_n, F.lit(")")))
        .when(able, F.concat(F.lit("default: LoRA-first for "), kind, F.lit(" (rate "), two(l_rate), F.lit(", n="), l_n, F.lit(")")))
        .otherwise("default: base LLM then spec-builder").alias("reason"),
    )


def default_strategies(spark: SparkSession, types: Sequence[str] = fixed.APP_TYPES) -> DataFrame:
    rows = [
        (f"{t}|{category}", place, name)
        for t in types
        for category, names in fixed.DEFAULT_STRATEGIES.items()
        for place, name in enumerate(names)
    ]
    return spark.createDataFrame(rows, "key string, default_place int, name string")


def rank_strategies(rates: DataFrame, tried: DataFrame | None = None, types: Sequence[str] = fixed.APP_TYPES) -> DataFrame:
    """Strategies per (type, category); proven ones by win rate, the rest in default order.

    A category without strategies of its own gets the fallback ones.
    """
    defaults = default_strategies(rates.sparkSession, types)
    known = rates.where(F.col("kind") == "strategies").select("key", "name", "n", "rate")
    unlisted = known.select("key").distinct().join(defaults, "key", "left_anti")
    fallback = F.posexplode(F.array(*[F.lit(n) for n in fixed.FALLBACK_STRATEGIES])).alias("default_place", "name")
    defaults = defaults.unionByName(unlisted.select("key", fallback))
    proven = F.when(F.col("n") >= fixed.MIN_SAMPLES_TO_ADAPT, -F.col("rate")).otherwise(F.lit(0.0))
    table = defaults.join(known, ["key", "name"], "left")
    if tried is not None:
        table = table.join(tried, ["key", "name"], "left_anti")
    place = F.row_number().over(W.partitionBy("key").orderBy(proven, "default_place"))  # a handful per key
    return table.select("key", place.alias("place"), "name")


def latest(outcomes: DataFrame, n: int) -> DataFrame:
    """the newest ``n`` log rows."""
    return outcomes.orderBy(F.desc("at"), F.desc("event_id")).limit(n)
