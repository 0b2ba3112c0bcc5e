"""Report tables put together from the statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from . import stats as ST


def published_vs_live(artifacts: DataFrame) -> DataFrame:
    """The published figures next to the live ones."""
    published = artifacts.sparkSession.createDataFrame(
        [(t, s, m) for t, s, m, *_ in fixed.PUBLISHED_BY_TYPE],
        "diagram_type string, published_success_pct double, published_mean_s double",
    )
    live = ST.type_stats(artifacts).select(
        "diagram_type", F.col("success_pct").alias("live_success_pct"), F.col("mean_s").alias("live_mean_s")
    )
    return published.join(live, "diagram_type", "left")


def _facts(df: DataFrame, section: str, key: str | None) -> DataFrame:
    """A report frame as (section, key, metric, value) rows."""
    label = F.col(key) if key else F.lit("all")
    values = [c for c in df.columns if c != key]
    cast = df.select(label.alias("key"), *[F.col(c).cast("double").alias(c) for c in values])
    return cast.unpivot(["key"], values, "metric", "value").select(F.lit(section).alias("section"), "key", "metric", "value")


def briefing(artifacts: DataFrame, repairs: DataFrame, reviews: DataFrame, labels: DataFrame, totals: DataFrame) -> DataFrame:
    """Every figure of the briefing as one long table; ``labels`` and ``totals`` are the failure report's.

    Long rows instead of one nested record: the sections are aggregated on their own and need
    no join to stand side by side.
    """
    parts = [
        _facts(ST.summary(artifacts, repairs, reviews), "summary", None),
        _facts(ST.type_stats(artifacts), "by_type", "diagram_type"),
        _facts(ST.alignment(reviews, artifacts), "alignment", "scope"),
        _facts(published_vs_live(artifacts), "published", "diagram_type"),
        _facts(totals, "failures", None),
        _facts(labels, "failure_labels", "label"),
    ]
    return reduce(DataFrame.unionByName, parts)


def report_lines(labels: DataFrame, totals: DataFrame) -> DataFrame:
    """The failure report as ordered text lines; both inputs are small aggregates."""
    def line(part: int, tie: str, text) -> Column:
        return F.struct(
            F.lit(part).alias("part"), F.lit(0).cast("long").alias("weight"), F.lit(tie).alias("tie"), text.alias("line")
        )

    head = totals.select(
        F.inline(
            F.array(
                line(0, "", F.lit("# Failure report")),
                line(1, "a", F.format_string("- Total: %d, failures: %d", "total", "failures")),
                line(1, "b", F.format_string("- Failure rate: %.4f (95%% CI %.4f to %.4f)", "failure_rate", "ci_low", "ci_high")),
            )
        )
    )
    body = labels.select(
        F.lit(2).alias("part"),
        (-F.col("n")).alias("weight"),
        F.col("label").alias("tie"),
        F.format_string("| %s | %d | %.4f |", F.col("label"), F.col("n"), F.col("share_of_failures")).alias("line"),
    )
    return head.unionByName(body).orderBy("part", "weight", "tie").select("part", "weight", "tie", "line")
