"""Failure taxonomy and repair statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from .stats import pct, share, wilson

RENDER_MARKERS = ["error", "syntax", "http 400"]
SELF_DEPENDENCY = r"(?md)^\s*([A-Za-z_][\w.]*)\s+(\.\.>|->|-->)\s*\1\b"


def is_render_error(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    found = F.lit(False)
    for marker in RENDER_MARKERS:
        found = found | F.contains(low, F.lit(marker))
    return found


def failure_labels(code: Column, messages: Column, render_error: Column) -> Column:
    """Every label that applies, in taxonomy order; ``unknown`` when none does."""
    code = F.coalesce(code, F.lit(""))
    said = F.lower(F.coalesce(messages, F.lit("")))
    body = X.strip(F.regexp_replace(code, r"(?i)@startuml|@enduml", ""))
    has_package = F.rlike(code, F.lit(r"(?imd)^\s*package\s+"))
    rules = [
        ("empty_or_incomplete", (F.length(body) < 12) | F.contains(said, F.lit("empty")) | F.contains(said, F.lit("incomplete"))),
        ("missing_package_block", ~has_package),
        ("unbalanced_braces", X.count_char(code, "{") != X.count_char(code, "}")),
        ("self_dependency", F.contains(said, F.lit("self-referential")) | F.rlike(code, F.lit(SELF_DEPENDENCY))),
        ("wrong_diagram_type", F.rlike(code, F.lit(r"(?md)^\s*class\s+\w+")) & ~has_package),
        ("render_engine_error", F.coalesce(render_error, F.lit(False))),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    rest = F.when(said != "", F.array(F.lit("invalid_syntax_other"))).otherwise(F.array(F.lit("unknown")))
    return F.when(F.size(found) > 0, found).otherwise(rest)


def repair_rollup(repairs: DataFrame) -> DataFrame:
    """One row per artifact, so the join to artifacts never multiplies rows."""
    return repairs.groupBy("artifact_id").agg(
        F.count("*").alias("attempts"),
        F.count_if("success").alias("successes"),
        F.bool_or(is_render_error(F.col("reason"))).alias("reason_error"),
    )


def with_attempts(artifacts: DataFrame, repairs: DataFrame, renders: DataFrame) -> DataFrame:
    """D3: artifacts with rolled-up repair and render attempts."""
    drawn = renders.groupBy("artifact_id").agg(
        F.count("*").alias("renders"), F.bool_or(is_render_error(F.col("error_output"))).alias("output_error")
    )
    joined = artifacts.join(repair_rollup(repairs), "artifact_id", "left").join(drawn, "artifact_id", "left")
    return joined.withColumn(
        "render_error", F.coalesce("reason_error", F.lit(False)) | F.coalesce("output_error", F.lit(False))
    ).fillna(0, ["attempts", "successes", "renders"]).drop("reason_error", "output_error")


def failed_with_labels(joined: DataFrame, diagram_type: str) -> DataFrame:
    failed = joined.where((F.col("diagram_type") == diagram_type) & (F.col("render_status") != "success"))
    return failed.withColumn(
        "labels", failure_labels(F.col("plantuml_code"), F.col("validation_messages"), F.col("render_error"))
    )


def failure_totals(artifacts: DataFrame, diagram_type: str) -> DataFrame:
    """Totals, rates with interval, mean S by outcome."""
    ok = F.col("render_status") == "success"
    counts = artifacts.where(F.col("diagram_type") == diagram_type).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("successes"),
        F.count_if(~ok).alias("failures"),
        F.avg(F.when(ok, F.col("composite_score"))).alias("mean_s_success"),
        F.avg(F.when(~ok, F.col("composite_score"))).alias("mean_s_failure"),
        pct(F.count_if(ok & F.col("majority_accepted")), F.count_if(ok)).alias("majority_accept_success_pct"),
    )
    low, high = wilson(F.col("failures"), F.col("total"))
    return counts.select(
        "*",
        share(F.col("failures"), F.col("total")).alias("failure_rate"),
        share(F.col("successes"), F.col("total")).alias("success_rate"),
        low.alias("ci_low"),
        high.alias("ci_high"),
    )


def label_counts(joined: DataFrame, diagram_type: str) -> DataFrame:
    """Label counts with their share of failures and of all artifacts of the type.

    Both totals ride along as rows of the same aggregate, so no join against a one-row frame.
    """
    of_type = joined.where(F.col("diagram_type") == diagram_type)
    labels = F.when(
        F.col("render_status") != "success",
        F.concat(
            F.array(F.lit("__all"), F.lit("__failed")),
            failure_labels(F.col("plantuml_code"), F.col("validation_messages"), F.col("render_error")),
        ),
    ).otherwise(F.array(F.lit("__all")))
    counts = of_type.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    everything = W.partitionBy()  # over at most ten label rows
    total = F.max(F.when(F.col("label") == "__all", F.col("n"))).over(everything)
    failed = F.max(F.when(F.col("label") == "__failed", F.col("n"))).over(everything)
    return (
        counts.withColumn("share_of_failures", share(F.col("n"), failed))
        .withColumn("share_of_total", share(F.col("n"), total))
        .where(~F.col("label").startswith("__"))
    )


def label_examples(labelled: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` artifacts per label with a preview."""
    rows = labelled.select(
        F.explode("labels").alias("label"), "artifact_id", "composite_score",
        F.array_join("labels", ",").alias("labels"), F.substring("plantuml_code", 1, 240).alias("preview"),
    )
    place = F.row_number().over(W.partitionBy("label").orderBy("artifact_id"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def repair_stats(artifacts: DataFrame, repairs: DataFrame, by: str) -> DataFrame:
    """Attempts, wins and rescued artifacts."""
    rolled = artifacts.join(repair_rollup(repairs), "artifact_id")
    rescued = F.count_if(F.col("render_status") == "success")
    return rolled.groupBy(by).agg(
        F.count("*").alias("artifacts_with_repair"),
        F.sum("attempts").alias("repair_attempts"),
        F.sum("successes").alias("repair_successes"),
        rescued.alias("rescued_artifacts"),
        share(F.sum("successes"), F.sum("attempts")).alias("attempt_win_rate"),
        share(rescued, F.count("*")).alias("rescue_rate"),
    )
