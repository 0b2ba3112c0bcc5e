"""Ensemble scoring: weighted composite, majority vote, dataset gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed


def to_int_score(c: Column) -> Column:
    """Soft cast: numbers in any spelling lose their fraction, anything else is null."""
    return c.cast("string").try_cast("double").try_cast("int")


# long form ------------------------------------------------------------------------------

def aggregate_scores(model_scores: DataFrame, tau: float = fixed.TAU) -> DataFrame:
    """One row per artifact from one row per model; a missing score is skipped, a zero counts."""
    scored = F.when(F.col("score").isNotNull(), F.col("weight"))
    return model_scores.groupBy("artifact_id").agg(
        F.sum(F.col("weight") * F.col("score")).alias("score_sum"),
        F.sum(scored).alias("weight_sum"),
        F.count_if(F.col("score") >= tau).alias("votes"),
    )


def available_score(score: Column, available: Column) -> Column:
    """The stored long form keeps a missing score as 0 with ``available`` false."""
    return F.when(available, score)


def composite_of(score_sum: Column, weight_sum: Column, render_ok: Column) -> Column:
    return F.when(render_ok, F.coalesce(F.try_divide(score_sum, weight_sum), F.lit(0.0))).otherwise(F.lit(0.0))


def with_verdicts(
    artifacts: DataFrame,
    model_scores: DataFrame,
    tau: float = fixed.TAU,
    min_votes: int = fixed.MIN_VOTES,
    min_composite: float = fixed.MIN_COMPOSITE,
) -> DataFrame:
    """Artifacts with composite, vote and gate; scores are aggregated before the join."""
    joined = artifacts.join(aggregate_scores(model_scores, tau), "artifact_id", "left")
    ok = F.col("render_ok")
    return (
        joined.withColumn("composite_score", composite_of(F.col("score_sum"), F.col("weight_sum"), ok))
        .withColumn("affirmative_votes", F.when(ok, F.coalesce("votes", F.lit(0))).otherwise(F.lit(0)))
        .withColumn("majority_accepted", ok & (F.col("affirmative_votes") >= min_votes))
        .withColumn(
            "dataset_accepted", F.col("majority_accepted") & (F.col("composite_score") >= min_composite)
        )
        .drop("score_sum", "weight_sum", "votes")
    )


def formula_snapshots(
    artifacts: DataFrame, model_scores: DataFrame, tau: float = fixed.TAU
) -> DataFrame:
    """The verdict with the text that explains it, models by falling weight."""
    yes = F.col("score") >= tau
    part = F.when(F.col("score").isNull(), F.concat("model_key", F.lit("=na"))).otherwise(
        F.concat(
            "model_key", F.lit("="), F.col("score").cast("string"), F.lit("(w="),
            F.col("weight").cast("string"), F.lit(",vote="), F.when(yes, F.lit("Y")).otherwise(F.lit("N")), F.lit(")"),
        )
    )
    # one entry per model and score value of an artifact: bounded by the ensemble, whatever repeats
    entries = model_scores.select("artifact_id", "model_key", "weight", "score").distinct()
    parts = entries.groupBy("artifact_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("o"), part.alias("p")))),
                lambda x: x["p"],
            ),
            ", ",
        ).alias("parts"),
        F.array_join(
            F.array_sort(F.collect_set(F.when(yes, F.col("model_key")))), ","
        ).alias("accepting_models"),
    )
    verdicts = with_verdicts(artifacts, model_scores, tau)
    return verdicts.join(parts, "artifact_id").select(
        "artifact_id",
        F.when(F.col("render_ok"), F.col("accepting_models")).otherwise(F.lit("")).alias("accepting_models"),
        F.concat(
            F.lit("final="), F.format_string("%.4f", "composite_score"),
            F.lit(" | majority="), F.initcap(F.col("majority_accepted").cast("string")),
            F.lit(" votes="), F.col("affirmative_votes").cast("string"),
            F.lit(f" tau={tau} | dataset_accepted="), F.initcap(F.col("dataset_accepted").cast("string")),
            F.lit(" | "), F.col("parts"),
        ).alias("formula_snapshot"),
    )


def ablated(df: DataFrame, mode: str, min_composite: float = fixed.MIN_COMPOSITE) -> DataFrame:
    """E5: verdicts with one gate switched off, or held to the acceptance report."""
    if mode == "no_models":
        return df.withColumn("majority_accepted", F.lit(False)).withColumn("dataset_accepted", F.lit(False))
    if mode == "no_majority":
        return df.withColumn(
            "dataset_accepted", F.col("render_ok") & (F.col("composite_score") >= min_composite)
        )
    if mode == "acceptance":
        return df.withColumn("dataset_accepted", F.col("dataset_accepted") & F.col("accepted"))
    raise ValueError(f"unknown ablation {mode!r}")


# wide form -------------------------------------------------------------------------------

def wide_composite(weights: dict[str, float] = fixed.MODEL_WEIGHTS) -> Column:
    """E1 over one column per model; null when no model scored."""
    num = sum((F.coalesce(F.col(k) * F.lit(w), F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    den = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    return F.when(den > 0, num / den)


def wide_votes(tau: float = fixed.TAU, keys: list[str] = fixed.MODEL_KEYS) -> Column:
    return sum((F.coalesce((F.col(k) >= tau).cast("int"), F.lit(0)) for k in keys), F.lit(0))


def fill_composite(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Recompute only where the stored composite is missing."""
    stored = F.col(scores) if scores in df.columns else F.lit(None).cast("double")
    return df.withColumn(scores, F.coalesce(stored, wide_composite()))


def scores_long(df: DataFrame, ids: list[str]) -> DataFrame:
    """One column per model to one row per model."""
    return df.unpivot(ids, list(fixed.MODEL_KEYS), "model_key", "score")


def scores_wide(long: DataFrame, ids: list[str]) -> DataFrame:
    """One row per model to one column per model; the keys are fixed, so no extra pass."""
    return long.groupBy(*ids).agg(
        *[F.max(F.when(F.col("model_key") == k, F.col("score"))).alias(k) for k in fixed.MODEL_KEYS]
    )


# human reviews -----------------------------------------------------------------------------

REVIEW_AXES = ["semantic", "structural", "syntactic", "coherence"]


def human_six() -> Column:
    """Mean of the four axes on the 0-6 scale."""
    mean = sum((F.col(a) for a in REVIEW_AXES), F.lit(0)) / F.lit(4.0)
    return F.when(F.col("score_scale") == 5, (mean - 1.0) * 1.5).otherwise(mean)
