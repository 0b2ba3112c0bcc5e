"""Filters and quality gates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions import code as CD, text as X
from . import structure as ST
from .hold import hold


def library(
    df: DataFrame,
    diagram_type: str | None = None,
    render_status: str | None = None,
    dataset_accepted: bool | None = None,
    majority_accepted: bool | None = None,
    job_id: int | None = None,
    min_score: float | None = None,
    q: str | None = None,
) -> DataFrame:
    """Any of the filters; the search text is taken literally."""
    for column, value in [
        ("diagram_type", diagram_type or None), ("render_status", render_status or None),
        ("dataset_accepted", dataset_accepted), ("majority_accepted", majority_accepted), ("job_id", job_id),
    ]:
        if value is not None:
            df = df.where(F.col(column) == value)
    if min_score is not None:
        df = df.where(F.col("composite_score") >= min_score)
    needle = re.sub(r"[%_]", " ", q or "").strip()
    if needle:
        df = df.where(F.contains(F.lower("source_requirement"), F.lit(needle.lower())))
    return df


def page(df: DataFrame, limit: int, offset: int, most: int = 100) -> DataFrame:
    """Newest first; a sort with limit, so no full sort of the table."""
    return df.orderBy(F.desc("artifact_id")).offset(max(0, offset)).limit(max(1, min(limit, most)))


def min_gate(df: DataFrame, spec: str = "technical_spec", code: str = "uml_code", min_code: int = 20) -> DataFrame:
    """Enough spec, enough code, an opening tag."""
    return df.where(
        (F.length(F.col(spec)) >= 40) & X.has_open_tag(F.col(code)) & (F.length(X.strip(F.col(code))) >= min_code)
    )


def with_complete(
    df: DataFrame, code: str, min_entities: int = 3, min_relations: int = 2, min_chars: int = 280
) -> DataFrame:
    """C4: ``complete`` tells both tags, enough text, entities and relations, no numbered stubs."""
    rows = hold(df, {"__code": X.clean_code(F.col(code))})
    s = F.col("__code")
    complete = (
        X.has_open_tag(s) & X.has_close_tag(s) & (F.length(s) >= min_chars)
        & ~F.rlike(s, F.lit(r"\bType[23]\b"))
        & (F.size(ST.entity_names(s)) >= min_entities)
        & (ST.relation_count(s) >= min_relations)
    )
    return hold(rows, {"complete": complete}).drop("__code")


def code_gate(code: Column, low: int = 80, high: int = 6000) -> Column:
    """Plausible source text with a named type that is not numbered filler and not minified."""
    types = F.filter(CD.type_names(code), lambda n: ~F.rlike(n, F.lit(r"(?i)^Module\d+$")))
    minified = (X.count_char(code, "\n") < 2) & (F.length(code) > 400)
    return (
        F.length(code).between(low, high) & CD.looks_like_code(code) & (F.size(types) > 0) & ~minified
    )


def is_stub(source: Column) -> Column:
    """A repository header or too short a text."""
    return (
        F.rlike(source, F.lit(r"(?md)^\s*//\s*Repository:")) | (F.length(source) < 350) | (X.count_char(source, "\n") < 8)
    )


def clamp(df: DataFrame, code: str, low: int, high: int) -> DataFrame:
    """Drop what is too short, cut and close what is too long."""
    c = F.col(code)
    cut = F.concat(X.rstrip(F.substring(c, 1, high - 20)), F.lit("\n@enduml"))
    return df.where(F.length(c) >= low).withColumn(code, F.when(F.length(c) > high, cut).otherwise(c))


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The first rule that applies, or null for a row that stays."""
    reason = F.when(rules[0][1], F.lit(rules[0][0]))
    for name, test in rules[1:]:
        reason = reason.when(test, F.lit(name))
    return reason


def reason_counts(marked: DataFrame, survivors: DataFrame, copies: str) -> DataFrame:
    """Rows per reason, with ``kept`` and the copies the dedupe removed."""
    dropped = marked.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))
    rest = survivors.agg(F.count("*").alias("kept"), F.coalesce(F.sum(F.col(copies) - 1), F.lit(0)).alias("dedupe"))
    tail = rest.unpivot([], ["kept", "dedupe"], "reason", "n")
    return dropped.unionByName(tail)


def subset(df: DataFrame, types: Sequence[str] | None = None, langs: Sequence[str] | None = None) -> DataFrame:
    """Types and languages, whatever their case."""
    if types:
        df = df.where(F.lower("diagram_type").isin(*[t.lower() for t in types]))
    if langs:
        df = df.where(F.lower("source_language").isin(*[x.lower() for x in langs]))
    return df


def needs_rescore(artifacts: DataFrame, model_scores: DataFrame) -> DataFrame:
    """Rendered artifacts without a real score; mock replies do not count."""
    marks = model_scores.groupBy("artifact_id").agg(
        F.bool_or(F.contains(F.lower(F.coalesce("explanation", F.lit(""))), F.lit(fixed.MOCK_MARKER))).alias("mock")
    )
    joined = artifacts.where(F.col("render_status") == "success").join(marks, "artifact_id", "left")
    real = (F.col("composite_score") > 0) & (F.col("affirmative_votes") > 0) & ~F.coalesce("mock", F.lit(False))
    return joined.where(~real).drop("mock")


def reap_stale(jobs: DataFrame, now: Column, max_age_minutes: int | None) -> DataFrame:
    """C11: waiting or running jobs untouched since the cutoff become failed."""
    touched = F.coalesce("updated_at", "created_at")
    active = F.col("status").isin("running", "pending")
    if max_age_minutes is None or max_age_minutes <= 0:
        stale = active
        reason = F.concat(
            F.lit("Reaped orphaned "), F.col("status"),
            F.lit(" job on API startup (in-process worker did not survive restart)."),
        )
    else:
        cutoff = now - F.make_dt_interval(mins=F.lit(max_age_minutes))
        stale = active & (touched.isNull() | (touched <= cutoff))
        reason = F.concat(
            F.lit("Reaped stale "), F.col("status"),
            F.lit(f" job after {max_age_minutes}m without completion (likely API restart mid-run)."),
        )
    return jobs.select(
        "job_id",
        F.when(stale, "failed").otherwise(F.col("status")).alias("status"),
        F.when(stale, F.coalesce(F.nullif("error", F.lit("")), reason)).otherwise(F.col("error")).alias("error"),
        F.when(stale, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.coalesce(stale, F.lit(False)).alias("reaped"),
    )
