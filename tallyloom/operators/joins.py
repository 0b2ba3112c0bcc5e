"""Joins between entities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from .hold import hold


def insert_missing(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The base and those new rows whose key it lacks; ``inserted`` tells them apart."""
    fresh = new.join(base.select(key), key, "left_anti")
    return base.withColumn("inserted", F.lit(False)).unionByName(
        fresh.withColumn("inserted", F.lit(True)), allowMissingColumns=True
    )


def insert_counts(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """How many new rows would be inserted and how many are known."""
    known = base.select(key, F.lit(True).alias("__known"))
    return new.select(key).join(known, key, "left").agg(
        F.count_if(F.col("__known").isNull()).alias("inserted"), F.count_if(F.col("__known").isNotNull()).alias("skipped")
    )


def with_files(meta: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Metadata with its file's text; rows without a file carry the reason."""
    joined = meta.join(files, name, "left")
    return joined.withColumn("reason", F.when(F.col("text").isNull(), F.lit("missing_puml")))


def expand_types(requirements: DataFrame, types: Sequence[str] = fixed.APP_TYPES) -> DataFrame:
    """One work row per requirement and type, made inside the row."""
    return requirements.select("*", F.explode(F.array(*[F.lit(t) for t in types])).alias("diagram_type"))


def with_reviewer_names(reviews: DataFrame, reviewers: DataFrame) -> DataFrame:
    """The reviewer's name, ``unknown`` where there is none."""
    names = reviewers.select("reviewer_id", F.col("name").alias("reviewer_name"))
    return reviews.join(names, "reviewer_id", "left").fillna("unknown", ["reviewer_name"])


def upsert_reviewers(existing: DataFrame, seen: DataFrame) -> DataFrame:
    """One row per name; the latest role wins and new names get the next ids in name order.

    New names are ranked exactly without a single-task window over the names.
    """
    from .rank import BUCKET_DIGITS, exact_rank

    latest = seen.groupBy("name").agg(F.max_by("role", "at").alias("__role"))
    merged = existing.join(latest, "name", "left").select(
        "id", "name", F.coalesce("__role", "role").alias("role"), F.lit(False).alias("created")
    )
    fresh = latest.join(existing.select("name"), "name", "left_anti")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    keyed = fresh.withColumn("__md5", F.md5("name"))
    ranked = exact_rank(
        keyed, [F.col("__md5"), F.col("name")], [F.substring("__md5", 1, BUCKET_DIGITS)], name="__rank",
        max_offsets=16**BUCKET_DIGITS,
    )
    created = ranked.select((F.col("__rank") + top).alias("id"), "name", F.col("__role").alias("role"), F.lit(True).alias("created"))
    return merged.unionByName(created)


def golden_compare(expected: DataFrame, actual: DataFrame, case: str) -> DataFrame:
    """Language match and missing classes per case."""
    joined = expected.join(actual, case, "left")
    low = F.array_distinct(F.transform(F.coalesce("actual_classes", F.array().cast("array<string>")), F.lower))
    joined = hold(joined, {"__low": low, "__wanted": F.transform("expected_classes", F.lower)})
    # one hash pass; only where some are there and some are not is each looked up among the latter
    joined = hold(joined, {"__lost": F.array_except("__wanted", F.col("__low"))})
    none = F.size(F.array_intersect("__wanted", F.col("__low"))) == 0
    some = F.filter("expected_classes", lambda c: F.array_contains("__lost", F.lower(c)))
    missing = F.when(F.size("__lost") == 0, F.slice("expected_classes", 1, 0)).when(none, F.filter("expected_classes", lambda c: c.isNotNull())).otherwise(some)
    joined = hold(joined, {"__missing": missing})
    missing = F.col("__missing")
    return joined.select(
        case, (F.col("expected_language") == F.col("actual_language")).alias("language_ok"),
        F.array_sort(missing).alias("missing"), (F.size(missing) == 0).alias("classes_ok"),
    )


def detail_rows(
    artifacts: DataFrame, scores: DataFrame, renders: DataFrame, repairs: DataFrame, reviews: DataFrame
) -> DataFrame:
    """Every child of every artifact as one row, in sections.

    The table-wide form: nothing is collected per artifact, so an artifact with very many
    attempts is only many rows.
    """
    def rows(df: DataFrame, section: str, place: Column, info: Column) -> DataFrame:
        return df.select("artifact_id", F.lit(section).alias("section"), place.cast("string").alias("place"), info.alias("info"))

    parts = [
        rows(artifacts, "artifact", F.lit(""), F.concat_ws("|", "diagram_type", "render_status")),
        rows(scores, "score", F.col("model_key"), F.concat_ws("|", F.col("weight").cast("string"), F.coalesce(F.col("score").cast("string"), F.lit("na")))),
        rows(renders, "render", F.col("attempt_number"), F.concat_ws("|", F.col("success").cast("string"), F.coalesce("error_output", F.lit("")))),
        rows(repairs, "repair", F.col("attempt_number"), F.concat_ws("|", F.col("success").cast("string"), F.coalesce("reason", F.lit("")))),
        rows(reviews, "review", F.col("reviewer_id"), F.concat_ws("|", "reviewer_name", F.col("score_scale").cast("string"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def detail_record(details: DataFrame, artifact_id: int) -> DataFrame:
    """Everything about one artifact in page order; rows, so that no list can outgrow a task."""
    return details.where(F.col("artifact_id") == artifact_id).orderBy("section", "place", "info")
