"""Bring differently shaped sources to one schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed, schema
from ..functions import text as X

MERGE_DEFAULTS = {
    "diagram_type": "class", "input_mode": "requirement", "source_language": "",
    "dataset_accepted": False, "majority_accepted": False,
}


def align(df: DataFrame, target: T.StructType, defaults: dict, source: str | None = None) -> DataFrame:
    """B1: exactly the target columns; a missing one gets its default, extra ones go.

    ``technical_spec`` and ``source_requirement`` stand in for each other when one is missing.
    """
    have = set(df.columns)
    twins = {"technical_spec": "source_requirement", "source_requirement": "technical_spec"}
    out: list[Column] = []
    for field in target:
        if field.name == "merge_source" and source is not None:
            c = F.lit(source)
        elif field.name in have:
            c = F.col(field.name)
        elif twins.get(field.name) in have:
            c = F.col(twins[field.name])
        elif field.name == "source_dataset" and source is not None:
            c = F.lit(source)
        else:
            c = F.lit(defaults.get(field.name))
        out.append(c.cast(field.dataType).alias(field.name))
    return df.select(*out)


def merge_sources(sources: Sequence[tuple[str, DataFrame]], keep: Sequence[str] = ()) -> DataFrame:
    """Union of sources in one schema, numbered by declared order in ``merge_rank``."""
    target = T.StructType(list(schema.MERGE))
    frames = []
    for rank, (label, df) in enumerate(sources):
        fields = T.StructType(list(target) + [df.schema[k] for k in keep])
        frames.append(align(df, fields, MERGE_DEFAULTS, label).withColumn("merge_rank", F.lit(rank)))
    return reduce(DataFrame.unionByName, frames)


def tag_source(df: DataFrame, source: str) -> DataFrame:
    """Name the source where a row does not."""
    return df.withColumn("source_dataset", F.coalesce("source_dataset", F.lit(source)))


def resolve_type(df: DataFrame, forced: str | None, allow: Sequence[str] | None, strict: bool = False) -> DataFrame:
    """Forced type, allow-list, unknown remapped to class when allowed, hard mismatch dropped."""
    inferred = F.col("inferred_type")
    kind = F.lit(forced) if forced else inferred
    if allow is not None:
        remap = F.lit("class") if "unknown" in allow else F.lit(None).cast("string")
        kind = F.when(kind.isin(*[a for a in allow if a != "unknown"]), kind).when(kind == "unknown", remap)
    out = df.withColumn("diagram_type", kind).where(F.col("diagram_type").isNotNull() & (F.col("diagram_type") != "unknown"))
    if forced and strict:
        out = out.where(~((inferred != F.col("diagram_type")) & inferred.isin(*fixed.HARD_MISMATCH_TYPES)))
    return out


def artifact_frame(artifacts: DataFrame) -> DataFrame:
    """The analyst's columns with ISO time."""
    return artifacts.select(
        F.col("artifact_id").alias("id"), "diagram_type", "input_mode", "source_language", "source_requirement",
        "technical_spec", F.col("plantuml_code").alias("uml_code"), "render_status", "image_path",
        F.col("composite_score").alias("scores"), "majority_accepted", "affirmative_votes", "dataset_accepted",
        F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


def artifact_summary(artifacts: DataFrame) -> DataFrame:
    """One short row per artifact."""
    return artifacts.select(
        F.col("artifact_id").alias("id"), "diagram_type", "input_mode", "render_status", "composite_score",
        "majority_accepted", "dataset_accepted",
        (F.coalesce(F.col("image_path"), F.lit("")).__ne__("") & (F.col("render_status") == "success")).alias("has_image"),
    )


def stamp_id(code: Column, ident: Column) -> Column:
    """A marker comment after the first opening tag keeps equal templates apart."""
    at = F.instr(code, "@startuml")
    mark = F.concat(F.lit("@startuml\n' training-id:"), ident.cast("string"))
    return F.when(at > 0, F.overlay(code, mark, at, F.lit(len("@startuml")))).otherwise(code)


def assign_language(raw: Column, key: Column, langs: Sequence[str] = fixed.FOCUS_LANGS) -> Column:
    """A language by key where the row has none of the wanted ones."""
    slot = F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(len(langs)))
    low = F.lower(X.strip(F.coalesce(raw, F.lit(""))))
    return F.when(low.isin(*langs), low).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in langs]), (slot + 1).cast("int"))
    )
