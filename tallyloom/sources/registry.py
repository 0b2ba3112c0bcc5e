"""Source registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators.adapters import ADAPTERS, normalize
from ..operators.align import resolve_type


@dataclass(frozen=True)
class Source:
    """One raw source: where it comes from and how it is read."""

    slug: str
    priority: int
    adapter: str
    load: Callable[[], DataFrame | None]
    forced_type: str | None = None
    allow_types: Sequence[str] | None = None


class Registry:
    """Sources by falling priority; of two with one slug the higher priority stays."""

    def __init__(self, sources: Sequence[Source]):
        ordered = sorted(sources, key=lambda s: -s.priority)
        unique: dict[str, Source] = {}
        for source in ordered:
            unique.setdefault(source.slug, source)
        self.sources = list(unique.values())

    def frames(self) -> list[tuple[Source, DataFrame, DataFrame]]:
        """(source, raw rows, corpus rows) of every source that is there; nothing is run yet."""
        out = []
        for source in self.sources:
            raw = source.load()
            if raw is None:
                continue
            adapted = ADAPTERS[source.adapter](raw)
            typed = resolve_type(adapted, source.forced_type, source.allow_types, strict=source.adapter == "umlcode")
            rows = normalize(typed, source.slug).withColumn("priority", F.lit(source.priority))
            out.append((source, raw, rows))
        return out

    def load(self) -> DataFrame:
        """All sources in one schema."""
        frames = [rows for _, _, rows in self.frames()]
        if not frames:
            raise ValueError("no source could be loaded")
        return reduce(DataFrame.unionByName, frames)


def source_yield(raw: DataFrame, kept: DataFrame, label: str) -> DataFrame:
    """A10: raw and kept rows per source in one aggregate."""
    both = raw.select(label, F.lit(1).alias("r"), F.lit(0).alias("k")).unionByName(
        kept.select(label, F.lit(0).alias("r"), F.lit(1).alias("k"))
    )
    return both.groupBy(label).agg(F.sum("r").alias("raw_rows"), F.sum("k").alias("kept_rows"))
