"""Harvest, quotas, balanced and stratified selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import fixed
from ..functions import text as X
from ..session import checkpointed
from . import dedupe as D
from .gates import first_reason
from .rank import BUCKET_DIGITS, exact_rank, id_levels, order_key, seeded_rank
from .stats import types_frame

OTHER = "__other__"


def _listed(kind: Column, types: Sequence[str]) -> Column:
    return F.when(kind.isin(*types), kind).otherwise(F.lit(OTHER))


def _ordered_types(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """The listed types with their place, and one place for everything else."""
    rows = F.array(
        *[F.struct(F.lit(i).alias("place"), F.lit(t).alias("stratum")) for i, t in enumerate([*types, OTHER])]
    )
    return df.sparkSession.range(1).select(F.inline(rows))


def quotas(counts: DataFrame, types: Sequence[str], target: int, per_type: int) -> DataFrame:
    """how many rows each stratum gives, in the declared order of types.

    First ``per_type`` each while the target lasts, then what is left over in the same order,
    then any other type. A running sum over a table with one row per type.
    """
    table = _ordered_types(counts, types).join(counts, "stratum", "left").fillna(0, ["n"])
    before = W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)  # one row per listed type
    want = F.when(F.col("stratum") == OTHER, F.lit(0)).otherwise(F.least(F.col("n"), F.lit(per_type)))

    def granted(wish: str, total: Column) -> Column:
        used = F.coalesce(F.sum(wish).over(before), F.lit(0))
        return F.greatest(F.lit(0), F.least(F.col(wish), total - used))

    first = table.withColumn("want", want).withColumn("take", granted("want", F.lit(target)))
    left = first.withColumn("rest", F.col("n") - F.col("take")).withColumn(
        "open", F.lit(target) - F.sum("take").over(W.partitionBy())
    )
    return left.withColumn("extra", granted("rest", F.col("open"))).select(
        "stratum", F.col("n").alias("available"), "take", "extra", (F.col("take") + F.col("extra")).alias("quota")
    )


def quota_select(
    df: DataFrame, types: Sequence[str], target: int, per_type: int, key: str, seed: int
) -> DataFrame:
    """the rows the quotas ask for, in seeded order within each stratum."""
    keyed = df.withColumn("stratum", _listed(F.col("diagram_type"), types))
    counts = keyed.groupBy("stratum").agg(F.count("*").alias("n"))
    asked = quotas(counts, types, target, per_type).select("stratum", "quota")
    ranked = seeded_rank(keyed, key, seed, by=["stratum"], below=target, groups=len(types) + 1)
    return ranked.join(F.broadcast(asked), "stratum").where(F.col("rank") <= F.col("quota")).drop("rank", "quota", "stratum")


def stratified(
    df: DataFrame, n: int, key: str, seed: int, types: Sequence[str] = fixed.APP_TYPES, by: str = "diagram_type"
) -> DataFrame:
    """F8: ``n`` rows per type in seeded order."""
    pool = df.where(F.col(by).isin(*types))
    return seeded_rank(pool, key, seed, by=[by], below=n, groups=len(types)).where(F.col("rank") <= n).drop("rank")


def shortfall(df: DataFrame, n: int, types: Sequence[str] = fixed.APP_TYPES) -> DataFrame:
    """F8: what each type lacks to reach ``n``."""
    counts = df.groupBy("diagram_type").agg(F.count("*").alias("n"))
    return (
        types_frame(df.sparkSession, types).join(counts, "diagram_type", "left")
        .select("diagram_type", (F.lit(n) - F.coalesce("n", F.lit(0))).alias("shortfall"))
        .where("shortfall > 0")
    )


def topup_even(novel: DataFrame, cap: int, key: str, seed: int, types: Sequence[str] = fixed.APP_TYPES, least: int = 500) -> DataFrame:
    """an even share per type up to the cap, then whatever is left in seeded order.

    The rest is told apart by key, never by position.
    """
    per = max(least, cap // 4)
    ranked = seeded_rank(
        novel.withColumn("stratum", _listed(F.col("diagram_type"), types)), key, seed, by=["stratum"],
        groups=len(types) + 1,
    )
    even = (F.col("stratum") != OTHER) & (F.col("rank") <= per)
    tiered = ranked.withColumn("tier", F.when(even, 0).otherwise(1)).drop("rank")
    keyed = tiered.withColumn("__md5", order_key(seed, key))
    placed = exact_rank(
        keyed, [F.col("tier"), F.col("__md5"), F.col(key)],
        [F.col("tier"), F.substring("__md5", 1, BUCKET_DIGITS)], name="place", max_offsets=2 * 16**BUCKET_DIGITS,
    )
    # the even tier stays whole even where it alone passes the cap
    return placed.where((F.col("tier") == 0) | (F.col("place") <= cap)).drop("__md5", "place", "stratum", "tier")


def language_select(
    df: DataFrame, preferred: Column, target: int, key: str, seed: int, most: int | None = None
) -> DataFrame:
    """the preferred source evenly by language, then its rest, then the other sources."""
    lang = F.coalesce("source_language", F.lit("unknown"))
    keyed = df.withColumn("__pref", F.coalesce(preferred, F.lit(False))).withColumn("__lang", lang)
    chosen, others = keyed.where("__pref"), keyed.where(~F.col("__pref"))
    # every language gets the same share, so its size is one number and no row is joined for it
    langs = chosen.agg(F.count_distinct("__lang").alias("n")).first()["n"]
    even = target // max(langs, 1)
    share = max(1, even if most is None else min(even, most))
    ranked = seeded_rank(chosen, key, seed, by=["__lang"])
    tiered = ranked.withColumn("__tier", F.when(F.col("rank") <= share, 0).otherwise(1)).drop("rank")
    tiered = tiered.unionByName(others.withColumn("__tier", F.lit(2)))
    md5 = tiered.withColumn("__md5", order_key(seed, key))
    placed = exact_rank(
        md5, [F.col("__tier"), F.col("__md5"), F.col(key)],
        [F.col("__tier"), F.substring("__md5", 1, BUCKET_DIGITS)], name="__place", below=target,
        max_offsets=3 * 16**BUCKET_DIGITS,
    )
    return placed.where(F.col("__place") <= target).drop("__md5", "__place", "__pref", "__lang").withColumnRenamed("__tier", "tier")


def balanced(
    df: DataFrame, per_type: int, per_lang: int, key: str, types: Sequence[str] = fixed.APP_TYPES
) -> DataFrame:
    """longest texts first per type, with a soft language cap carried from type to type.

    For each type in turn a row is eligible while its rank within its language is within what
    that language has left; the best eligible rows are taken, and deferred rows only fill a
    gap. Only the counts per language pass from one type to the next. A row without a language
    counts as ``java``; of chosen rows with the same text the one with the smallest key stays. All
    of it runs on keys and lengths; the texts are fetched at the end, for the chosen keys.
    """
    narrow = df.where(F.col("diagram_type").isin(*types)).select(
        key, "diagram_type", F.coalesce("source_language", F.lit("java")).alias("source_language"), (-F.length("uml_code")).alias("__a"),
        (-F.length("source_requirement")).alias("__b"), F.md5(F.col(key).cast("string")).alias("__m"),
    )
    order = [F.col("__a"), F.col("__b"), F.col("__m")]
    coarse = [F.col("__a"), F.col("__b"), F.substring("__m", 1, BUCKET_DIGITS)]
    # keys and lengths only, read once per type below
    ranked = checkpointed(
        exact_rank(narrow, order, coarse, by=["diagram_type", "source_language"], name="__lang_rank")
    )
    left = ranked.select("source_language").distinct().withColumn("__left", F.lit(per_lang).cast("long"))
    parts = []
    for kind in types:
        pool = ranked.where(F.col("diagram_type") == kind).join(left, "source_language")
        tiered = pool.withColumn("__tier", F.when(F.col("__lang_rank") <= F.col("__left"), 0).otherwise(1))
        placed = exact_rank(tiered, [F.col("__tier"), *order], [F.col("__tier"), *coarse], name="__place", below=per_type)
        # the counts below and the next type both read this cut
        chosen = checkpointed(placed.where(F.col("__place") <= per_type).select(key, "source_language"))
        parts.append(chosen.select(key))
        used = chosen.groupBy("source_language").agg(F.count("*").alias("__used"))
        left = left.join(used, "source_language", "left").select(
            "source_language", (F.col("__left") - F.coalesce("__used", F.lit(0))).alias("__left")
        )
    chosen = df.join(reduce(DataFrame.unionByName, parts), key, "left_semi")
    first = chosen.groupBy(F.sha1("uml_code").alias("__hash")).agg(F.min(key).alias(key)).select(key)
    return chosen.join(first, key, "left_semi")


def work_list(
    df: DataFrame, per_type: int, offset: int, key: str, types: Sequence[str] = fixed.APP_TYPES, strict: bool = True
) -> DataFrame:
    """F16: ``per_type`` rows of every type after skipping ``offset`` usable rows; a short type is an error
    unless ``strict`` is false.

    Order is the key's own order, so the list is the same however the table is stored.
    """
    usable = df.where(F.col("diagram_type").isin(*types) & (F.length(X.strip(F.col("source_requirement"))) >= 3))
    late = exact_rank(usable, [F.col(key)], id_levels(key), name="__seen").where(F.col("__seen") > offset)
    ranked = exact_rank(
        late.drop("__seen"), [F.col(key)], id_levels(key), by=["diagram_type"], name="place", below=per_type
    )
    chosen = ranked.where(F.col("place") <= per_type)
    if strict:
        chosen = checkpointed(chosen)  # counted here and read by the caller
        check_work_list(chosen, per_type, types)
    return chosen


def check_work_list(chosen: DataFrame, per_type: int, types: Sequence[str] = fixed.APP_TYPES) -> None:
    """Raise where a type is short; the answer is one row per type."""
    short = shortfall(chosen, per_type, types).collect()
    if short:
        raise ValueError("too few rows: " + ", ".join(f"{r.diagram_type} lacks {r.shortfall}" for r in short))


HARVEST_ORDER = ["human", "dataset", "majority", "score", "id"]


def harvest_marks(artifacts: DataFrame, reviewed: DataFrame, min_composite: float = 3.0, majority_only: bool = True) -> DataFrame:
    """every rendered artifact with the reason it is left out, or null."""
    human = reviewed.select("artifact_id").distinct().withColumn("human_reviewed", F.lit(True))
    rows = artifacts.where(F.col("render_status") == "success").join(human, "artifact_id", "left").fillna(False, ["human_reviewed"])
    eligible = F.col("dataset_accepted") | F.col("human_reviewed")
    if majority_only:
        eligible = eligible | F.col("majority_accepted")
    spec, code = X.strip(F.coalesce("technical_spec", F.lit(""))), X.strip(F.coalesce("plantuml_code", F.lit("")))
    usable = (F.length(spec) >= 40) & X.has_open_tag(code) & (F.length(code) >= 20)
    reason = first_reason(
        [
            ("ineligible", ~eligible),
            ("low_score", (F.coalesce("composite_score", F.lit(0.0)) < min_composite) & ~F.col("human_reviewed")),
            ("invalid", ~usable),
        ]
    )
    return rows.withColumn("reason", reason)


def harvest(marked: DataFrame, carry: Sequence[str] | None = None) -> DataFrame:
    """the accepted rows, best copy of every fingerprint first; ``carry`` as in ``keep_first``."""
    order = [
        F.when(F.col("human_reviewed"), 0).otherwise(1),
        F.when(F.col("dataset_accepted"), 0).otherwise(1),
        F.when(F.col("majority_accepted"), 0).otherwise(1),
        -F.coalesce("composite_score", F.lit(0.0)),
        -F.col("artifact_id"),
    ]
    good = marked.where(F.col("reason").isNull()).drop("reason")
    return D.keep_first(good, [X.line_fingerprint(X.strip(F.col("plantuml_code")))], order, copies="copies", carry=carry)


def harvest_stats(marked: DataFrame, kept: DataFrame) -> DataFrame:
    """scanned rows, rows per reason, copies, and what the kept rows are."""
    reasons = marked.agg(
        F.count("*").alias("scanned"),
        *[F.count_if(F.col("reason") == r).alias(f"skipped_{r}") for r in ("ineligible", "low_score", "invalid")],
    ).unpivot([], ["scanned", "skipped_ineligible", "skipped_low_score", "skipped_invalid"], "stat", "n")
    names = ["kept", "deduped", "dataset_accepted", "majority_only", "human_reviewed"]
    rest = kept.agg(
        F.count("*").alias("kept"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("deduped"),
        F.count_if("dataset_accepted").alias("dataset_accepted"),
        F.count_if(F.col("majority_accepted") & ~F.col("dataset_accepted")).alias("majority_only"),
        F.count_if("human_reviewed").alias("human_reviewed"),
    ).unpivot([], names, "stat", "n")
    return reasons.unionByName(rest)
