"""Summaries, histograms, scoreboards and agreement statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .. import fixed
from ..session import checkpointed
from .rank import bucket_offsets
from .scores import human_six



def types_frame(spark: SparkSession, types: Sequence[str] = fixed.APP_TYPES) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in types])).alias("diagram_type"))


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Several one-row frames side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def score_bucket(c: Column) -> Column:
    """0-6 bucket, halves to the even neighbour."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(6), F.bround(c).cast("int"))))


# summaries --------------------------------------------------------------------------------

def summary(artifacts: DataFrame, repairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """The global figures in one row."""
    failed = F.col("render_status") != "success"
    base = artifacts.agg(
        F.count("*").alias("total_artifacts"),
        F.avg("composite_score").alias("mean_composite"),
        F.count_if(failed).alias("render_failures"),
        F.count_if(failed & (F.col("diagram_type") == "package")).alias("package_failure_count"),
        F.count_if("majority_accepted").alias("majority_accepted_count"),
        F.count_if("dataset_accepted").alias("dataset_accepted_count"),
    ).withColumn("majority_acceptance_rate", share(F.col("majority_accepted_count"), F.col("total_artifacts")))
    fixes = repairs.agg(F.count("*").alias("repair_attempts"), F.count_if("success").alias("repair_successes"))
    return one_row([base, fixes, reviews.agg(F.count("*").alias("human_review_count"))])


def type_stats(artifacts: DataFrame, types: Sequence[str] = fixed.APP_TYPES) -> DataFrame:
    """Per-type figures, empty types included with null rates."""
    counted = artifacts.groupBy("diagram_type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("render_status") == "success").alias("rendered"),
        F.avg("composite_score").alias("mean_s"),
        F.count_if("majority_accepted").alias("majority"),
        F.count_if("dataset_accepted").alias("dataset"),
    )
    n = F.coalesce("n", F.lit(0))
    return types_frame(artifacts.sparkSession, types).join(counted, "diagram_type", "left").select(
        "diagram_type",
        n.alias("n"),
        (n - F.coalesce("rendered", F.lit(0))).alias("failures"),
        pct(F.col("rendered"), F.col("n")).alias("success_pct"),
        "mean_s",
        pct(F.col("majority"), F.col("n")).alias("majority_accept_pct"),
        pct(F.col("dataset"), F.col("n")).alias("dataset_accept_pct"),
    )


def _histogram(grouped, label: str, score: Column) -> DataFrame:
    wide = grouped.agg(*[F.count_if(score_bucket(score) == i).alias(str(i)) for i in range(7)])
    return wide.unpivot([label], [str(i) for i in range(7)], "bucket", "n").withColumn(
        "bucket", F.col("bucket").cast("int")
    )


def score_hist(artifacts: DataFrame) -> DataFrame:
    """Zero-filled 0-6 histogram, per type and overall, in one pass."""
    wide = _histogram(artifacts.rollup("diagram_type"), "diagram_type", F.col("composite_score"))
    return wide.withColumn("diagram_type", F.coalesce("diagram_type", F.lit("all")))


def model_hist(model_scores: DataFrame) -> DataFrame:
    """Histogram per model; missing scores are left out."""
    return _histogram(model_scores.groupBy("model_key"), "model_key", F.col("score").cast("double"))


def corpus_summary(df: DataFrame, score: str) -> DataFrame:
    """Per type, null types left out; a missing or zero score is a failure."""
    return (
        df.where(F.col("diagram_type").isNotNull())
        .groupBy("diagram_type")
        .agg(
            F.count("*").alias("n"),
            F.avg(score).alias("mean_score"),
            F.count_if(F.coalesce(F.col(score), F.lit(0.0)) == 0).alias("render_failures"),
        )
    )


def counter(df: DataFrame, column: str, n: int | None = None, null_label: str | None = None) -> DataFrame:
    """Value counts, most frequent first; null keys are dropped or get a label."""
    key = F.col(column).cast("string")
    key = F.coalesce(key, F.lit(null_label)) if null_label is not None else key
    counts = df.select(key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    return counts if n is None else counts.orderBy(F.desc("n"), "key").limit(n)


def length_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median, p90 and mean of text lengths, from counts per length."""
    lengths = df.select(*[F.length(c).alias(c) for c in columns]).unpivot([], list(columns), "column", "chars")
    counts = lengths.where("chars IS NOT NULL").groupBy("column", "chars").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(
        F.percentile("chars", F.lit(0.5), F.col("n")).alias("p50"),
        F.percentile("chars", F.lit(0.9), F.col("n")).alias("p90"),
        (F.sum(F.col("chars") * F.col("n")) / F.sum("n")).alias("mean"),
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share, null for an empty group."""
    size = F.when(n > 0, n.cast("double"))
    p = k / size
    denom = 1.0 + z * z / size
    centre = (p + z * z / (2 * size)) / denom
    margin = F.lit(z) * F.sqrt((p * (1 - p) + z * z / (4 * size)) / size) / denom
    low = F.when(size.isNotNull(), F.greatest(F.lit(0.0), centre - margin))
    high = F.when(size.isNotNull(), F.least(F.lit(1.0), centre + margin))
    return low, high


def type_table(artifacts: DataFrame) -> DataFrame:
    """Mean, spread, failures and success share per type."""
    return artifacts.groupBy("diagram_type").agg(
        F.count("*").alias("n"),
        F.avg("composite_score").alias("mean_s"),
        F.stddev_samp("composite_score").alias("sd"),
        F.count_if(F.col("render_status") != "success").alias("failures"),
        pct(F.count_if(F.col("render_status") == "success"), F.count("*")).alias("success_pct"),
    )


GATES = {
    "generated": "generated", "compiled": "compile_ok", "syntax_valid": "syntax_ok",
    "rendered": "render_ok", "uml_rule_pass": "uml_rules_ok", "semantic_aligned": "semantic_ok",
    "accepted": "accepted",
}


def scoreboard(cases: DataFrame, by: str) -> DataFrame:
    """Passes and rates per gate; a compile that was not run counts as passed."""
    passed = {k: F.count_if(F.coalesce(F.col(c), F.lit(True))) if k == "compiled" else F.count_if(c) for k, c in GATES.items()}
    return cases.groupBy(by).agg(
        F.count("*").alias("total"),
        *[p.alias(k) for k, p in passed.items()],
        *[F.round(p / F.count("*"), 4).alias(f"{k}_rate") for k, p in passed.items()],
        F.round(F.avg("retry_count"), 3).alias("average_repair_iterations"),
        F.count_if(~F.col("accepted")).alias("remaining_failures"),
    )


def failure_distribution(cases: DataFrame, by: str) -> DataFrame:
    return cases.where(~F.col("accepted") & F.col("failure_category").isNotNull()).groupBy(
        by, "failure_category"
    ).agg(F.count("*").alias("n"))


def negative_controls(cases: DataFrame) -> DataFrame:
    """Cases that must be rejected."""
    rejected = F.count_if(~F.col("accepted"))
    total = F.count("*")
    return cases.agg(
        total.alias("total"),
        rejected.alias("correctly_rejected"),
        (total - rejected).alias("false_accepts"),
        F.round(rejected / F.greatest(F.lit(1), total), 4).alias("true_negative_rate"),
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """Passes and failures by type and by language in one pass, with the total."""
    lang = F.coalesce("source_language", "human_language", F.lit("n/a"))
    keyed = results.select("diagram_type", lang.alias("language"), "ok", "composite_score")
    grouped = keyed.groupingSets([["diagram_type"], ["language"], []], "diagram_type", "language").agg(
        F.grouping_id().alias("g"),
        F.count_if("ok").alias("ok"),
        F.count_if(~F.col("ok")).alias("fail"),
        F.avg(F.coalesce("composite_score", F.lit(0.0))).alias("mean_composite"),
    )
    facet = F.when(F.col("g") == 1, "diagram_type").when(F.col("g") == 2, "language").otherwise("total")
    return grouped.select(
        facet.alias("facet"),
        F.when(F.col("g") == 1, F.col("diagram_type")).when(F.col("g") == 2, F.col("language")).otherwise("all").alias("key"),
        "ok", "fail", "mean_composite",
    )


def scorer_histogram(model_scores: DataFrame) -> DataFrame:
    """How many scorers answered per artifact, with shares of at least one, two, three."""
    per = model_scores.groupBy("artifact_id").agg(F.count_if("available").alias("scorers"))
    return per.agg(
        F.count("*").alias("runs"),
        *[F.count_if(F.col("scorers") == i).alias(f"with_{i}") for i in range(4)],
        *[F.round(pct(F.count_if(F.col("scorers") >= i), F.count("*")), 1).alias(f"pct_at_least_{i}") for i in (1, 2, 3)],
    )


def scorer_rates(model_scores: DataFrame) -> DataFrame:
    return model_scores.groupBy("model_key").agg(
        F.round(F.count_if("available") / F.count("*"), 3).alias("available_rate"),
        F.round(F.count_if(~F.col("available")) / F.count("*"), 3).alias("failure_rate"),
    )


def top_errors(model_scores: DataFrame, k: int = 3) -> DataFrame:
    """Most frequent failure messages per scorer."""
    counts = model_scores.where("error IS NOT NULL").groupBy("model_key", "error").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("model_key").orderBy(F.desc("n"), "error"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def run_quality(artifacts: DataFrame) -> DataFrame:
    """Runs, how many made a text and a picture, and the mean score of those with a picture (0 without any)."""
    drawn = F.col("render_status") == "success"
    return artifacts.agg(
        F.count("*").alias("runs"),
        F.count_if(drawn).alias("render_success"),
        F.count_if(F.length(F.coalesce("plantuml_code", F.lit(""))) > 0).alias("generation_ok"),
        (F.coalesce(F.sum(F.when(drawn, F.coalesce("composite_score", F.lit(0.0)))), F.lit(0.0)) / F.greatest(F.count_if(drawn), F.lit(1))).alias(
            "mean_composite_when_render_ok"
        ),
    )


def rescored(before: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The fresh scores, and of the rest the earlier ones; ``reused`` tells which is which."""
    rest = before.join(fresh.select(key), key, "left_anti")
    return fresh.withColumn("reused", F.lit(False)).unionByName(rest.withColumn("reused", F.lit(True)))


def rescore_rollup(artifacts: DataFrame) -> DataFrame:
    """Per type and overall; of rows from :func:`rescored` also how many are reused and new."""
    kinds = [F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("new")] if "reused" in artifacts.columns else []
    return artifacts.rollup("diagram_type").agg(
        *kinds,
        F.count("*").alias("n"),
        F.avg("composite_score").alias("mean_s"),
        F.count_if("majority_accepted").alias("majority"),
        F.count_if("dataset_accepted").alias("dataset"),
        share(F.count_if("majority_accepted"), F.count("*")).alias("majority_rate"),
        share(F.count_if("dataset_accepted"), F.count("*")).alias("dataset_rate"),
    ).withColumn("diagram_type", F.coalesce("diagram_type", F.lit("all")))


def job_progress(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Jobs with the number of their artifacts and the share that is done."""
    made = artifacts.groupBy("job_id").agg(
        F.count("*").alias("artifacts"), F.count_if(F.col("render_status") == "success").alias("rendered")
    )
    return jobs.join(made, "job_id", "left").select(
        "job_id", "status",
        F.coalesce("artifacts", F.lit(0)).alias("artifacts"),
        share(F.col("rendered"), F.col("artifacts")).alias("completion"),
    )


def funnel(corpus: DataFrame) -> DataFrame:
    """Total, scored, majority, accepted."""
    return corpus.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("composite_score") > 0).alias("scored"),
        F.count_if("majority_accepted").alias("majority"),
        F.count_if("dataset_accepted").alias("accepted"),
    )


# agreement ----------------------------------------------------------------------------------

def review_counts(reviews: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Reviews with their artifact's type and composite, equal reviews counted together.

    Counting first keeps an artifact that attracts very many reviews to a few rows.
    """
    grouped = reviews.groupBy("artifact_id", "reviewer_id", human_six().alias("human")).agg(F.count("*").alias("n"))
    return grouped.join(artifacts.select("artifact_id", "diagram_type", "composite_score"), "artifact_id")


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Null below two complete pairs or without variance."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return both.groupBy(*by).agg(
        F.count("*").alias("n"), F.when(varied, r).alias("pearson_r")
    )


def _average_ranks(pairs: DataFrame, x: str, by: Sequence[str], resolution: int, name: str) -> DataFrame:
    """Average rank of every distinct value from the counts of the values before it."""
    counts = pairs.groupBy(*by, x).agg(F.sum("__w").alias("__n"))
    coarse = counts.withColumn("__c", F.floor(F.col(x) * resolution))
    offsets = bucket_offsets(coarse, by, ["__c", x], "__n")
    return counts.join(offsets.drop("__c"), [*by, x]).select(
        *by, x, (F.col("__offset") + (F.col("__n") + 1) / 2.0).alias(name), ((F.col("__size") + 1) / 2.0).alias(f"{name}_mid")
    )


def spearman(
    df: DataFrame, x: str, y: str, by: Sequence[str], weight: str | None = None, resolution: int = 64
) -> DataFrame:
    """Pearson over average ranks, computed on counted distinct pairs.

    Rows collapse to distinct pairs before anything is ranked or joined, so repeated values
    (scores have few) cost one row each however often they occur.
    """
    w = F.sum(weight) if weight else F.count("*")
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(w.alias("__w"))
    pairs = checkpointed(pairs)  # read four times below; without the cut every read would scan the reviews
    ranked = pairs.join(_average_ranks(pairs, x, by, resolution, "__rx"), [*by, x]).join(
        _average_ranks(pairs, y, by, resolution, "__ry"), [*by, y]
    )
    # the middle rank comes with the ranks: no join by group, whose rows one task would have to take
    dx, dy = F.col("__rx") - F.col("__rx_mid"), F.col("__ry") - F.col("__ry_mid")
    return (
        ranked.groupBy(*by)
        .agg(
            F.sum(F.col("__w")).alias("n"),
            F.sum(F.col("__w") * dx * dy).alias("sxy"),
            F.sum(F.col("__w") * dx * dx).alias("sxx"),
            F.sum(F.col("__w") * dy * dy).alias("syy"),
        )
        .select(*by, "n", F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))).alias("spearman_rho"))
    )


def _weighted_pearson(df: DataFrame, x: str, y: str, w: str, by: str) -> DataFrame:
    n, cx, cy = F.sum(w), F.col(x), F.col(y)
    sx, sy = F.sum(F.col(w) * cx), F.sum(F.col(w) * cy)
    sxy, sxx, syy = F.sum(F.col(w) * cx * cy), F.sum(F.col(w) * cx * cx), F.sum(F.col(w) * cy * cy)
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    r = F.try_divide(sxy - sx * sy / n, F.sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)))
    return df.groupBy(by).agg(n.alias("n"), F.when(varied, r).alias("pearson_r"))


def alignment(reviews: DataFrame, artifacts: DataFrame, types: Sequence[str] = fixed.APP_TYPES) -> DataFrame:
    """Pairs, raters and both correlations, overall and per type, empty types included.

    ``n_reviews`` counts all reviews, also those whose artifact is gone; it is null per type.
    """
    scoped = review_counts(reviews, artifacts).withColumn(
        "scope", F.explode(F.array(F.lit("all"), F.col("diagram_type")))
    )
    raters = scoped.groupBy("scope").agg(F.count_distinct("reviewer_id").alias("n_raters"))
    pairs = checkpointed(scoped.groupBy("scope", "composite_score", "human").agg(F.sum("n").alias("n")))
    linear = _weighted_pearson(pairs, "composite_score", "human", "n", "scope")
    ranks = spearman(pairs, "composite_score", "human", ["scope"], weight="n").drop("n")
    every = reviews.agg(F.count("*").alias("n_reviews")).select(F.lit("all").alias("scope"), "n_reviews")
    scopes = types_frame(artifacts.sparkSession, ["all", *types]).select(F.col("diagram_type").alias("scope"), F.lit(None).cast("long").alias("n_reviews"))
    scopes = scopes.unionByName(every).groupBy("scope").agg(F.max("n_reviews").alias("n_reviews"))
    return (
        scopes.join(linear, "scope", "left").join(ranks, "scope", "left").join(raters, "scope", "left")
        .select("scope", "n_reviews", F.coalesce("n", F.lit(0)).alias("n_pairs"), F.coalesce("n_raters", F.lit(0)).alias("n_raters"),
                "pearson_r", "spearman_rho")
    )


def fleiss(ratings: DataFrame, by: str, item: str, category: Column, raters: int, k: int = 7) -> DataFrame:
    """Fleiss' kappa over items rated by exactly ``raters`` raters."""
    cells = [F.count_if(category == j).alias(f"c{j}") for j in range(k)]
    items = ratings.groupBy(by, item).agg(F.count("*").alias("m"), *cells).where(F.col("m") == raters)
    squares = sum((F.col(f"c{j}") * F.col(f"c{j}") for j in range(k)), F.lit(0))
    agreement = (squares - raters) / F.lit(float(raters * (raters - 1)))
    shares = [(F.sum(f"c{j}") / (F.count("*") * raters)).alias(f"p{j}") for j in range(k)]
    per = items.groupBy(by).agg(F.count("*").alias("items"), F.avg(agreement).alias("observed"), *shares)
    chance = sum((F.col(f"p{j}") * F.col(f"p{j}") for j in range(k)), F.lit(0.0))
    return per.select(by, "items", "observed", chance.alias("chance")).withColumn(
        "kappa", F.try_divide(F.col("observed") - F.col("chance"), 1.0 - F.col("chance"))
    )


def review_delta(reviews: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Human minus ensemble per type, with mean and spread over the counted reviews."""
    counted = review_counts(reviews, artifacts).withColumn("d", F.col("human") - F.col("composite_score"))
    n, s, q = F.sum("n"), F.sum(F.col("n") * F.col("d")), F.sum(F.col("n") * F.col("d") * F.col("d"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(q - s * s / n, n - 1)))
    return counted.groupBy("diagram_type").agg(
        n.alias("n"), (s / n).alias("mean_delta"), F.when(n > 1, spread).alias("sd_delta")
    )
