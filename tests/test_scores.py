"""Hand values of the score, vote and interval formulas."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import scores as S, stats as ST

W = {"qwen25vl3b": 53.1, "llama32vl11b": 50.7, "aya_vision_8b": 39.9}


def verdict(spark, values, render_ok=True, **kw):
    rows = [(1, k, w, v) for (k, w), v in zip(W.items(), values)]
    scores = spark.createDataFrame(rows, "artifact_id long, model_key string, weight double, score int")
    artifacts = spark.createDataFrame([(1, render_ok)], "artifact_id long, render_ok boolean")
    return S.with_verdicts(artifacts, scores, **kw).first()


def test_weighted_composite(spark):
    assert verdict(spark, [6, 4, 2]).composite_score == pytest.approx((6 * 53.1 + 4 * 50.7 + 2 * 39.9) / 143.7)


def test_missing_is_skipped_and_zero_counts(spark):
    assert verdict(spark, [0, None, 5]).composite_score == pytest.approx(5 * 39.9 / 93.0)


def test_failed_render_and_no_score_give_zero(spark):
    failed = verdict(spark, [6, 6, 6], render_ok=False)
    assert (failed.composite_score, failed.affirmative_votes, failed.dataset_accepted) == (0.0, 0, False)
    assert verdict(spark, [None, None, None]).composite_score == 0.0


def test_majority(spark):
    row = verdict(spark, [5, 4, 3])
    assert (row.majority_accepted, row.affirmative_votes) == (True, 2)
    assert verdict(spark, [5, 4, 3], min_composite=4.5).dataset_accepted is False


def test_wide_equals_long(spark):
    df = spark.createDataFrame([(0, None, 5), (6, 4, 2), (None, None, None)], "qwen25vl3b int, llama32vl11b int, aya_vision_8b int")
    got = [r[0] for r in df.select(S.wide_composite()).collect()]
    assert got[0] == pytest.approx(5 * 39.9 / 93.0)
    assert got[1] == pytest.approx((6 * 53.1 + 4 * 50.7 + 2 * 39.9) / 143.7)
    assert got[2] is None


def test_soft_cast(spark):
    df = spark.createDataFrame([("4.0",), ("junk",), ("",), (None,), ("5.9",)], "s string")
    assert [r[0] for r in df.select(S.to_int_score(F.col("s"))).collect()] == [4, None, None, None, 5]


def test_wilson(spark):
    low, high = ST.wilson(F.lit(0), F.lit(203))
    row = spark.range(1).select(low.alias("low"), high.alias("high")).first()
    assert row.low == 0.0 and row.high == pytest.approx(0.018572666233484945)
    low, _ = ST.wilson(F.lit(0), F.lit(0))
    assert spark.range(1).select(low).first()[0] is None


def test_review_scale(spark):
    df = spark.createDataFrame([(1, 5, 5, 5, 5), (3, 3, 3, 3, 6)], "semantic int, structural int, syntactic int, coherence int, score_scale int")
    assert [r[0] for r in df.select(S.human_six()).collect()] == [4.5, 3.0]


def test_correlations_without_variance_are_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0)], "g string, x double, y double")
    assert {r.g: r.pearson_r for r in ST.pearson(df, "x", "y", ["g"]).collect()} == {"a": None, "b": None}
    assert {r.g: r.spearman_rho for r in ST.spearman(df, "x", "y", ["g"]).collect()} == {"a": None, "b": None}


def test_half_goes_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (7.2,), (None,)], "s double")
    assert [r[0] for r in df.select(ST.score_bucket(F.col("s"))).collect()] == [0, 2, 2, 6, None]
