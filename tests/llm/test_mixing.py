"""Soft mixing against plain naive Bayes and plain projected gradient."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing as M
from tallyloom.llm.queries import QUERIES

TARGETS = {"x": 0.5, "y": 0.3, "z": 0.2}


def tables(spark, n=120):
    rng = random.Random(4)
    words = {d: [d + str(i) for i in range(20)] for d in TARGETS}
    common = ["the", "of", "and"]
    rows, labels = [], []
    for i in range(n):
        d = rng.choice(["x", "x", "x", "y", "y", "z"])
        other = rng.choice(list(TARGETS))
        text = [rng.choice(words[d] + common) for _ in range(rng.randint(5, 60))] + [rng.choice(words[other]) for _ in range(rng.randint(0, 12))]
        rows.append((i, " ".join(text), d))
        if i % 2:
            labels.append((i, d))
    rows += [(n, None, "x"), (n + 1, "", "y"), (n + 2, " \t ", None), (None, "x1 x2", "x"), (3, rows[3][1], rows[3][2]), (n + 3, "y1 " * 50_000, "y")]
    labels += [(0, "nowhere"), (1, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame(labels, "doc_id long, lang string")


def test_memberships_and_rates_are_those_of_the_plain_method(spark):
    docs, labels = tables(spark)
    s = M.Settings()
    rows = M.mix(docs.withColumn("rate", F.lit("old")), labels, TARGETS, s=s).collect()
    known = docs.join(labels.select("doc_id", F.col("lang").alias("d")).where(F.col("d").isin(*TARGETS)), "doc_id").select("d", "text")
    hashes = {}
    every = {w for r in docs.collect() for w in (r["text"] or "").split()}
    for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", M.hashed(F.col("w"), s.bits).alias("h")).collect():
        hashes[r["w"]] = r["h"]
    seen = {d: np.ones(1 << s.bits) for d in TARGETS}
    for r in known.collect():
        for w in (r["text"] or "").split():
            seen[r["d"]][hashes[w]] += 1
    totals = np.array([seen[d].sum() for d in TARGETS])
    p, tokens = [], []
    texts = [r["text"] for r in docs.collect()]
    for text in texts:
        words = (text or "").split()
        weight = min(1, s.evidence / max(len(words), 1))
        z = np.array([math.log(t / totals.sum()) + weight * sum(math.log(seen[d][hashes[w]] / t) for w in words) for d, t in zip(TARGETS, totals)])
        e = np.exp(z - z.max())
        p.append(e / e.sum())
        tokens.append(len(words))
    p, tokens = np.array(p), np.array(tokens, float)
    wanted = np.array(list(TARGETS.values())) * tokens.sum()
    rate, now = np.ones(len(p)), (p * tokens[:, None]).sum(axis=0)
    for _ in range(s.steps):
        error = ((rate * tokens)[:, None] * p).sum(axis=0) - wanted
        if np.abs(error).sum() <= s.tolerance * tokens.sum():
            break
        before, rate = rate, np.maximum(0, rate - p @ (error / now))
        if np.abs((((rate - before) * tokens)[:, None] * p).sum(axis=0)).sum() <= s.tolerance * tokens.sum():
            break
    want = sorted((int(t), *np.round(q, 6), round(r, 5)) for t, q, r in zip(tokens, p, rate))
    got = sorted((r["n_tokens"], *np.round(r["posterior"], 6), round(r["rate"], 5)) for r in rows)
    assert np.allclose(np.array(got, float), np.array(want, float), atol=1e-4)
    reached = sum(np.array(r["posterior"]) * r["rate"] * r["n_tokens"] for r in rows)
    assert reached == pytest.approx(wanted, rel=1e-3)
    assert all(r["rate"] >= 0 for r in rows)


def test_resampling_loses_nothing_and_comes_near_the_targets(spark):
    docs, labels = tables(spark)
    out = M.resample(docs, labels, TARGETS, budget="no_loss")
    assert out.columns == docs.columns
    before = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in out.collect()} == before


def test_no_loss_keeps_every_rate_at_one_or_more_and_meets_the_targets(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known = docs.select("doc_id", "lang").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = M.mix(docs, known, M.TARGETS, budget="no_loss").collect()
    assert min(r["rate"] for r in rows) >= 1
    totals = sum(np.array(r["posterior"]) * r["rate"] * r["n_tokens"] for r in rows)
    assert totals / totals.sum() == pytest.approx(list(M.TARGETS.values()), rel=0.01)
    assert {r["doc_id"] for r in M.resample(docs, known, M.TARGETS, budget="no_loss").collect()} == {r["doc_id"] for r in rows}


def test_no_loss_stays_bounded_where_no_budget_meets_the_targets(spark):
    docs, labels = tables(spark, 10)
    rows = M.mix(docs, labels.where("false"), TARGETS, budget="no_loss").collect()
    assert all(1 <= r["rate"] < 2 for r in rows)


def test_nothing_labelled_and_no_rows(spark):
    docs, labels = tables(spark, 10)
    rows = M.mix(docs, labels.where("false"), TARGETS).collect()
    assert all(np.allclose(r["posterior"], 1 / 3) for r in rows)
    assert M.mix(docs.where("false"), labels, TARGETS).count() == 0
    assert M.resample(docs.where("false"), labels, TARGETS, budget="no_loss").count() == 0


def test_no_python_in_the_plan(spark, folder):
    plan = QUERIES["op6_soft_mixing"](spark, folder)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_languages_are_told_apart_on_texts_without_a_label(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known = docs.select("doc_id", "lang").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = M.mix(docs, known, M.TARGETS).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id", "left_anti").collect()
    right = [list(M.TARGETS)[int(np.argmax(r["posterior"]))] == r["lang"] for r in rows if r["n_tokens"] >= 20]
    assert np.mean(right) > 0.8
