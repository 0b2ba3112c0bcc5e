"""Toxicity, quality and outlier verdicts on small planted tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import outliers as O, quality as Q, toxicity as T
from tallyloom.llm.common import Words

SYLLABLES = "ba co di fe gu ha jo ki lu me no pa re si to vu wa xe yo zu".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def prose(rng, n, extra=()):
    words = [word(rng) for _ in range(n)]
    for x in extra:
        words.insert(rng.randrange(len(words)), x)
    return " ".join(words) + "."


def toxic_tables(spark, n=600):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 8 == 0
        rows.append((i, prose(rng, rng.randint(20, 60), rng.sample(["grumblor", "Snerkel!", "vexnard,"], 2) if bad else ())))
        if i % 3:
            labels.append((i, int(bad)))
    rows += [(n, ""), (n + 1, None), (None, "grumblor snerkel"), (n + 2, "grumblor snerkel vexnard " * 20_000)]
    labels += [(0, 0), (0, 1), (None, 1), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_generalises_to_texts_it_never_saw(spark):
    docs, labels = toxic_tables(spark)
    model, prior = T.train(docs, labels, lambda key: F.col(key) % 5 != 0)
    assert 0.05 < prior < 0.25
    rows = {r["doc_id"]: r["score"] for r in T.score(docs.withColumn("score", F.lit("x")), model).collect()}
    held = [i for i in range(600) if i % 5 == 0]
    right = [(rows[i] >= 0.5) == (i % 8 == 0) for i in held]
    assert np.mean(right) > 0.97
    assert rows[600] == rows[601] and 0 <= rows[600] < 0.5
    assert rows[None] > 0.5 and rows[602] > 0.5


def test_toxicity_never_reads_held_out_labels(spark):
    docs, labels = toxic_tables(spark, 200)
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    learn = lambda key: F.col(key) % 5 != 0
    a, b = T.train(docs, labels, learn)[0], T.train(docs, flipped, learn)[0]
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = toxic_tables(spark, 20)
    model, prior = T.train(docs, labels.where("false"), lambda key: F.lit(True))
    assert prior == 0 and all(r["score"] < 1e-6 for r in T.score(docs, model).collect())
    model, _ = T.train(docs.where("false"), labels, lambda key: F.lit(True))
    assert T.score(docs.where("false"), model).count() == 0


def quality_rows():
    rng = random.Random(3)
    rows = [prose(rng, rng.randint(30, 80)) for _ in range(300)]
    rows += ["*** ".join(word(rng) for _ in range(50)) + "###" for _ in range(25)]
    rows += [" | ".join(word(rng) for _ in range(50)) for _ in range(25)]
    rows += ["!! ".join(word(rng).upper() for _ in range(50)) for _ in range(25)]
    rows += [" ".join(w for w in (word(rng) for _ in range(4)) for _ in range(20)) for _ in range(25)]
    return rows


def test_quality_rejects_defects_and_keeps_prose(spark):
    texts = [*quality_rows(), None, "", "short text.", "word " * 200_000]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    model = Q.train(docs)
    rows = {r["doc_id"]: r for r in Q.judge(docs, model).collect()}
    assert np.mean([rows[i]["kept"] for i in range(300)]) > 0.99
    assert np.mean([rows[i]["kept"] for i in range(300, 400)]) < 0.05
    assert not rows[400]["kept"] and not rows[401]["kept"] and rows[402]["kept"]
    assert Q.judge(docs.where("false"), Q.train(docs.where("false"))).count() == 0


def test_repeated_and_null_ids_count_once_in_the_samples(spark):
    texts = quality_rows()
    once = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    again = once.unionAll(spark.createDataFrame([(3, texts[3])] * 50, "doc_id long, text string"))
    a, b = (Q.train(d, s=Q.Settings(sample=40)) for d in (once, again))
    assert ((a.weights != 0) == (b.weights != 0)).all() and len(Q.judge(again, b).collect()) == len(texts) + 50
    nulls = again.unionAll(spark.createDataFrame([(None, texts[0])] * 3, "doc_id long, text string"))
    assert Q.judge(nulls, Q.train(nulls)).where("doc_id is null and kept").count() == 3
    docs, labels = toxic_tables(spark, 120)
    hot = docs.unionAll(docs.where("doc_id = 1").crossJoin(spark.range(60)).drop("id"))
    s = T.Settings(most_positives=10, most_unlabelled=20)
    (w, i), (v, j) = (T.train(d, labels, lambda key: F.lit(True), s=s)[0] for d in (docs, hot))
    assert np.allclose(w, v) and i == pytest.approx(j)


def test_segment_hashes_and_shapes_against_plain_ones():
    import pyarrow as pa

    plain = ["", "Straße 2024!! aab", "aaa AAA a!a", "x" * 3000 + " é", None, "2024 99 7 x"]
    words = Words(pa.array(plain))
    distinct = [w.decode() for w in words.dictionary.to_pylist()]
    hashed, data = Q.segment_hashes(*Q.distinct_words(words)), Q.shape_hashes(words)
    assert len(set(hashed.tolist())) == len(distinct)

    def shape(word):
        out = []
        for c in word.encode():
            x = "A" if 65 <= c <= 90 else "a" if 97 <= c <= 122 or c >= 128 else "0" if 48 <= c <= 57 else chr(c)
            out += [x] if not out or out[-1] != x else []
        return "".join(out)

    by_shape = {}
    for w, h in zip(distinct, data.tolist()):
        assert by_shape.setdefault(shape(w), h) == h
    assert len(set(by_shape.values())) == len(by_shape)


def test_expectation_maximisation_over_rows_gives_what_patterns_give():
    rng = np.random.default_rng(4)
    votes = rng.integers(0, 3, (400, len(Q.LABELLERS)))
    votes[:250] = np.where(rng.random((250, len(Q.LABELLERS))) < 0.8, Q.GOOD, votes[:250])
    pattern, place, count = np.unique(Q.encode_votes(votes), return_inverse=True, return_counts=True)
    good, right, prior = Q.accuracies(pattern, count, rounds=30)
    # the same rounds, row by row
    p = [0.999 * 0.1 ** sum(x == Q.BAD for x in r) if any(x != Q.ABSTAIN for x in r) else 0.5 for r in votes]
    for _ in range(30):
        share = sum(p) / len(p)
        acc = {}
        for j in range(votes.shape[1]):
            for c in (Q.BAD, Q.GOOD):
                w = [x if c == Q.GOOD else 1 - x for x in p]
                acc[c, j] = (sum(a for a, r in zip(w, votes) if r[j] == c) + 2) / (sum(a for a, r in zip(w, votes) if r[j] != Q.ABSTAIN) + 3)
        new = []
        for r in votes:
            odds = np.log(share / (1 - share))
            for j, x in enumerate(r):
                if x != Q.ABSTAIN:
                    like_good = acc[Q.GOOD, j] if x == Q.GOOD else 1 - acc[Q.GOOD, j]
                    like_bad = acc[Q.BAD, j] if x == Q.BAD else 1 - acc[Q.BAD, j]
                    odds += np.log(like_good / like_bad)
            new.append(1 / (1 + np.exp(-odds)))
        p = new
    assert np.abs(good[place] - p).max() < 1e-6


def test_accuracies_are_recovered_from_votes():
    rng = np.random.default_rng(2)
    truth = (rng.random(30_000) < 0.8).astype(int)
    accuracy = rng.uniform(0.75, 0.95, len(Q.LABELLERS))
    right = rng.random((30_000, len(accuracy))) < accuracy
    votes = np.where(right, truth[:, None], 1 - truth[:, None])
    votes[rng.random(votes.shape) < 0.2] = Q.ABSTAIN
    pattern, count = np.unique(Q.encode_votes(votes), return_counts=True)
    good, found, prior = Q.accuracies(pattern, count)
    assert prior == pytest.approx(0.8, abs=0.02)
    assert np.abs(found[Q.GOOD] - accuracy).max() < 0.03 and np.abs(found[Q.BAD] - accuracy).max() < 0.05


def counts(text):
    """The base counts, written out plainly."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_are_those_of_the_rules(spark):
    rng = random.Random(5)
    line = prose(rng, 9)
    texts = [None, "", " \n\t ", "né é ñ # <b>", f"{line}\n{line}\nother\n \n \n{line}", "a b c d e f g h " * 3, prose(rng, 40), "x\x1cy z", "a\r\na\r\nb\n"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for r in O.counted(df).collect():
        assert tuple(r[c] for c in O.COUNTS) == counts(texts[r["doc_id"]]), texts[r["doc_id"]]


def outlier_table(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        lang, source = ("en", "a") if i % 2 else ("fr", None)
        text = prose(rng, rng.randint(30, 80))
        if i % 40 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, lang, source))
    rows += [(400, "too short", "en", "a"), (401, None, None, None), (402, prose(rng, 50), "xx", "only"), (403, "one two three four five six seven eight " * 9, "en", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_outliers_are_rejected_and_others_kept(spark):
    rows = {r["doc_id"]: r for r in O.judge(outlier_table(spark)).collect()}
    assert all(rows[i]["kept"] == (i % 40 != 0) for i in range(400))
    assert [rows[i]["base_failed"] for i in (400, 401, 402, 403)] == [True, True, False, True]
    assert rows[402]["kept"] and not rows[403]["kept"]
    empty = outlier_table(spark).where("false")
    assert O.judge(empty).count() == 0


def test_rows_of_rare_groups_are_judged_by_the_whole_table(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(30, 80)), "en", "a") for i in range(300)]
    rows += [(1000 + i, prose(rng, 50), f"l{i}", "rare") for i in range(8)]
    rows += [(2000 + i, " ".join(w + "###" for w in prose(rng, 50).split()), f"m{i}", None) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in O.judge(df).collect()}
    assert all(kept[1000 + i] for i in range(8)) and not any(kept[2000 + i] for i in range(8))
    few = df.where("doc_id >= 1000")  # too few to judge by at all
    assert all(r["kept"] for r in O.judge(few).collect())


def test_concentration_finds_the_clean_part():
    # against plain concentration steps over one group
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 1, (900, O.P)), rng.normal(9, 0.5, (250, O.P))])
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], ["grp", *O.VECTOR])
    got = O.estimates(df, O.Settings()).first()
    share, d = 0.75, None
    mean, scatter = np.median(x, axis=0), np.eye(O.P)
    grow = share / O.chi2(O.chi2_quantile(share, O.P), O.P + 2)
    for _ in range(60):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
        inside = x[np.argsort(d)[: int(np.ceil(share * len(x)))]]
        mean, scatter = inside.mean(axis=0), grow * np.cov(inside.T, bias=True) + np.diag(np.square(O.FLOOR))
    assert np.abs(np.array(got["mean"]) - mean).max() < 0.1
    assert np.abs(np.linalg.inv(np.array(got["inverse"]).reshape(O.P, O.P)) - scatter).max() < 0.25


def test_chi_square_quantiles():
    assert O.chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)
    assert O.chi2_quantile(0.975, 3) == pytest.approx(9.3484, abs=1e-3)


def test_words_are_cut_at_blanks_only():
    import pyarrow as pa

    words = Words(pa.array(["A b\x0bc", None, "", " d e ", "f"]), lower=True)
    assert [[words.dictionary[c].as_py().decode() for c in words.codes[a:b]] for a, b in zip(words.offsets, words.offsets[1:])] == [
        ["a", "b", "c"], [], [], ["d e"], ["f"],
    ]
