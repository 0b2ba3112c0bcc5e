"""The language model against counts and probabilities written out plainly."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import ngram_lm as L
from tallyloom.llm.elias_fano import LOWEST, STEPS, Monotone, Trie

TEXTS = [
    (1, "the cat sat on the mat", False), (2, "The cat ran", False), (3, None, False), (4, "", True), (5, "the dog\tsat on the moon\n", True),
    (6, "the cat sat on the mat", False), (6, "the cat sat on the mat", False), (None, "no id here", False), (7, "ÉTÉ été the end", True),
]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3)
    return L.score(df, F.col("held"))


def test_scores_are_those_of_the_formula(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_TOKENS", 10)
    monkeypatch.setattr(L, "CHUNK_BYTES", 40)
    rows = run(spark, TEXTS).collect()
    assert len(rows) == len(TEXTS)
    train = [words(t) for _, t, held in TEXTS if not held]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["^"] + t, t))
    n, v = sum(c.values()), len(c)
    context = Counter(p for t in train for p in ["^"] + t[:-1])
    bins = Counter(round(math.log(x) * 64) for x in c.values())
    lower = L.Lower([{"tokens": n, "words": v, "ends": len(train), "bins": np.array(list(bins)), "words_in": np.array(list(bins.values()))}])

    def expected(text):
        t = words(text)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for a, w in zip(["^"] + t, t):
            single = (c[w] + 1) / (n + v + 1)
            if context[a]:
                weight = lower.weight(np.array([context[a]]))[0]
                single = (pairs[a, w] + weight * single) / (context[a] + weight)
            score += math.log10(single)
        return len(t), sum(c[w] > 0 for w in t), base, score

    for (key, text, held), row in zip(sorted(TEXTS, key=str), sorted(rows, key=lambda r: str((r[0], next(t for k, t, _ in TEXTS if k == r[0]), r[1])))):
        assert row["held_out"] == held and row["train_tokens"] == n
        tokens, known, base, score = expected(text)
        assert (row["n_tokens"], row["n_known"]) == (tokens, known)
        assert row["base_score"] == pytest.approx(base)
        assert row["score"] == pytest.approx(score, abs=2 * tokens * -LOWEST / STEPS)


def test_probabilities_sum_to_one():
    lower = L.Lower([{"tokens": 10, "words": 3, "ends": 2, "bins": np.array([0, 89]), "words_in": np.array([2, 1])}])
    count = {"a": 2, "b": 1, "c": 7}
    single = {w: (x + 1) / 14 for w, x in count.items()}
    assert sum(single.values()) + 1 / 14 == pytest.approx(1)
    t = lower.weight(np.array([4.0]))[0]
    pair = {"a": 3, "c": 1}
    total = sum((pair.get(w, 0) + t * p) / (4 + t) for w, p in single.items()) + t / 14 / (4 + t)
    assert total == pytest.approx(1)


def test_nothing_to_learn_from_and_no_rows(spark):
    rows = run(spark, [(1, "a b", True)]).collect()
    assert (rows[0]["base_score"], rows[0]["score"], rows[0]["n_known"], rows[0]["train_tokens"]) == (0.0, 0.0, 0, 0)
    assert run(spark, []).count() == 0


def test_trie_finds_what_it_holds_and_nothing_else():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 900):
        values = np.sort(rng.integers(0, 10**11, n)).astype(np.uint64)
        assert (Monotone.of(values).values() == values).all()
    keys = np.unique(rng.integers(0, 40, 600) * 1000 + rng.integers(0, 90, 600))
    v, w = (keys // 1000).astype(np.uint64), (keys % 1000).astype(np.uint64)
    p, back = -9 * rng.random(len(keys)), -rng.random(len(np.unique(v)))
    trie = Trie.build(v, w, p, back).mapped()
    asked_v, asked_w = np.repeat(np.arange(45, dtype=np.uint64), 95), np.tile(np.arange(95, dtype=np.uint64), 45)
    found, got, _ = trie.lookup(asked_v, asked_w)
    held = dict(zip(zip(v.tolist(), w.tolist()), p))
    for a, b, f, x in zip(asked_v.tolist(), asked_w.tolist(), found, got):
        assert f == ((a, b) in held)
        assert not f or x == pytest.approx(held[a, b], abs=-LOWEST / STEPS)


def test_a_very_long_text_and_clashing_names(spark):
    long = "one two three four " * 30_000
    df = spark.createDataFrame([(1, long, False, 0.0), (2, "one two", True, 0.0)], "doc_id long, text string, held boolean, score double")
    rows = {r["doc_id"]: r for r in L.score(df, F.col("held")).collect()}
    assert rows[1]["n_tokens"] == 120_001 and rows[2]["n_known"] == 3


def test_distinct_rows_with_small_and_large_numbers():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 4, 500) for _ in range(3)]
    small, large = L.distinct_rows(columns, [4, 4, 4]), L.distinct_rows(columns, [2**40] * 3)
    assert all((a == b).all() for a, b in zip(small, large)) and small[-1].sum() == 500
