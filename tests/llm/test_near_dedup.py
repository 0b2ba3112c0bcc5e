"""Near duplicates against plain dynamic programming and planted copies."""

import random

import numpy as np
import pyarrow as pa

from tallyloom.llm import near_dedup as N
from tallyloom.llm.common import Words, shingle_hashes
from tallyloom.llm.near_dedup import aligned


def plain(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            kept = d[j + 1]
            d[j + 1] = before + 1 if x == y else max(d[j + 1], d[j])
            before = kept
    return d[-1]


def test_alignment_is_the_longest_common_subsequence():
    random.seed(4)
    for _ in range(1500):
        a = [random.randint(0, random.choice([3, 60])) for _ in range(random.randint(1, 40))]
        b = list(a)
        for _ in range(random.randint(0, 8)):
            if b and random.random() < 0.5:
                b.pop(random.randrange(len(b)))
            else:
                b.insert(random.randint(0, len(b)), random.randint(0, 60))
        want, longer = plain(a, b), max(len(a), len(b))
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert aligned(x, y, 0.0) == want
        got = aligned(x, y, 0.8)
        assert (got >= 0.8 * longer) == (want >= 0.8 * longer)
        assert want < 0.8 * longer or got == want


def text_of(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def edited(rng, words, places):
    out = list(words)
    for i in places:
        out[i] = "x" + rng.choice("abcdefgh") * 3
    return out


def brute(texts):
    """Class of every text by comparing all pairs."""
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    cut = []
    for t in texts:
        w = (t or "").lower().split()
        cut.append([tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))] if w else [])
    for i in range(len(texts)):
        for j in range(i):
            longer = max(len(cut[i]), len(cut[j]))
            if (texts[i] or "") == (texts[j] or "") or longer and plain(cut[i], cut[j]) >= 0.8 * longer - 1e-9:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def corpus():
    rng = random.Random(9)
    texts = [None, "", "", "one", "one", "One", "two words", " two  words "]
    passage = text_of(rng, 25)
    for _ in range(20):  # share a passage, else different
        texts.append(" ".join(text_of(rng, 60) + passage))
    base = text_of(rng, 120)
    texts += [" ".join(base)] * 3
    for k in range(14):  # near copies, from few edits to too many
        texts.append(" ".join(edited(rng, base, rng.sample(range(120), k))))
    other = text_of(rng, 90)
    texts += [" ".join(other), " ".join(other[45:] + other[:45]), " ".join(other[:80]), " ".join(other + other[:10])]
    texts += [" ".join(["again"] * 50), " ".join(["again"] * 55), "a b c d e f g h " * 40]
    return texts


def mixed_words(text):
    words = Words(pa.array([text]), lower=True)
    return words.hashes()[words.codes]


def classes(spark, texts, s=None):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    return {r["doc_id"]: r for r in N.classes(docs, s=s).collect()}


def test_classes_are_those_of_all_pairs(spark):
    texts = corpus()
    got, want = classes(spark, texts), brute(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert all(got[i]["class_size"] == want.count(want[i]) for i in got)


def test_large_buckets_in_blocks_and_finer_buckets_give_the_same(spark):
    texts = corpus()
    got = classes(spark, texts, N.Settings(large=3))
    assert [got[i]["class_id"] for i in range(len(texts))] == brute(texts)


def test_a_pair_that_shares_one_bucket_above_large_is_compared(spark):
    rng = random.Random(5)
    passage = text_of(rng, 40)
    texts = [" ".join(passage + text_of(rng, 20)) for _ in range(30)]
    other = passage + text_of(rng, 20)
    texts += [" ".join(other), " ".join(edited(rng, other, [59]))]
    s = N.Settings(sketches=1, length=1, large=3)
    held = [N.order_sketch(shingle_hashes(mixed_words(t), 5), s)[0] for t in texts]
    assert held[-1] == held[-2] and held.count(held[-1]) > s.large
    got = classes(spark, texts, s)
    assert [got[i]["class_id"] for i in range(32)] == [*range(31), 30]


def test_the_filter_on_minima_keeps_pairs_at_the_threshold():
    rng, s, least = np.random.default_rng(3), N.Settings(), N.MINIMA
    for _ in range(2000):
        a = rng.integers(1, 1 << 62, 100).astype(np.uint64)
        b = np.concatenate([a[20:], rng.integers(1, 1 << 62, 20).astype(np.uint64)])
        differing = int(np.bitwise_count((N.minima(a) ^ N.minima(b)).view(np.uint64)).sum())
        least = min(least, N.MINIMA - differing)
    assert s.agree <= least < 405


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = [(None, "same text"), (None, "same text"), (7, "another one"), (7, "another one"), (5, "another one"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in N.classes(docs).collect())
    assert got == [("5", "5", 3), ("7", "5", 3), ("7", "5", 3), ("None", "None", 1), ("None", "None", 2), ("None", "None", 2)]
    assert N.classes(docs.where("false")).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = text_of(rng, 60_000)
    texts = [" ".join(long), " ".join(edited(rng, long, range(0, 60_000, 100))), " ".join(reversed(long))]
    got = classes(spark, texts)
    assert [got[i]["class_id"] for i in range(3)] == [0, 0, 2]
