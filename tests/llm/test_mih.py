"""Multi-index hashing against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import mih as H


def nearest(ids, x, k, asked):
    """(query, rank, id, score) by comparing everything."""
    out = []
    for q in np.flatnonzero(asked):
        score = x @ x[q]
        keep = np.flatnonzero(ids != ids[q])
        best = keep[np.lexsort((ids[keep], -np.round(score[keep], 12)))][:k]
        out += [(int(ids[q]), r + 1, int(ids[j]), score[j]) for r, j in enumerate(best)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 24))
    coder = H.learn(x, float(np.linalg.norm(x, axis=1).max()), H.Settings())
    index = H.Index(np.arange(700), x, coder)
    for q in range(0, 700, 90):
        code = coder.code(coder.query(x[q : q + 1]))[0]
        far = H.POPCOUNT[index.codes ^ code].sum(axis=1)
        for radius in (0, 3, 8, 13, 21, 64):
            assert (index.within(code, radius) == np.flatnonzero(far <= radius)).all()


def test_recall_and_exact_scores_on_vectors_of_any_length(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 32))
    x = (centres[rng.integers(0, 12, 1500)] + 0.7 * rng.standard_normal((1500, 32))) * rng.uniform(0.5, 2, (1500, 1))
    x = x.astype(np.float32).astype(float)
    ids = np.arange(1500)
    df = vectors(spark, [(int(i), list(map(float, v)), "old") for i, v in zip(ids, x)])
    rows = H.search(df, lambda i: i % 20 == 0, s=H.Settings(shard_rows=400, block_rows=30)).collect()
    want = nearest(ids, x, 20, ids % 20 == 0)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in rows}
    assert len(rows) == len(want)
    assert np.mean([(q, i) in got for q, _, i, _ in want]) >= 0.95
    assert all(abs(got[q, i] - s) < 1e-9 for q, _, i, s in want if (q, i) in got)


def test_ties_bad_vectors_few_candidates_and_no_rows(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(0, same, ""), (9, same, ""), (4, same, ""), (5, [0.5, 0.5, 0.0], ""), (6, [0.0, 0.0, 0.0], ""), (7, None, ""), (8, [1.0, None, 0.0], ""),
            (10, [float("nan"), 1.0, 0.0], ""), (11, [float("inf"), 1.0, 0.0], ""), (12, [1.0], ""), (None, same, ""), (20, [-1.0, 0.0, 0.0], "")]
    got = [tuple(r) for r in H.search(vectors(spark, rows), lambda i: i % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [
        (0, 1, 4, 1.0), (0, 2, 9, 1.0), (0, 3, 5, 0.5), (0, 4, 20, -1.0),
        (20, 1, 5, -0.5), (20, 2, 0, -1.0), (20, 3, 4, -1.0), (20, 4, 9, -1.0),
    ]
    assert H.search(vectors(spark, []), lambda i: i % 20 == 0).count() == 0


def test_repeated_ids_are_never_their_own_neighbours(spark):
    rows = [(0, [1.0, 0.0], ""), (0, [0.0, 1.0], ""), (1, [1.0, 1.0], "")]
    got = H.search(vectors(spark, rows), lambda i: F.lit(True) & (i == 0)).collect()
    assert {r["vec_id"] for r in got} == {1}
