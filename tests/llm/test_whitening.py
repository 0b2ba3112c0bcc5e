"""Whitening against numpy's eigenvectors and exact sums."""

import math
import struct

import numpy as np
import pytest

from tallyloom.llm import whitening as H
from tallyloom.llm.common import QUERIES


def matrices():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 33, 120):
        a = rng.standard_normal((n, n))
        yield a @ a.T
        yield np.eye(n) * 3.0
        yield np.zeros((n, n))
        yield np.outer(np.arange(n) + 1.0, np.arange(n) + 1.0)
        q = np.linalg.qr(a)[0]
        yield (lambda m: (m + m.T) / 2)(q @ np.diag(np.where(np.arange(n) < n / 2, 7.0, 1e-9)) @ q.T)
        yield np.diag(np.arange(n) // 3 + 1.0) * 1e-30
        yield np.diag(1 + 1e-13 * np.arange(n))


@pytest.mark.parametrize("a", list(matrices()))
def test_leading_pairs_agree_with_numpy(a):
    k = min(4, len(a))
    values, vectors = H.leading(a, k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    size = max(abs(want[0]), 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * size
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() <= 1e-13


def test_sturm_counts_and_tridiagonal_form():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    d, e, mirrors = H.tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    q = H.reflected(np.eye(20), mirrors)
    assert np.abs(q @ t @ q.T - a).max() < 1e-12
    values = np.linalg.eigvalsh(a)
    x = np.linspace(-15, 15, 101)
    assert (H.sturm_count(d, e, x) == (values[:, None] < x).sum(axis=0)).all()


SCHEMA = "vec_id long, embedding array<float>, n int, x string, component string, i int"


def brute(rows, k=4):
    """Rows expected, from whole numbers in Python."""
    single = lambda c: struct.unpack("f", struct.pack("f", c))[0]
    good = [(i, [math.floor(256 * single(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(single(c)) for c in v)]
    width = max({len(x) for _, x in good}, key=lambda w: (sum(len(x) == w for _, x in good), -w))
    good = [(i, x) for i, x in good if len(x) == width]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    v = centred.T @ centred / n
    values, vectors = (m[..., ::-1][..., : min(k, width)] for m in np.linalg.eigh(v))
    out = {}
    for i, x in good:
        apart = [n * c - s for c, s in zip(x, sums)]
        for c in range(len(values)):
            whitened = float(np.array(apart) / n @ vectors[:, c] / np.sqrt(values[c])) if values[c] > 1e-9 else None
            out.setdefault((i, c + 1), []).append((n, sum(a * a for a in apart), whitened, values[c] / max(np.trace(v), 1e-300)))
    return out


def agree(rows, got):
    want = brute(rows)
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    sign = {}
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]][0]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["explained"] - explained) <= 1e-9
        if whitened is None:
            assert r["whitened"] is None
        elif abs(whitened) > 1e-6:
            assert sign.setdefault(r["component"], np.sign(r["whitened"] * whitened)) * whitened == pytest.approx(r["whitened"], abs=1e-9)
        assert r["identity_error"] is None or r["identity_error"] <= 1e-9
    assert len(got) == sum(map(len, want.values()))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows], SCHEMA)


def test_rows_against_exact_sums(spark):
    rng = np.random.default_rng(3)
    mixing = rng.standard_normal((9, 9)) * np.array([9, 6, 4, 3, 2, 1, 1, 1, 1])
    rows = [(i, [float(c) for c in rng.standard_normal(9) @ mixing]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(5, rows[5][1]), (None, rows[9][1])]  # a hot vector, repeated and null ids
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None), (2001, [nan] + [0.0] * 8), (2002, [inf] * 9), (2003, [None] + [1.0] * 8), (2004, [1.0, 2.0]), (2005, [])]
    agree([(i, v) for i, v in rows if i != 2004 and i != 2005], H.whiten(frame(spark, rows)).collect())


def test_one_vector_equal_axes_fewer_dimensions_and_no_rows(spark):
    agree([(1, [0.5, 0.25]), (2, [0.5, 0.25])], H.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect())
    corners = [(i, [float(i & 1), 0.0]) for i in range(4)]
    agree(corners, H.whiten(frame(spark, corners)).collect())
    square = [(i, [float(i & 1), float(i >> 1)]) for i in range(4)]  # equal eigenvalues: any axes do
    got = H.whiten(frame(spark, square)).collect()
    assert all(r["explained"] == pytest.approx(0.5) and r["identity_error"] < 1e-9 for r in got) and len(got) == 8
    for none in ([], [(1, None)], [(1, [])]):
        assert H.whiten(frame(spark, none)).collect() == []


def test_deviation_beyond_a_long_is_null():
    w = H.Whitener(2, np.array([2**40]), np.zeros((1, 1)), np.zeros(1), np.eye(1))
    assert w.deviation(np.array([[2**40]])) == [None]
    assert w.deviation(np.array([[2**39 + 5]])) == [100]


def test_query_on_the_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    agree(rows, QUERIES["op13_whitening"](spark, folder).collect())
