"""Whitening of embeddings by principal components (operator 13).

Vectors become whole numbers ``floor(scale * c)``. Every distinct vector counts once: count, sums and
the covariance around the exact mean are taken per task and added up. The covariance, whose size
depends on the dimension only, is brought to tridiagonal form by Householder reflections; its leading
eigenvalues are bracketed by Sturm counts and bisection, their vectors found by inverse iteration,
made orthogonal within clusters of close eigenvalues, and reflected back. The few components go
to every task, which projects its rows.

Defined results: vectors that are null or hold null or non-finite entries, and those of another
length than most (ties: the shorter), take no part; repeated rows and ids give a row each, but
count once in the fit; a component without variance (an eigenvalue that rounding can't tell from
zero, as all are with a single distinct vector) has null in ``whitened`` and stays out of
``identity_error``; a ``deviation`` beyond the range of a long is null; an empty table gives an empty
result; other columns of the table, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed
from .common import query, table, workers_find_us

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- eigenvectors of a symmetric matrix ------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal and the unit vectors of the reflections that brought ``a`` there."""
    a = a.copy()
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        v = v / size if size > 0 else v
        mirrors.append(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = 2 * (p - (v @ p) * v)
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * (v @ x) * v
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def reflected(vectors: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    """Columns of the tridiagonal basis in the basis of the original matrix."""
    out = vectors.copy()
    n = len(out)
    for v in reversed(mirrors):
        tail = out[n - len(v) :]
        tail -= 2 * np.outer(v, v @ tail)
    return out


def sturm_count(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues are smaller than each of ``x``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    q = d[0] - x
    count = (q < 0).astype(int)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[i] - x - e[i - 1] ** 2 / q
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each to the last bits by bisection."""
    n = len(d)
    around = np.concatenate([[0], np.abs(e)]) + np.concatenate([np.abs(e), [0]])
    low, high = np.full(k, (d - around).min()), np.full(k, (d + around).max())
    spread = np.finfo(float).eps * max(np.abs(low[0]), np.abs(high[0])) * 4
    low, high = low - spread, high + spread
    rank = n - 1 - np.arange(k)  # so many eigenvalues lie below
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        below = sturm_count(d, e, middle) > rank
        high = np.where(below, middle, high)
        low = np.where(below, low, middle)
    return (low + high) / 2


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, floor: float) -> np.ndarray:
    """Solve the tridiagonal system minus ``shift`` by elimination with row exchanges."""
    n = len(d)
    diag, upper, second, x = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    lower = e.copy()
    for i in range(n - 1):
        if abs(lower[i]) > abs(diag[i]):
            diag[i], lower[i] = lower[i], diag[i]
            upper[i], diag[i + 1] = diag[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(diag[i]) < floor:
            diag[i] = floor
        f = lower[i] / diag[i]
        diag[i + 1] -= f * upper[i]
        upper[i + 1] -= f * second[i]
        x[i + 1] -= f * x[i]
    if abs(diag[-1]) < floor:
        diag[-1] = floor
    for i in range(n - 1, -1, -1):
        known = (upper[i] * x[i + 1] if i + 1 < n else 0.0) + (second[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = (x[i] - known) / diag[i]
        top = np.abs(x[i])
        if top > 1e150:  # only the direction counts
            x /= top
    return x


def vectors_of(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors as columns; those of close eigenvalues are kept orthogonal."""
    n, norm = len(d), max(np.abs(d).max(), np.abs(e).max(initial=0.0))
    if not norm:
        return np.eye(n)[:, : len(values)]
    floor = np.finfo(float).eps * norm
    rng = np.random.default_rng(7)
    found = np.zeros((n, len(values)))
    first = 0  # of the cluster
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:
            first = i
        x = rng.standard_normal(n)
        cluster = found[:, first:i]
        # equal shifts would find one vector again
        shift = value - 2 * floor * (i - first)
        for _ in range(rounds):
            x = solve_shifted(d, e, shift, x, floor)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= cluster @ (cluster.T @ x)
            x /= np.linalg.norm(x)
        found[:, i] = x
    return found


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their vectors as columns."""
    d, e, mirrors = tridiagonal(a)
    values = leading_values(d, e, k)
    return values, reflected(vectors_of(d, e, values), mirrors)


# --- the fit ----------------------------------------------------------------------------------------


@dataclass
class Whitener:
    """What projects a vector; its size depends on the dimension only."""

    n: int
    sums: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  #: as columns

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))

    def known(self) -> np.ndarray:
        """Components with variance beyond rounding."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = self.sums // self.n
        return (x - whole) - (self.sums - whole * self.n) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (self.centred(x) @ self.vectors) / np.sqrt(np.where(self.known(), self.values, np.nan))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of ``(n x - S)**2``, exact."""
        far = float(np.abs(self.centred(x)).max(initial=0.0)) * self.n + 1
        if far * far * x.shape[1] < 2.0**62 and np.abs(x).max(initial=0) * float(self.n) < 2.0**62:
            apart = self.n * x - self.sums
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums.tolist())) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Id and vector of whole numbers, of the rows whose vector is complete and finite."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.coalesce(fine, F.lit(False))).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * scale).cast("long")).alias("x")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, width)


def fit(rows: DataFrame, width: int, k: int) -> tuple[Whitener, DataFrame]:
    """Components of the distinct vectors ``x`` of ``rows``, and these vectors as a table."""
    distinct = checkpointed(rows.select("x").distinct())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, dtype=np.int64), 0
        for b in batches:
            x = _matrix(b.column(0), width)
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_pydict({"i": np.arange(width), "v": total, "n": np.full(width, n)})

    sums = distinct.mapInArrow(summed, "i long, v long, n long").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    got = sorted(tuple(r) for r in sums.collect())
    done = Whitener(got[0][2], np.array([v for _, v, _ in got], dtype=np.int64), np.zeros((width, width)), np.zeros(0), np.zeros((width, 0)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            c = done.centred(_matrix(b.column(0), width))
            total += c.T @ c
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "v": total[i, j]})

    parts = distinct.mapInArrow(products, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    for i, j, v in parts.collect():
        done.covariance[i, j] = done.covariance[j, i] = v / done.n
    done.values, done.vectors = leading(done.covariance, min(k, width))
    return done, distinct


def identity_error(done: Whitener, distinct: DataFrame) -> float | None:
    """Largest absolute entry of the covariance of the whitened distinct vectors minus the identity."""
    known = np.flatnonzero(done.known())
    if not len(known):
        return None
    names = [f"w{k}" for k in known]
    width = len(done.sums)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = done.whitened(_matrix(b.column(0), width))
            yield pa.RecordBatch.from_pydict({name: np.ascontiguousarray(w[:, k]) for name, k in zip(names, known)})

    w = distinct.mapInArrow(projected, ", ".join(f"{name} double" for name in names))
    mean = w.agg(*[F.avg(name).alias(name) for name in names]).first()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    spread = w.agg(*[(F.sum((F.col(a) - mean[a]) * (F.col(b) - mean[b])) / done.n - (1.0 if a == b else 0.0)) for a, b in pairs]).first()
    return float(max(abs(v) for v in spread))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """One row per complete vector and component, as described by ``SCHEMA``."""
    spark = df.sparkSession
    workers_find_us(spark)
    rows = whole_vectors(df, key, vector, scale)
    most = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if most is None or not most["width"]:
        return spark.createDataFrame([], SCHEMA)
    width = most["width"]
    rows = rows.where(F.size("x") == width)
    done, distinct = fit(rows, width, k)
    error = identity_error(done, distinct)
    count = len(done.values)
    share = [float(v) / done.trace if ok else 0.0 for v, ok in zip(done.values, done.known())]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), width)
            w = done.whitened(x)
            deviation = pa.array(done.deviation(x), pa.int64())
            for c in range(count):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.full(len(x), c + 1, dtype=np.int32)), deviation, pa.array(np.ascontiguousarray(w[:, c]), from_pandas=True), pa.array(np.full(len(x), share[c]))],
                    names=["vec_id", "component", "deviation", "whitened", "explained"],
                )

    out = rows.mapInArrow(projected, "vec_id long, component int, deviation long, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(done.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))


@query("op13_whitening")
def _(spark, folder):
    return whiten(table(spark, folder, "embeddings"))
