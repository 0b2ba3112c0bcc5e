"""Approximate nearest neighbours by multi-index hashing (operator 10).

Vectors become binary codes: centred, rotated and cut at zero, where the rotation is learned on a
bounded sample so that the codes lose little (iterative quantisation). Codes are cut into
substrings and every substring is indexed by its value. Two codes within Hamming distance ``r``
agree in some of the ``m`` substrings up to ``r // m`` bits (pigeonhole), so probing the values
within that many bits of the query's substrings finds every code within ``r``; found codes are
compared in full, and those within ``r`` are reranked by the inner product of the original
vectors in double precision.

Largest inner product is turned into nearest angle by one more coordinate that lifts all vectors
to the same length. The radius is the one within which, on the sample, all but ``miss`` of the true
neighbours lie. Whoever finds fewer than ``k`` within it searches on with a larger radius, up to
all codes, so a query with few or far neighbours still gets its ``k``.

Index rows are dealt into shards by hash, queries into blocks; a block meets a shard in one task,
whose size does not grow with the table, and the few best of each shard are merged.

Defined results: vectors that are null, zero, of another length than most or that hold null or non-finite components
take no part; equal ids are compared as rows (a query never meets rows of its own id); ties go to
the smaller id; fewer than ``k`` candidates give all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import query, table, workers_find_us


@dataclass
class Settings:
    k: int = 20
    bits: int = 64
    substrings: int = 8  #: of eight bits each
    sample: int = 4000  #: bound of the sample rotation and radius are learned on
    rounds: int = 30
    miss: float = 0.01
    shard_rows: int = 16384
    block_rows: int = 1024
    seed: int = 3


@dataclass
class Coder:
    """What turns vectors into codes; its size depends on the dimension only."""

    longest: float
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (x * x).sum(axis=1), 0)
        return np.column_stack([x, np.sqrt(rest)]) / self.longest

    def query(self, x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.column_stack([x / np.where(norm > 0, norm, 1), np.zeros(len(x))])

    def code(self, lifted: np.ndarray) -> np.ndarray:
        """Rows of bytes, one per substring."""
        return np.packbits((lifted - self.mean) @ self.rotation > 0, axis=1)


POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
#: the byte values within d bits of value v are NEAR[d][v]
NEAR = [[np.flatnonzero(POPCOUNT[np.arange(256) ^ v] <= d) for v in range(256)] for d in range(9)]


def learn(x: np.ndarray, longest: float, s: Settings) -> Coder:
    """Rotation by iterative quantisation and the radius, from a sample of vectors."""
    rng = np.random.default_rng(s.seed)
    coder = Coder(longest, np.zeros(x.shape[1] + 1), np.zeros((x.shape[1] + 1, s.bits)), s.bits)
    lifted = coder.lift(x)
    coder.mean = lifted.mean(axis=0)
    centred = lifted - coder.mean
    dim = centred.shape[1]
    # principal axes; where there are fewer than bits, random directions fill up
    axes = np.linalg.eigh(centred.T @ centred / len(x))[1][:, ::-1][:, : s.bits]
    if dim < s.bits:
        axes = np.column_stack([axes, rng.standard_normal((dim, s.bits - dim)) / np.sqrt(dim)])
    flat = centred @ axes
    rotation = np.linalg.qr(rng.standard_normal((s.bits, s.bits)))[0]
    for _ in range(s.rounds):
        u, _, v = np.linalg.svd(np.sign(flat @ rotation).T @ flat)
        rotation = (u @ v).T
    coder.rotation = axes @ rotation
    # how far the true neighbours of some rows of the sample lie, at the rank k has in all rows
    codes = coder.code(lifted)
    asked = np.arange(min(len(x), 400))
    scores = x[asked] @ x.T
    scores[asked, asked] = -np.inf
    k = min(s.k, len(x) - 1)
    if k < 1:
        return coder
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    query_codes = coder.code(coder.query(x[asked]))
    far = POPCOUNT[query_codes[:, None, :] ^ codes[best]].sum(axis=2)
    coder.radius = int(np.quantile(far, 1 - s.miss, method="higher"))
    return coder


def inner_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums in order of the components, so that equal vectors score equal wherever they stand."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * q[d]
    return out


class Index:
    """Rows of one shard, posted under the value of each substring of their code."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, coder: Coder):
        self.ids, self.x, self.codes = ids, x, coder.code(coder.lift(x))
        self.order = [np.argsort(self.codes[:, m], kind="stable") for m in range(self.codes.shape[1])]
        self.begin = [np.searchsorted(self.codes[o, m], np.arange(257)) for m, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within ``radius`` bits."""
        m = len(code)
        seen = np.zeros(len(self.ids), dtype=bool)
        # the first substrings need radius // m bits, the others one less (pigeonhole)
        for i in range(m):
            reach = min(radius // m - (i > radius % m), 8)
            if reach < 0:
                continue
            begin, order = self.begin[i], self.order[i]
            for v in NEAR[reach][code[i]]:
                seen[order[begin[v] : begin[v + 1]]] = True
        found = np.flatnonzero(seen)
        return found[POPCOUNT[self.codes[found] ^ code].sum(axis=1) <= radius]

    def nearest(self, key, q: np.ndarray, code: np.ndarray, radius: int, k: int):
        bits = 8 * len(code)
        while True:
            found = self.within(code, radius)
            found = found[self.ids[found] != key]
            if len(found) >= k or radius >= bits:
                break
            radius = min(bits, radius + len(code))
        rough = self.x[found] @ q
        if len(found) > k:
            edge = np.partition(rough, len(rough) - k)[len(rough) - k]
            found = found[rough >= edge - 1e-9 * max(1.0, np.abs(rough).max())]
        score = inner_products(self.x[found], q)
        best = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found[best]], score[best]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Id and vector as doubles, of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    whole = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(whole, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def search(df: DataFrame, asked, key: str = "vec_id", vector: str = "embedding", s: Settings | None = None) -> DataFrame:
    """The ``k`` nearest found of every row for which ``asked(column)`` holds, against all rows."""
    s = s or Settings()
    spark = df.sparkSession
    workers_find_us(spark)
    out = "query_id long, vec_id long, score double"
    rows = usable(df, key, vector)
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square"))
    most = size.orderBy(F.desc("n"), "d").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == most["d"])
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(s.seed)), "vec_id").limit(s.sample).toArrow()
    coder = learn(np.asarray(sample.column("v").combine_chunks().values).reshape(-1, most["d"]), float(np.sqrt(most["square"])), s)

    shards = max(1, -(-most["n"] // s.shard_rows))
    queries = rows.where(asked(F.col("vec_id")))
    blocks = max(1, -(-most["n"] // (20 * s.block_rows)))
    # a shard of rows meets a block of queries under the key (shard, block)
    index = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int"))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    posed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int"))
    posed = posed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        held = Index(right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy()), coder)
        q = np.stack(left["v"].to_numpy())
        codes = coder.code(coder.query(q))
        found = [held.nearest(i, x, c, coder.radius, s.k) for i, x, c in zip(left["vec_id"].to_numpy(), q, codes)]
        return pd.DataFrame(
            {
                "query_id": np.repeat(left["vec_id"].to_numpy(), [len(i) for i, _ in found]),
                "vec_id": np.concatenate([i for i, _ in found]),
                "score": np.concatenate([x for _, x in found]),
            }
        )

    best = posed.groupBy("shard", "block").cogroup(index.groupBy("shard", "block")).applyInPandas(meet, out)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= s.k)
        .select("query_id", "rank", "vec_id", "score")
    )


@query("op10_multi_index")
def _(spark, folder):
    return search(table(spark, folder, "embeddings"), lambda i: i % 20 == 0)
