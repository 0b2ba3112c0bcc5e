"""Quality rules by robust multivariate outliers (operator 4).

Every text gives counts (words, symbols, repeated lines, repeated eight-word windows). A base rule
rejects texts that are too short or repeat too much. Of the others, transformed statistics are
compared with those of the same language and source: minimum-covariance-determinant estimates of
location and scatter, and rejection by Mahalanobis distance.

The estimates are found by concentration steps over all rows. A step takes the distances of all
rows of a group, finds the distance below which ``share`` of them lie from counts per narrow bin,
and takes mean and covariance of the rows below. Two starts (median and scaled deviations;
coordinatewise middle half) run side by side, and each group keeps the one with the smaller
determinant. Only counts and moments per group are shuffled, both combined before the shuffle, so
the size of a group does not matter. The steps read a checkpointed table of four numbers per
document.

Defined results: a null text has no words and fails the base rule; a null language or source is a
value of its own; a language and source with fewer than ``least`` rows is judged with all such of
its language, those with all such rows of the table, and where even these are fewer than
``least`` by the estimate of all rows of the table; only a table with fewer than ``least`` rows to judge
rejects nobody; a text of any length counts as one row; repeated rows are judged alike; ids are only carried along.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed
from .common import Words, expand, mix, query, shingle_hashes, sliced, table, workers_find_us

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VECTOR = ["x0", "x1", "x2", "x3"]
P = len(VECTOR)
#: The spread that is always granted, in transformed units: most clean texts have no symbol and no
#: repeated line at all, and without it one of either would be infinitely far away. One symbol in a
#: hundred characters is 0.1, one line of six that stands twice is 0.42.
FLOOR = [0.08, 0.05, 0.20, 0.20]
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BINS_PER_E = 200  #: bins of distance: this many for every factor of e


@dataclass
class Settings:
    least_words: int = 20
    most_repeated: int = 30  #: percent
    share: float = 0.75
    steps: int = 5
    least: int = 60
    level: float = 0.99995  #: of the chi-square distribution of the distances


def repeated_words(words: Words, window: int) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    n = len(words)
    if len(words.codes) < window:
        return np.zeros(n, np.int64)
    hashes = words.hashes()[words.codes]
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(words.offsets))
    all_windows = shingle_hashes(hashes, window)
    whole = text[: len(all_windows)] == text[window - 1 :]
    at = np.flatnonzero(whole)
    keys = mix(all_windows[at] ^ mix(text[at].astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    twice = np.zeros(len(keys), dtype=bool)
    twice[1:] = ordered[1:] == ordered[:-1]
    twice[:-1] |= twice[1:]
    found = at[order[twice]]
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(change, found, 1)
    np.add.at(change, found + window, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(text[covered], minlength=n)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def counted(df: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """Add the counts of ``COUNTS`` and ``n_lines``; columns of these names give way."""
    workers_find_us(df.sparkSession)
    names = [*COUNTS, "n_lines"]

    @sliced
    def count_texts(texts: pa.Array) -> pa.Array:
        words = Words(texts)
        n = len(words)
        # bytes that begin a code point, inside words only
        first = np.zeros(len(words.raw) + 1, dtype=np.int64)
        np.cumsum((words.raw & 0xC0) != 0x80, out=first[1:])
        marked = np.zeros(len(words.raw) + 1, dtype=np.int64)
        np.cumsum(SYMBOLS[words.raw], out=marked[1:])

        def per_text(total):
            each = np.zeros(len(words.starts) + 1, dtype=np.int64)
            np.cumsum(total[words.ends] - total[words.starts], out=each[1:])
            return each[words.offsets[1:]] - each[words.offsets[:-1]]

        values = [t.as_py() or "" for t in texts]
        columns = [
            np.diff(words.offsets),
            per_text(first),
            per_text(marked),
            np.fromiter((repeated_lines(v) for v in values), dtype=np.int64, count=n),
            repeated_words(words, window),
            np.fromiter((v.count("\n") + 1 for v in values), dtype=np.int64, count=n),
        ]
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    @F.arrow_udf("struct<" + ",".join(f"{n}:long" for n in names) + ">")
    def count(texts: pa.Array) -> pa.Array:
        return count_texts(texts)

    return expand(df.withColumn("__counts", count(F.col(text))), "__counts", names)


def base_failed(s: Settings) -> Column:
    return (F.col("n_words") < s.least_words) | (100 * F.col("n_repeat_words") > s.most_repeated * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics: mean word length, and shares on the arcsine scale."""
    words, chars, lines = (F.greatest(c, F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))

    def arcsine(share: Column) -> Column:
        return F.asin(F.sqrt(F.least(share, F.lit(1.0))))

    return [
        F.log(chars / words),
        arcsine(F.col("n_symbols") / chars),
        arcsine(F.col("n_dup_lines") / lines),
        arcsine(F.col("n_repeat_words") / words),
    ]


def chi2(x: float, k: int) -> float:
    """Distribution function of chi-square with ``k`` degrees of freedom."""
    tail, at = (math.erfc(math.sqrt(x / 2)), 1) if k % 2 else (math.exp(-x / 2), 2)
    while at < k:
        tail += (x / 2) ** (at / 2) * math.exp(-x / 2) / math.gamma(at / 2 + 1)
        at += 2
    return 1 - tail


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2(middle, k) < q else (low, middle)
    return high


def _estimates(moments: DataFrame, share: float) -> DataFrame:
    """Location, inverse scatter and log determinant from the moments of each group and start."""
    floor = np.diag(np.square(FLOOR))
    grow = share / chi2(chi2_quantile(share, P), P + 2)  # the inner rows spread less than all
    upper = [(i, j) for i in range(P) for j in range(i, P)]

    def estimate(frames):
        for f in frames:
            out = {"mean": [], "inverse": [], "logdet": []}
            for row in f.itertuples(index=False):
                mean = np.array(row.sums) / row.n
                scatter = np.zeros((P, P))
                for (i, j), x in zip(upper, row.crossed):
                    scatter[i, j] = scatter[j, i] = x / row.n - mean[i] * mean[j]
                scatter = grow * scatter + floor
                out["mean"].append(mean.tolist())
                out["inverse"].append(np.linalg.inv(scatter).ravel().tolist())
                out["logdet"].append(float(np.linalg.slogdet(scatter)[1]))
            yield pd.DataFrame({"grp": f["grp"], "start": f["start"], **out})

    return moments.mapInPandas(estimate, "grp string, start int, mean array<double>, inverse array<double>, logdet double")


def _distance() -> Column:
    """Squared Mahalanobis distance; a few roundings below zero count as zero."""
    d = [F.col(v) - F.col("mean")[i] for i, v in enumerate(VECTOR)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(P):
            total = total + d[i] * d[j] * F.col("inverse")[i * P + j]
    return F.greatest(total, F.lit(0.0))


def _bin(value: Column) -> Column:
    return F.floor(F.log(value + 1e-6) * BINS_PER_E).cast("int")


def _limits(bins: DataFrame, shares: dict[str, float], keys: list[str]) -> DataFrame:
    """For each name the first bin at which that share of a group's rows is reached.

    ``bins`` has few rows per group: one per bin that occurs.
    """
    from pyspark.sql import Window as W

    along = W.partitionBy(*keys).orderBy("bin")
    placed = bins.groupBy(*keys, "bin").agg(F.count("*").alias("n")).select(
        *keys, "bin", F.sum("n").over(along).alias("upto"), F.sum("n").over(W.partitionBy(*keys)).alias("total")
    )
    return placed.groupBy(*keys).agg(
        *[F.min(F.when(F.col("upto") >= F.ceil(s * F.col("total")), F.col("bin"))).alias(n) for n, s in shares.items()]
    )


def _moments(rows: DataFrame) -> DataFrame:
    x = [F.col(v) for v in VECTOR]
    crossed = [x[i] * x[j] for i in range(P) for j in range(i, P)]
    return rows.groupBy("grp", "start").agg(
        F.count("*").cast("double").alias("n"),
        F.array(*[F.sum(c) for c in x]).alias("sums"),
        F.array(*[F.sum(c) for c in crossed]).alias("crossed"),
    )


def estimates(rows: DataFrame, s: Settings) -> DataFrame:
    """The minimum-covariance-determinant estimate of every group in ``rows`` (grp, x0 ... x3)."""
    # first start: rows in the middle half of every coordinate; second: rows near the medians
    unit = 500
    long = rows.select("grp", F.posexplode(F.array(*VECTOR)).alias("axis", "x")).withColumn("bin", F.floor(F.col("x") * unit).cast("int"))
    quartiles = checkpointed(_limits(long, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["grp", "axis"]))
    shape = quartiles.groupBy("grp").agg(
        *[
            F.map_from_entries(F.collect_list(F.struct("axis", (F.col(q) + 0.5) / unit))).alias(q)
            for q in ("q1", "q2", "q3")
        ]
    )
    started = rows.join(shape, "grp")
    inner = F.lit(True)
    far = F.lit(0.0)
    for i, v in enumerate(VECTOR):
        q1, q2, q3 = (F.col(q)[i] for q in ("q1", "q2", "q3"))
        inner = inner & (F.col(v) >= q1 - FLOOR[i]) & (F.col(v) <= q3 + FLOOR[i])
        far = far + F.pow((F.col(v) - q2) / ((q3 - q1) / 1.349 + FLOOR[i]), F.lit(2))
    near = far <= chi2_quantile(0.5, P)
    both = started.select("grp", *VECTOR, F.explode(F.array(F.when(inner, F.lit(0)), F.when(near, F.lit(1)))).alias("start"))
    found = checkpointed(_estimates(_moments(both.where("start IS NOT NULL")), s.share))
    for _ in range(s.steps):
        placed = rows.join(found, "grp").withColumn("bin", _bin(_distance()))
        limit = _limits(placed, {"most": s.share}, ["grp", "start"])
        inside = placed.join(limit, ["grp", "start"]).where(F.col("bin") <= F.col("most"))
        found = checkpointed(_estimates(_moments(inside), s.share))
    return found.groupBy("grp").agg(F.min_by(F.struct("mean", "inverse", "logdet", "start"), F.struct("logdet", "start")).alias("e")).select("grp", "e.*")


#: the group of rows whose own groups and pools are too small: judged by the estimate of all rows
EVERY = "**"


def grouped(df: DataFrame, lang: str, source: str, s: Settings) -> DataFrame:
    """Add ``grp``: language and source, or the pool that takes the place of a rare one."""

    def plain(c):
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("?"))

    keyed = df.withColumn("__lang", plain(lang)).withColumn("__both", F.concat_ws("\t", plain(lang), plain(source)))
    sizes = keyed.where(~F.col("base_failed")).groupBy("__lang", "__both").agg(F.count("*").alias("n"))
    small = F.coalesce(F.sum(F.when(F.col("n") < s.least, F.col("n"))), F.lit(0))
    by_lang = sizes.groupBy("__lang").agg(small.alias("pool"), F.sum("n").alias("open"))
    every = F.coalesce(F.sum("open"), F.lit(0)).alias("every")
    of_pools = by_lang.agg(F.coalesce(F.sum(F.when(F.col("pool") < s.least, F.col("pool"))), F.lit(0)).alias("rest"), every)
    chosen = sizes.join(by_lang, "__lang").crossJoin(F.broadcast(of_pools)).select(
        "__both",
        F.when(F.col("n") >= s.least, F.col("__both"))
        .when(F.col("pool") >= s.least, F.col("__lang"))
        .when(F.col("rest") >= s.least, F.lit("*"))
        .when(F.col("every") >= s.least, F.lit(EVERY))
        .alias("grp"),
    )
    return keyed.join(chosen, "__both", "left").drop("__lang", "__both")


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", s: Settings | None = None) -> DataFrame:
    """Counts, ``base_failed``, ``distance`` (squared) and ``kept`` of every row of ``df``."""
    s = s or Settings()
    narrow = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    rows = counted(narrow).drop("text").withColumn("base_failed", base_failed(s))
    rows = rows.select("*", *[c.alias(v) for c, v in zip(vector(), VECTOR)])
    rows = checkpointed(grouped(checkpointed(rows), "lang", "source", s))
    fit_rows = rows.where(~F.col("base_failed") & F.col("grp").isNotNull()).select("grp", *VECTOR)
    open_rows = fit_rows.where(F.col("grp") != EVERY)
    if not fit_rows.where(F.col("grp") == EVERY).isEmpty():
        open_rows = open_rows.unionByName(fit_rows.withColumn("grp", F.lit(EVERY)))
    found = estimates(open_rows, s)
    placed = rows.join(found, "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    fits = F.coalesce(F.col("distance") <= chi2_quantile(s.level, P), F.lit(True))
    return placed.withColumn("kept", ~F.col("base_failed") & fits)


@query("op4_robust_outliers")
def _(spark, folder):
    judged = judge(table(spark, folder, "documents"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "distance")
