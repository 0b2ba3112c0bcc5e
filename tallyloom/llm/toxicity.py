"""Toxicity by non-negative positive-unlabelled learning (operator 2).

Confirmed toxic texts are the positives; a sample of all texts, taken without looking at labels,
is the unlabelled side. A linear model over hashed words minimises the class-prior-corrected risk
``prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))``: where the part in the maximum turns
negative the model has begun to fit single texts, and the step undoes that instead.

A text is the set of its words in lower case without outer punctuation and digits, hashed; the
label, language, source and id of a document never enter. Words that fewer than ``least_texts``
texts of the sample hold, or whose share of the positives differs from their share of the
unlabelled texts by less than ``least_z`` standard errors, carry no weight.

Defined results: an empty or null text scores like a text without any known word; without a
positive example or any text every score is the class prior (0 without labels); a document with
contradicting labels counts as toxic; rows without an id are scored and never learned from; whole
texts are read, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Words, crc_mod, query, sliced, table, workers_find_us

TRIM = bytes(c for c in range(128) if not chr(c).isalpha())


@dataclass
class Settings:
    bits: int = 18  #: 2**bits hashed words
    most_positives: int = 4000  #: bound of the sample of confirmed examples
    most_unlabelled: int = 8000  #: bound of the sample of other texts
    least_texts: int = 5
    least_z: float = 3.5
    epochs: int = 250
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 17


def word_sets(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed word) without repeats, in order of text."""
    words = Words(texts, lower=True)
    if not len(words.codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bare = [w.strip(TRIM) for w in words.dictionary.to_pylist()]
    bucket = np.fromiter((xxhash.xxh32_intdigest(w) & ((1 << bits) - 1) if w else -1 for w in bare), dtype=np.int64, count=len(bare))
    text = np.repeat(np.arange(len(words), dtype=np.int64), np.diff(words.offsets))
    found = bucket[words.codes]
    pairs = np.unique((text[found >= 0] << bits) | found[found >= 0])
    return pairs >> bits, pairs & ((1 << bits) - 1)


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


class _Sets:
    """Texts as rows of a sparse matrix of ones."""

    def __init__(self, rows: list[np.ndarray], size: int):
        self.n = len(rows)
        self.size = size
        self.words = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.text = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def scores(self, w, b):
        return np.bincount(self.text, weights=w[self.words], minlength=self.n) + b

    def back(self, g):
        return np.bincount(self.words, weights=g[self.text], minlength=self.size), g.sum()


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights over hashed words and intercept, by full-batch Adam on the non-negative risk."""
    size = 1 << s.bits
    base = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (-20.0 if prior <= 0 else 20.0)
    if not positives or not unlabelled or not 0 < prior < 1:
        return np.zeros(size, np.float32), base
    held = [np.bincount(np.concatenate(rows), minlength=size) for rows in (positives, unlabelled)]
    n = [len(positives), len(unlabelled)]
    share = (held[0] + held[1] + 1) / (n[0] + n[1] + 2)
    z = (held[0] / n[0] - held[1] / n[1]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
    known = np.flatnonzero((held[0] + held[1] >= s.least_texts) & (np.abs(z) >= s.least_z))
    place = np.full(size, -1)
    place[known] = np.arange(len(known))

    def narrow(rows):
        return _Sets([(p := place[r])[p >= 0] for r in rows], len(known))

    pos, unl = narrow(positives), narrow(unlabelled)
    w, b = np.zeros(len(known)), base
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for t in range(1, s.epochs + 1):
        zp, zu = pos.scores(w, b), unl.scores(w, b)
        # logistic loss; d/dz log(1+e^-z) = -sigmoid(-z), d/dz log(1+e^z) = sigmoid(z)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gu = _sigmoid(zu) / unl.n
        gp_minus = prior * _sigmoid(zp) / pos.n
        if negative >= 0:
            gp, gu = -prior * _sigmoid(-zp) / pos.n - gp_minus, gu
        else:
            gp, gu = gp_minus, -gu
        (wp, bp), (wu, bu) = pos.back(gp), unl.back(gu)
        g = np.append(wp + wu, bp + bu)
        g[:-1] += s.decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    weights = np.zeros(size, np.float32)
    weights[known] = w
    return weights, float(b)


def sampled_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, s: Settings) -> list[np.ndarray]:
    """Word sets of the documents whose id is in ``ids`` (bounded by the settings), without a null id."""
    bits = s.bits

    @sliced
    def sets_of(texts: pa.Array) -> pa.Array:
        owner, found = word_sets(texts, bits)
        at = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(found.astype(np.int32)))

    @F.arrow_udf("array<int>")
    def sets(texts: pa.Array) -> pa.Array:
        return sets_of(texts)

    chosen = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id", "left_semi")
    chosen = chosen.groupBy("id").agg(F.min("text").alias("text"))  # an id counts once, however many rows it has
    got = chosen.select(sets("text").alias("set")).toArrow().column("set")
    return [np.asarray(x.values, dtype=np.int64) for x in got if x.is_valid]


def train(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "toxic", s: Settings | None = None):
    """Fit on the documents for which ``learn(key)`` holds; labels of all others are never read."""
    s = s or Settings()
    workers_find_us(docs.sparkSession)
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & learn(key))
        .groupBy(F.col(key).alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    total = known.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    prior = (total["p"] or 0) / total["n"] if total["n"] else 0.0

    def some(ids: DataFrame, n: int) -> DataFrame:
        return ids.distinct().orderBy(F.xxhash64("id", F.lit(s.seed)), "id").limit(n)

    toxic = some(known.where("y = 1").select("id"), s.most_positives)
    anyone = some(docs.where(F.col(key).isNotNull() & learn(key)).select(F.col(key).alias("id")), s.most_unlabelled)
    return fit(sampled_sets(docs, toxic, key, text, s), sampled_sets(docs, anyone, key, text, s), prior, s), prior


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score", bits: int = Settings.bits) -> DataFrame:
    """Add the probability that a text is toxic; the model's size is fixed by ``bits``."""
    workers_find_us(docs.sparkSession)
    shared, b = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    @sliced
    def scores_of(texts: pa.Array) -> pa.Array:
        owner, found = word_sets(texts, bits)
        z = np.bincount(owner, weights=shared.value[found], minlength=len(texts)) + b
        return pa.array(_sigmoid(z))

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return scores_of(texts)

    return docs.withColumn(out, scores(F.col(text)))


@query("op2_nnpu")
def _(spark, folder):
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    model, _ = train(docs, labels, lambda key: crc_mod(key, 3) != 1)
    return score(docs, model).select(
        "doc_id",
        (crc_mod("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
