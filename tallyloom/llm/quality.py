"""Quality classifier from weak labels (operator 3).

Overlapping heuristic labellers vote good, bad or abstain on every text. The votes of all
documents are counted per pattern of votes, and expectation-maximisation over those counts
estimates each labeller's accuracy on good and on bad text together with the share of good text.
The posteriors of a bounded sample of documents then train a linear scorer over hashed word
shapes, which judges every document: it also sees what no labeller looks at, and is smooth where
they abstain.

Defined results: an empty or null text has no votes, its posterior is the prior, and it is
rejected (``score`` 0); a short text on which labellers abstain is judged by its shapes; an empty
table gives an empty result; ids are only carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, expand, give_back, mix, query, shingle_hashes, sliced, table, workers_find_us
from .toxicity import _sigmoid

#: Every kind of defect is looked for by two labellers or more: only where they overlap can their
#: accuracies be told apart.
LABELLERS = ("symbols", "letters", "capitals", "shouting", "separators", "single", "repeats", "stutter", "variety", "word_length")
GOOD, BAD, ABSTAIN = 1, 0, 2
SHORT = 20


@dataclass
class Settings:
    bits: int = 16  #: 2**bits hashed shapes
    sample: int = 12000  #: bound of the sample the scorer is fitted on
    epochs: int = 300
    rate: float = 0.05
    decay: float = 1e-5
    slice_bytes: int = 1 << 20  #: text that is worked on at once
    keep: float = 0.4  #: a score below this rejects the document; doubtful ones stay
    seed: int = 5


def _per_word(flag: np.ndarray, words: Words) -> np.ndarray:
    """Number of flagged bytes in each word."""
    total = np.zeros(len(flag) + 1, dtype=np.int64)
    np.cumsum(flag, out=total[1:])
    return total[words.ends] - total[words.starts]


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 32))


def segment_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hash of every stretch ``data[offsets[i]:offsets[i + 1]]`` of bytes: a polynomial, mixed."""
    size = np.diff(offsets)
    powers = np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    each = _BYTE[data] * powers[np.arange(len(data)) - np.repeat(offsets[:-1], size)]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(each, out=total[1:])
    return mix((total[offsets[1:]] - total[offsets[:-1]]) ^ mix(size.astype(np.uint64)))


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the dictionary of distinct words, back to back, and where each begins."""
    d = words.dictionary
    offsets = np.frombuffer(d.buffers()[1], dtype=np.int64)[d.offset : d.offset + len(d) + 1]
    return np.frombuffer(d.buffers()[2], dtype=np.uint8), offsets


def _in_set(chars: bytes) -> np.ndarray:
    table_ = np.zeros(256, dtype=bool)
    table_[list(chars)] = True
    return table_


SYMBOL, SHOUT, BAR = _in_set(b"#*$%&<>{}~^=@\\"), _in_set(b"!?"), _in_set(b"|")
UPPER, LETTER = _in_set(bytes(range(65, 91))), _in_set(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def votes(words: Words) -> np.ndarray:
    """One row per text, one column per labeller."""
    n = len(words)
    bounds = words.offsets

    def per_text(each: np.ndarray) -> np.ndarray:
        total = np.zeros(len(each) + 1, dtype=np.int64)
        np.cumsum(each, out=total[1:])
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    raw = words.raw
    count = np.diff(bounds).astype(float)
    some = np.maximum(count, 1)
    size = per_text(words.ends - words.starts)
    letters = per_text(_per_word(LETTER[raw], words))
    upper = per_text(_per_word(UPPER[raw], words))
    symbols = per_text(_per_word(SYMBOL[raw], words) > 0)
    shouted = per_text(_per_word(SHOUT[raw], words) > 0)
    bars = per_text(_per_word(BAR[raw], words) > 0)
    single = per_text(words.ends - words.starts == 1)
    text = np.repeat(np.arange(n), np.diff(bounds))
    again = np.flatnonzero((words.codes[1:] == words.codes[:-1]) & (text[1:] == text[:-1]))
    stutter = np.bincount(text[again], minlength=n)
    variety = np.bincount(np.unique(text * np.int64(len(words.dictionary) + 1) + words.codes) // (len(words.dictionary) + 1), minlength=n)

    # words inside windows of six that an earlier window of the same text equals
    repeated = np.zeros(n)
    hashes = segment_hashes(*distinct_words(words))[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    windows = shingle_hashes(hashes, 6)
    if len(windows):
        inside = text[: len(windows)] == text[len(hashes) - len(windows) :]
        owner = text[: len(windows)][inside]
        owner_windows = np.maximum(np.diff(bounds) - 5, 0)
        keys = mix(windows[inside] ^ mix(owner.astype(np.uint64)))
        order = np.argsort(keys)
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = keys[order][1:] != keys[order][:-1]
        distinct = np.bincount(owner[order][fresh], minlength=n)
        repeated = np.where(owner_windows > 0, 1 - distinct / np.maximum(owner_windows, 1), 0)

    def vote(bad, good, known):
        return np.where(known & bad, BAD, np.where(known & good, GOOD, ABSTAIN))

    word_length = size / some
    share = letters / np.maximum(size, 1)
    some_text = count >= 8
    vocabulary = np.minimum(count, 4000)  # a longer text brings few new words
    return np.stack(
        [
            vote(symbols > 0.3 * count, symbols < 0.1 * count, some_text),
            vote(share < 0.8, share > 0.9, some_text),
            vote(upper > 0.5 * letters, upper < 0.2 * letters, some_text & (letters > 0)),
            vote(shouted > 0.3 * count, shouted < 0.1 * count, some_text),
            vote(bars > 0.2 * count, bars < 0.05 * count, some_text),
            vote(single > 0.3 * count, single < 0.15 * count, some_text),
            vote(repeated > 0.3, repeated < 0.05, count >= 40),
            vote(stutter > 0.3 * count, stutter < 0.05 * count, some_text),
            vote(variety < 0.15 * vocabulary, variety > 0.25 * vocabulary, count >= 40),
            vote((word_length < 2.5) | (word_length > 12), (word_length > 3.5) & (word_length < 9), some_text),
        ],
        axis=1,
    ).astype(np.int64)


def encode_votes(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)


def decode_votes(pattern: np.ndarray, n: int = len(LABELLERS)) -> np.ndarray:
    return (np.asarray(pattern)[:, None] // 3 ** np.arange(n)) % 3


def accuracies(pattern: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good per pattern, each labeller's accuracy on (bad, good) text, share of good.

    The labellers look for defects, so expectation-maximisation starts from texts nobody finds a
    defect in as good; abstaining says nothing. Counts of one vote on either side keep a labeller
    that never errs away from certainty.
    """
    v = decode_votes(pattern)
    n = count.astype(float)
    said = v != ABSTAIN
    good = np.where(said.any(axis=1), 0.999 * 0.1 ** (v == BAD).sum(axis=1), 0.5)
    for _ in range(rounds):
        prior = (n * good).sum() / max(n.sum(), 1)
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        right = np.zeros((2, v.shape[1]))
        for c, weight in ((BAD, n * (1 - good)), (GOOD, n * good)):
            right[c] = ((weight[:, None] * (v == c)).sum(axis=0) + 2) / ((weight[:, None] * said).sum(axis=0) + 3)
        like_good = np.where(v == GOOD, np.log(right[GOOD]), np.log1p(-right[GOOD]))
        like_bad = np.where(v == BAD, np.log(right[BAD]), np.log1p(-right[BAD]))
        z = np.log(prior / (1 - prior)) + (said * (like_good - like_bad)).sum(axis=1)
        new = _sigmoid(z)
        moved = np.abs(new - good).max() if len(new) else 0
        good = new
        if moved < 1e-9:
            break
    return good, right, prior


#: letters of any case and script keep only their case, digits become 0, other characters stay
_SHAPE = np.array([ord("a") if LETTER[c] and not UPPER[c] else ord("A") if UPPER[c] else ord("0") if 48 <= c <= 57 else c for c in range(256)], dtype=np.uint8)


def shape_hashes(words: Words) -> np.ndarray:
    """Hash of the shape of every distinct word: a row of equal signs counts as one."""
    data, offsets = distinct_words(words)
    shape = _SHAPE[data]
    fresh = np.ones(len(shape), dtype=bool)
    fresh[1:] = shape[1:] != shape[:-1]
    fresh[offsets[:-1]] = True
    upto = np.zeros(len(shape) + 1, dtype=np.int64)
    np.cumsum(fresh, out=upto[1:])
    return segment_hashes(shape[fresh], upto[offsets])


def shapes(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed feature, frequency in the text).

    Frequencies count ``SHORT`` words more than there are, so that short texts give weak evidence.
    Features are shapes of words, pairs of neighbouring shapes, and a word's return within the
    last one, two, four or eight words.
    """
    if not len(words.codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    ids = shape_hashes(words)[words.codes]
    text = np.repeat(np.arange(len(words), dtype=np.int64), np.diff(words.offsets))
    same = text[1:] == text[:-1]
    pairs = mix(ids[:-1] ^ mix(ids[1:]))[same]
    mask = np.uint64((1 << bits) - 1)
    owner, hashed = [text, text[1:][same]], [mix(ids) & mask, pairs & mask]
    for back in (1, 2, 4, 8):
        again = np.flatnonzero((words.codes[back:] == words.codes[:-back]) & (text[back:] == text[:-back])) + back
        owner.append(text[again])
        hashed.append(np.full(len(again), mix(np.uint64(back) + np.zeros(1, np.uint64))[0] & mask))
    owner, hashed = np.concatenate(owner), np.concatenate(hashed).astype(np.int64)
    key, times = np.unique((owner << bits) | hashed, return_counts=True)
    owner = key >> bits
    return owner, key & int(mask), times / (np.diff(words.offsets)[owner] + SHORT)


def fit(sets: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; both classes weigh the same."""
    size = 1 << s.bits
    w, b = np.zeros(size), 0.0
    if not len(sets) or good.min() > 0.5 or good.max() < 0.5:
        return w.astype(np.float32), 0.0 if not len(sets) else (4.0 if good.min() > 0.5 else -4.0)
    hashed = np.concatenate([h for h, _ in sets])
    value = np.concatenate([x for _, x in sets])
    text = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    known = np.unique(hashed)
    place = np.zeros(size, np.int64)
    place[known] = np.arange(len(known))
    at = place[hashed]
    weight = np.where(good > 0.5, 0.5 / max((good > 0.5).sum(), 1), 0.5 / max((good <= 0.5).sum(), 1))
    x, m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for t in range(1, s.epochs + 1):
        z = np.bincount(text, weights=value * x[at], minlength=len(sets)) + x[-1]
        g = weight * (_sigmoid(z) - good)
        grad = np.append(np.bincount(at, weights=value * g[text], minlength=len(known)) + s.decay * x[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x -= s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w[known] = x[:-1]
    return w.astype(np.float32), float(x[-1])


@dataclass
class Model:
    posterior: np.ndarray  #: of good text, by pattern of votes
    accuracy: np.ndarray  #: of each labeller on bad and on good text
    prior: float
    weights: np.ndarray
    intercept: float


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", s: Settings | None = None) -> Model:
    """Count votes over all documents, estimate the labellers, fit the scorer on a bounded sample."""
    s = s or Settings()
    workers_find_us(docs.sparkSession)

    def pattern_of(texts: pa.Array) -> pa.Array:
        return pa.array(encode_votes(votes(Words(texts))).astype(np.int32))

    @F.arrow_udf("int")
    def pattern(texts: pa.Array) -> pa.Array:
        return give_back(sliced(pattern_of, s.slice_bytes)(texts))

    counts = docs.select(pattern(F.col(text)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).toArrow()
    patterns, n = np.asarray(counts.column("pattern")), np.asarray(counts.column("n"))
    posterior = np.full(3 ** len(LABELLERS), 0.5)
    if not len(patterns):
        return Model(posterior, np.full((2, len(LABELLERS)), 0.5), 0.5, np.zeros(1 << s.bits, np.float32), 0.0)
    order = np.argsort(patterns)
    good, right, prior = accuracies(patterns[order], n[order])
    posterior[patterns[order]] = good

    bits = s.bits
    ids = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct().orderBy(F.xxhash64("id", F.lit(s.seed)), "id").limit(s.sample)

    def example_of(texts: pa.Array) -> pa.Array:
        words = Words(texts)
        owner, hashed, value = shapes(words, bits)
        at = pa.array(np.searchsorted(owner, np.arange(len(words) + 1)).astype(np.int32))
        return pa.StructArray.from_arrays(
            [
                pa.array(encode_votes(votes(words)).astype(np.int32)),
                pa.ListArray.from_arrays(at, pa.array(hashed.astype(np.int32))),
                pa.ListArray.from_arrays(at, pa.array(value)),
            ],
            names=["pattern", "hashed", "value"],
        )

    @F.arrow_udf("struct<pattern:int,hashed:array<int>,value:array<double>>")
    def example(texts: pa.Array) -> pa.Array:
        return give_back(sliced(example_of, s.slice_bytes)(texts))

    chosen = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id", "left_semi")
    chosen = chosen.groupBy("id").agg(F.min("text").alias("text"))  # an id counts once, however many rows it has
    rows = [r["e"] for r in chosen.select(example("text").alias("e")).toArrow().to_pylist()]
    rows = [r for r in rows if len(r["hashed"])]
    sets = [(np.array(r["hashed"], np.int64), np.array(r["value"])) for r in rows]
    labels = posterior[np.array([r["pattern"] for r in rows], np.int64)] if rows else np.zeros(0)
    weights, intercept = fit(sets, labels, s)
    return Model(posterior, right, prior, weights, intercept)


def judge(docs: DataFrame, model: Model, text: str = "text", s: Settings | None = None) -> DataFrame:
    """Add ``posterior`` (of the votes), ``score`` (of the scorer) and ``kept``."""
    s = s or Settings()
    workers_find_us(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.posterior, model.weights, model.intercept))
    bits = s.bits

    def verdict_of(texts: pa.Array) -> pa.Array:
        posterior, weights, intercept = shared.value
        words = Words(texts)
        owner, hashed, value = shapes(words, bits)
        z = np.bincount(owner, weights=value * weights[hashed], minlength=len(words)) + intercept
        score = np.where(np.diff(words.offsets) > 0, _sigmoid(z), 0.0)
        return pa.StructArray.from_arrays([pa.array(posterior[encode_votes(votes(words))]), pa.array(score)], names=["posterior", "score"])

    @F.arrow_udf("struct<posterior:double,score:double>")
    def verdict(texts: pa.Array) -> pa.Array:
        return give_back(sliced(verdict_of, s.slice_bytes)(texts))

    judged = expand(docs.withColumn("__verdict", verdict(F.col(text))), "__verdict", ["posterior", "score"])
    return judged.withColumn("kept", F.col("score") >= s.keep)


@query("op3_weak_labels")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return judge(docs, train(docs)).select("doc_id", "posterior", "score", "kept")
