"""Mixing documents to target weights by soft membership (operator 6); DataFrame functions only.

A table of labelled documents names the domain of some texts. Counts of hashed words per domain
over all of them give a naive-Bayes classifier, which predicts for every document how far it
belongs to each domain. Rates per document are then fitted so that the expected tokens per domain,
``T_k = sum_i rate_i * tokens_i * p_ik``, come as near as can be to the targets: least squares,
weighted by the present totals, by projected gradient. With that weighting a step of one is within
the Lipschitz bound, because ``sum_i tokens_i p_ij p_ik`` divided by the present total of domain
``k`` is a matrix of rows that sum to one. Every step is one pass that sums one number per domain;
the projection keeps rates at a floor or above: zero, or one where no document may be lost.

With a floor of one, documents that other domains need more of also add to the domain that is
already full, so the targets of the smallest possible budget can't be met. There the budget is a
variable too, never below the smallest possible: before every step it rises to what the fullest
domain asks for, as long as each step halves the distance to the targets' shares; after that it is
set to the one the present totals fit best, which stands still where no budget meets the targets.

The model is one number per hashed word and domain: its size depends on ``bits`` and on the number
of targets only, so it is collected and goes into the plan as constants.

Defined results: tokens are words between blanks; a null or empty text has none, belongs to the
domains by their share among the labelled tokens, and its rate moves nothing; labelled rows with a
null or untargeted domain or a null id teach nothing; an id labelled with several domains teaches
all of them; without any labelled word all domains are equally likely; a domain no document belongs
to keeps its target unmet; repeated rows get equal rates; other columns are carried along and give
way to the new ones of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed
from .common import query, table


@dataclass
class Settings:
    bits: int = 12  #: 2**bits hashed words
    evidence: float = 25.0  #: a text counts as at most so many words of evidence, so that long texts stay soft
    steps: int = 60
    tolerance: float = 1e-6  #: of the targets' total


def words_of(text: str) -> Column:
    return F.split(F.col(text), r"[\x20\x09-\x0D]+")


def count_of(words: Column) -> Column:
    """Words in the array ``words``; breaks at either end leave an empty string."""
    ends = (F.element_at(words, 1) == "").cast("int") + F.when(F.size(words) > 1, (F.element_at(words, -1) == "").cast("int")).otherwise(0)
    return F.coalesce(F.when(F.size(words) > 0, F.size(words) - ends), F.lit(0)).cast("long")


def hashed(word: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(1 << bits)).cast("int")


def constants(values: list[float]) -> Column:
    """An array the optimizer turns into one constant."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str, text: str, domain: str, s: Settings) -> tuple[list[list[float]], list[float]]:
    """Log likelihoods per domain and hashed word, and log priors, from counts over all labelled documents."""
    known = labelled.where(F.col(domain).isin(*domains)).select(F.col(key).alias("__id"), F.col(domain).alias("__domain")).distinct()
    words = (
        docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
        .join(known, "__id")
        .select("__domain", F.explode(words_of("__text")).alias("__word"))
        .where("__word <> ''")
    )
    counts = words.groupBy("__domain", hashed(F.col("__word"), s.bits).alias("__bucket")).agg(F.count("*").alias("n")).collect()
    size = 1 << s.bits
    seen = {d: [1.0] * size for d in domains}
    for row in counts:
        seen[row["__domain"]][row["__bucket"]] += row["n"]
    totals = {d: sum(seen[d]) for d in domains}
    log_likelihood = [[math.log(c / totals[d]) for c in seen[d]] for d in domains]
    every = sum(totals.values())
    return log_likelihood, [math.log(totals[d] / every) for d in domains]


def memberships(docs: DataFrame, model: tuple[list[list[float]], list[float]], text: str, out: str, tokens: str, s: Settings) -> DataFrame:
    """Add ``tokens`` and ``out``: the posterior of every domain, in the model's order."""
    log_likelihood, log_prior = model
    held = docs.select(
        *[c for c in docs.columns if c not in (out, tokens)],
        F.inline(F.array(F.struct(F.coalesce(words_of(text), F.array().cast("array<string>")).alias("__words")))),
    )
    held = held.withColumn(tokens, count_of(F.col("__words"))).withColumn(
        "__at", F.transform(F.filter("__words", lambda w: w != ""), lambda w: hashed(w, s.bits))
    )
    held = held.select(*[c for c in held.columns if c not in ("__words", "__at")], F.inline(F.array(F.struct("__at"))))
    weight = F.least(F.lit(1.0), F.lit(s.evidence) / F.greatest(F.col(tokens), F.lit(1)))

    def evidence(likelihood: list[float]) -> Column:
        table_ = constants(likelihood)
        return F.aggregate("__at", F.lit(0.0), lambda a, h: a + F.get(table_, h))

    z = [F.lit(prior) + weight * evidence(likelihood) for likelihood, prior in zip(log_likelihood, log_prior)]
    held = held.select(*[c for c in held.columns if c != "__at"], F.inline(F.array(F.struct(F.array(*z).alias("__z")))))
    top = F.array_max("__z")
    e = F.transform("__z", lambda x: F.exp(x - top))
    posterior = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
    return held.withColumn(out, posterior).drop("__z")


def rate_of(posterior: str, moves: list[list[float]], floor: float = 0.0) -> Column:
    """The rate after the given steps, each projected to ``floor`` or above."""
    rate: Column = F.lit(1.0)
    for step in moves:
        move = sum((F.col(posterior)[i] * F.lit(c) for i, c in enumerate(step)), F.lit(0.0))
        rate = F.greatest(F.lit(floor), rate - move)
    return rate


def floor_of(budget: float | str) -> float:
    return 1.0 if budget == "no_loss" else 0.0


def fit_rates(docs: DataFrame, targets: dict[str, float], posterior: str, tokens: str, s: Settings, budget: float | str = "same") -> list[list[float]]:
    """The steps of the projected gradient, one number per domain each.

    ``targets`` weigh the domains. ``budget`` is the total number of tokens wanted: a number, or
    ``"same"`` (as many as there are), or ``"no_loss"`` (so many that no rate has to be below 1 to
    meet the targets; rates are 1 or more).
    """
    floor = floor_of(budget)
    p = [F.col(posterior)[i] for i in range(len(targets))]

    def totals(moves: list[list[float]]) -> list[float]:
        row = docs.agg(*[F.sum(rate_of(posterior, moves, floor) * F.col(tokens) * x) for x in p]).first()
        return [float(x or 0.0) for x in row]

    now = totals([])
    weights = [w / sum(targets.values()) for w in targets.values()]
    if budget == "same":
        budget = sum(now)
    elif budget == "no_loss":
        budget = least = max([t / w for t, w in zip(now, weights) if w > 0], default=0.0)
    moves, reached, keen, last = [], now, True, math.inf
    while len(moves) < s.steps:
        if floor:
            high = max([least, *(r / w for r, w in zip(reached, weights) if w > 0)])
            miss = sum(abs(r / high - w) for r, w in zip(reached, weights)) if high > 0 else 0.0
            keen, last = keen and miss <= last / 2, miss
            each = [(r, w, t) for r, w, t in zip(reached, weights, now) if t > 0 and w > 0]
            fits = sum(r * w / t for r, w, t in each) / sum(w * w / t for _, w, t in each) if each else least
            budget = high if keen else max(least, fits)
        error = [r - w * budget for r, w in zip(reached, weights)]
        if sum(map(abs, error)) <= s.tolerance * max(budget, 1.0):
            break
        moves.append([e / t if t > 0 else 0.0 for e, t in zip(error, now)])
        before, reached = reached, totals(moves)
        # targets no rates reach: the totals stand still at the nearest ones
        if sum(abs(a - b) for a, b in zip(before, reached)) <= s.tolerance * max(budget, 1.0):
            break
    return moves


def fitted(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    key: str = "doc_id",
    text: str = "text",
    domain: str = "lang",
    budget: float | str = "same",
    s: Settings | None = None,
) -> tuple[tuple[list[list[float]], list[float]], DataFrame, list[list[float]]]:
    """Classifier, checkpointed memberships (``key``, ``posterior``, ``n_tokens``) and the fitted steps."""
    s = s or Settings()
    model = classifier(docs, labelled, list(targets), key, text, domain, s)
    narrow = checkpointed(memberships(docs.select(key, text), model, text, "posterior", "n_tokens", s).drop(text))
    return model, narrow, fit_rates(narrow, targets, "posterior", "n_tokens", s, budget)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """``key``, ``n_tokens``, ``posterior`` (in the order of ``targets``) and ``rate`` of every document."""
    _, narrow, moves = fitted(docs, labelled, targets, **options)
    return narrow.withColumn("rate", rate_of("posterior", moves, floor_of(options.get("budget", "same"))))


def resample(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", seed: int = 23, s: Settings | None = None, **options
) -> DataFrame:
    """``docs`` with every row as often as its rate says.

    A rate of 2.3 is two copies and, for three ids in ten (by a hash of the id), a third one.
    Memberships are computed again beside the texts, which costs less than to shuffle the texts.
    """
    s = s or Settings()
    model, _, moves = fitted(docs, labelled, targets, key=key, text=text, s=s, **options)
    rated = memberships(docs, model, text, "__posterior", "__tokens", s)
    rated = rated.withColumn("__rate", rate_of("__posterior", moves, floor_of(options.get("budget", "same"))))
    chance = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1e6
    copies = (F.floor("__rate") + (chance < F.col("__rate") - F.floor("__rate")).cast("int")).cast("int")
    rated = rated.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies)))
    return rated.select(*docs.columns)


TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


@query("op6_soft_mixing")
def _(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    labelled = docs.select("doc_id", "lang").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    mixed = mix(docs, labelled, TARGETS)
    each = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)]
    return mixed.select("doc_id", "n_tokens", *each, "rate")
