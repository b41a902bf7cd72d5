"""Mixing domains to target weights with soft membership, built-in functions only.

A labelled table names the domain of some documents. A classifier on the presence of telling
words gives every document a posterior over the domains; projected gradient steps on least
squares then find non-negative rates per document, so that the expected tokens of each domain,
posterior times tokens times rate, meet the targets.

The classifier is fitted on a bounded sample of labelled documents (``sample_limit``) and a
bounded vocabulary (``vocabulary``); posteriors, totals and every gradient step cover all rows.

Defined cases: a null or empty text has no tokens and the posterior of a text without telling words; without
labelled documents every posterior is even; a target of a domain without tokens is left out and
the others are scaled up; repeated rows count as often as they occur; an empty table gives no
rows; columns of the input named like a result column are replaced.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.storage import discard, stored

_SPACE = "[ \\t-\\r]+"
_BOUND = 10.0


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")


@dataclass
class WordClassifier:
    """Log ratios of the presence of telling words, and how their sums become posteriors.

    The sums per domain, bounded by ``_BOUND``, enter a linear model with one intercept and one
    row of weights per domain, so a text without telling words gets the posterior that such
    texts had among the labelled ones.
    """

    domains: list[str]
    ratios: dict[str, list[float]]
    intercepts: list[float]
    weights: list[list[float]]

    def sums(self, words: Column) -> Column:
        start = F.array(*(F.lit(0.0) for _ in self.domains))
        if not self.ratios:
            return start
        table = F.from_json(F.lit(json.dumps(self.ratios)), "map<string,array<double>>")
        return F.aggregate(
            F.array_intersect(words, F.map_keys(table)),
            start,
            lambda s, w: F.zip_with(s, F.element_at(table, w), lambda a, b: a + b),
        )

    def posteriors(self, docs: DataFrame, words: str) -> DataFrame:
        """``docs`` with an array ``p`` of one probability per domain, from a column of words.

        Sums, scores and probabilities are each used several times by what follows. The sums
        and the probabilities are written out, so no plan repeats the work on the words.
        """
        kept = [c for c in docs.columns if c != words]
        summed = stored(docs.select(*kept, self.sums(F.col(words)).alias("__sums")), "sums")
        known = stored(self._from_sums(summed).select(*kept, "p"), "posteriors")
        discard(summed)
        return known

    def _from_sums(self, docs: DataFrame) -> DataFrame:
        each = [F.get("__sums", F.lit(k)) for k in range(len(self.domains))]
        bounded = [s / (1 + F.abs(s) / _BOUND) for s in each]
        scores = [
            reduce(lambda a, b: a + b, [F.lit(i), *(F.lit(w) * s for w, s in zip(row, bounded, strict=True))])
            for i, row in zip(self.intercepts, self.weights, strict=True)
        ]
        top = F.array_max("__scores")
        powers = [F.exp(F.get("__scores", F.lit(k)) - top) for k in range(len(self.domains))]
        total = reduce(lambda a, b: a + b, powers)
        return docs.withColumn("__scores", F.array(*scores)).withColumn("p", F.array(*(x / total for x in powers)))


def _fit_linear(x: np.ndarray, y: np.ndarray, count: int, steps: int = 400) -> tuple[list, list]:
    """Intercepts and weights of a softmax model of a bounded sample, by plain gradient steps."""
    x = np.column_stack([np.ones(len(x)), x / _BOUND])
    target = np.eye(count)[y]
    w, speed = np.zeros((x.shape[1], count)), 0.0
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = x.T @ (p - target) / len(x) + 1e-4 * w
        speed = 0.9 * speed + slope
        w -= 0.5 * speed
    return w[0].tolist(), (w[1:].T / _BOUND).tolist()


def fit_classifier(
    docs: DataFrame,
    labelled: DataFrame,
    domains: list[str],
    sample_limit: int = 4000,
    vocabulary: int = 256,
) -> WordClassifier:
    """``labelled``: doc_id and domain; of repeated ids the smallest domain counts."""
    chosen = (
        labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("domain").alias("domain"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(sample_limit)
    )
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), "doc_id"
    )
    found = stored(taught.select("domain", F.array_distinct(words_of(F.col("text"))).alias("words")), "taught")
    sizes = dict.fromkeys(domains, 0) | {r[0]: r[1] for r in found.groupBy("domain").count().collect()}
    n = sum(sizes.values())
    if not n:
        even = [0.0] * len(domains)
        return WordClassifier(domains, {}, even, [even for _ in domains])
    counts = (
        found.select("domain", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(
            F.count("*").alias("df"),
            *(F.count_if(F.col("domain") == d).alias(f"d{k}") for k, d in enumerate(domains)),
        )
        .where("df >= 5")
    )
    overall = (F.col("df") + 1.0) / (n + 2.0)
    rates = [(F.col(f"d{k}") + 0.5) / (sizes[d] + 1.0) for k, d in enumerate(domains)]
    ratios = [_telling(F.log(rate / overall)) for rate in rates]
    told = reduce(
        lambda a, b: a + b,
        [F.lit(sizes[d] / n) * rate * ratio for d, rate, ratio in zip(domains, rates, ratios, strict=True)],
    )
    best = counts.select("word", told.alias("told"), F.array(*ratios).alias("ratios"))
    rows = best.orderBy(F.desc("told"), "word").limit(vocabulary).collect()
    model = WordClassifier(domains, {r["word"]: list(r["ratios"]) for r in rows}, [], [])
    sample = found.select("domain", model.sums(F.col("words")).alias("sums")).collect()
    x = np.array([r["sums"] for r in sample])
    y = np.array([domains.index(r["domain"]) for r in sample])
    model.intercepts, model.weights = _fit_linear(x / (1 + np.abs(x) / _BOUND), y, len(domains))
    return model


def _dot(posterior: Column, errors: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [F.get(posterior, F.lit(k)) * F.lit(e) for k, e in enumerate(errors)])


def _telling(ratio: Column) -> Column:
    """The part of a log ratio beyond a factor of two.

    Slight ratios follow the length of texts, not their domain, and would add up over words.
    """
    return F.signum(ratio) * F.greatest(F.lit(0.0), F.abs(ratio) - log(2.0))


def _stepped(rate: Column, steps: list[list[float]], repeat: bool) -> Column:
    """The rate after some steps, each projected back to zero or more, and to one at most without ``repeat``."""

    def step(r: Column, e: list[float]) -> Column:
        free = F.greatest(F.lit(0.0), r - _dot(F.col("p"), e))
        return free if repeat else F.least(F.lit(1.0), free)

    return reduce(step, steps, rate)


@dataclass
class Mixture:
    """A fitted mixture: how rates follow from a text, and how near the totals came."""

    model: WordClassifier
    steps: list[list[float]]
    totals: list[float]
    targets: list[float]
    members: DataFrame
    repeat: bool = True

    def rated(self, members: DataFrame) -> DataFrame:
        """Rows with ``doc_id`` and ``p`` get their rate and their number of copies.

        The number is the rate rounded up or down by a draw from the digest of the id.
        """
        rows = members.withColumn("rate", F.lit(1.0))
        for at in range(0, len(self.steps), 10):
            rows = rows.withColumn("rate", _stepped(F.col("rate"), self.steps[at : at + 10], self.repeat))
        key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        draw = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32)
        whole = F.floor("rate")
        return rows.withColumn("copies", whole + (draw < F.col("rate") - whole).cast("long"))

    def repeated(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` as often as their copies say, with their columns unchanged."""
        rows = docs.select(
            F.struct(*docs.columns).alias("__row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            words_of(F.col("text")).alias("__words"),
        )
        known = self.model.posteriors(rows, "__words")
        times = F.sequence(F.lit(1), F.col("copies").cast("int"))
        rated = stored(self.rated(known).select("__row", "copies"), "copies")
        discard(known)
        return rated.where("copies > 0").select("__row", F.explode(times).alias("__copy")).select("__row.*")


def fit_rates(
    members: DataFrame,
    weights: list[float],
    repeat: bool = True,
    rounds: int = 30,
    tolerance: float = 1e-4,
    every: int = 10,
    damping: float = 0.1,
) -> tuple[list[list[float]], list[float], list[float]]:
    """Steps, totals reached and targets of projected gradient least squares.

    The squared misses of the domain totals are weighted by the inverse of the posteriors'
    moments, damped by the domains' masses (``damping``). That weight bounds the curvature by
    one, so unit steps shrink the objective in every round, whatever the posteriors are. A
    round is one sum over all rows; rates are written out every ``every`` rounds to keep plans
    short.
    With ``repeat`` the total stays as it is. Without, the domain of the largest weight stays
    whole, no target is larger than its domain and no rate is above one, so no document is repeated.
    """
    count = len(weights)
    pairs = [(i, j) for i in range(count) for j in range(i, count)]

    def sums(rows: DataFrame, columns: list[Column]) -> np.ndarray:
        return np.array([float(x or 0.0) for x in rows.agg(*map(F.sum, columns)).first()])

    part = [F.col("n_tokens") * F.get("p", F.lit(k)) for k in range(count)]
    first = sums(members, [*part, *(part[i] * F.get("p", F.lit(j)) for i, j in pairs)])
    totals = mass = first[:count]
    moments = np.zeros((count, count))
    for (i, j), v in zip(pairs, first[count:], strict=True):
        moments[i, j] = moments[j, i] = v
    everything = float(mass.sum())
    wanted = np.where(mass > 1e-9 * everything, weights, 0.0)
    if everything <= 0 or wanted.sum() <= 0:
        return [], list(mass), list(mass)
    shares, main = wanted / wanted.sum(), int(np.argmax(wanted))
    total = everything if repeat else float(mass[main] / shares[main])
    targets = total * shares if repeat else np.minimum(total * shares, mass)
    current = members.withColumn("rate", F.lit(1.0))
    steps: list[list[float]] = []
    pending: list[list[float]] = []
    weight = np.linalg.inv(moments + damping * np.diag(np.maximum(mass, 1e-6 * everything)))
    while np.abs(totals - targets).max() > tolerance * total and len(steps) < rounds:
        pending.append([float(x) for x in weight @ (totals - targets)])
        steps.append(pending[-1])
        rate = _stepped(F.col("rate"), pending, repeat)
        totals = sums(current, [p * rate for p in part])
        if len(steps) % every == 0:
            current, pending = stored(current.withColumn("rate", _stepped(F.col("rate"), pending, repeat)), "rates"), []
    return steps, list(totals), list(targets)


def fit_mixture(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    repeat: bool = True,
    sample_limit: int = 4000,
    vocabulary: int = 256,
) -> Mixture:
    domains = sorted(targets)
    model = fit_classifier(docs, labelled, domains, sample_limit, vocabulary)
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    tokens = F.size("words").cast("long").alias("n_tokens")
    members = model.posteriors(words.select("doc_id", "words", tokens), "words")
    return Mixture(model, *fit_rates(members, [targets[d] for d in domains], repeat), members, repeat)


def mix_domains(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **settings) -> DataFrame:
    """One row per document: doc_id, n_tokens, p (posteriors in the order of the sorted domains),
    rate and copies.
    """
    mixture = fit_mixture(docs, labelled, targets, **settings)
    return mixture.rated(mixture.members)
