"""Mixing documents to target shares of tokens, with soft domain memberships.

1. A table of labelled documents trains a naive Bayes classifier over hashed
   words: counts of ``BUCKETS`` buckets per domain, summed on the executors. Every
   document gets the chance of each domain (its posterior; ``WITNESS`` words count as one
   witness, since words of one text are no independent ones, at any length of text, so that
   short texts are not left undecided and then dropped by the fit).
2. A document of ``t`` tokens and posterior ``p`` adds ``rate * t * p`` expected
   tokens to the domains. Rates are fitted so that these totals come as near to
   the targets as they can: least squares in the totals, with a small pull
   ``RIDGE`` towards rate 1 so that the answer is unique, under ``rate >= 0``. The
   gradient of a document's rate is its posterior times the totals' errors, so
   the sum of all gradients is one number ``y`` per domain, and the projected rate
   is ``max(0, 1 + p . y)``. A step takes the gradient at the projected rates and moves ``y`` against it,
   by a length that the curvature with all rates positive sets (rates that become zero only
   lower it, so no step goes too far), with momentum that starts anew whenever it points uphill.
   Every ``RENEW`` steps the length is set anew from twice the curvature of the rates that are still positive; if
   the gradient then grows, the fit goes back to its best point and to the first length. A
   step is one sum of a few numbers over all rows; nothing else reaches the driver, and no row
   keeps a state. A fit that does not converge fails; targets that the best rates
   miss by more than ``MISSED`` are logged with the shares that they reach.
3. ``mixed`` repeats a document as often as the whole part of its rate says and
   once more with the chance of the rest, drawn by a hash of its id and text.

Null texts have no words: their posterior is the prior, their tokens are zero,
and their rate counts like any other. Labels that are null, or of no document, do
not train; a document labelled more than once trains once per label; without any
label all domains are as likely, and with an empty table there are no rates.
Rows of equal id and text get equal rates. Other columns pass unchanged; names
beginning with ``_mix_`` are reserved.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bind
from .common import fold, store, words

log = logging.getLogger(__name__)

#: Names of the domains that ``domain_of`` numbers.
DOMAINS = ("clean", "toxic", "junk")
BUCKETS, SMOOTHING = 4096, 1.0
#: Words that together count as one independent witness.
WITNESS = 4
#: At most so many labels train the classifier.
TRAIN_LABELS = 200_000
#: Pull towards rate 1, against a squared error that is relative to all tokens.
RIDGE = 1e-5
#: Steps after which a fit fails, the gradient at which it is done, and steps between new lengths.
STEPS, TOLERANCE, RENEW = 400, 1e-10, 20
#: Distance from a target share that is logged.
MISSED = 1e-3


def buckets(text: Column) -> Column:
    """The bucket of each word of a text."""
    return F.transform(words(F.lower(F.coalesce(text, F.lit("")))), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def train(hashed: DataFrame, n_domains: int) -> list[list[float]]:
    """Log chance of each bucket per domain, and of the domain itself as the last number.

    ``hashed`` holds ``_mix_words`` and ``_mix_domain`` of the labelled documents. What
    comes back to the driver is at most ``(BUCKETS + 1) * n_domains`` counters.
    """
    per_word = hashed.select("_mix_domain", F.explode(F.concat("_mix_words", F.array(F.lit(BUCKETS)))).alias("bucket"))
    counted = {(r[0], r[1]): r[2] for r in per_word.groupBy("_mix_domain", "bucket").count().collect()}
    model = []
    n_docs = sum(counted.get((d, BUCKETS), 0) for d in range(n_domains))
    for d in range(n_domains):
        total = sum(counted.get((d, b), 0) for b in range(BUCKETS))
        row = [math.log((counted.get((d, b), 0) + SMOOTHING) / (total + SMOOTHING * BUCKETS)) for b in range(BUCKETS)]
        model.append([*row, math.log((counted.get((d, BUCKETS), 0) + SMOOTHING) / (n_docs + SMOOTHING * n_domains))])
    return model


def posteriors(hashed: DataFrame, model: list[list[float]]) -> DataFrame:
    """``hashed`` with ``_mix_p``, an array of the domains' chances.

    The model is one array literal per domain, of ``BUCKETS + 1`` numbers.
    """
    found = F.col("_mix_words")

    def logit(row: list[float]) -> Column:
        chances = F.lit(np.array(row))
        return F.lit(row[BUCKETS]) + F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(chances, b)) / F.lit(float(WITNESS))

    def softmax(x: Column) -> Column:
        top = F.array_max(x)
        weights = F.transform(x, lambda v: F.exp(v - top))
        return bind(weights, lambda w: F.transform(w, lambda v: v / F.aggregate(w, F.lit(0.0), lambda a, b: a + b)))

    return hashed.withColumn("_mix_p", bind(F.array(*map(logit, model)), softmax))


def rate(p: Column, y: Sequence[float]) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) + fold([F.get(p, i) * F.lit(float(v)) for i, v in enumerate(y)]))


def fit_rates(measured: DataFrame, weights: Sequence[float], ridge: float = RIDGE, steps: int = STEPS) -> tuple[list[float], list[float]]:
    """``y`` of the rates, and the share of all tokens that they give each domain.

    Minimizes ``sum_d (total_d / tokens - weight_d)^2 / 2 + ridge * sum_i t_i / tokens * (rate_i - 1)^2 / 2``
    under ``rate >= 0`` by accelerated projected-gradient steps: with ``rate_i = max(0, 1 + p_i . y)`` the gradient
    is ``total / tokens + ridge * y - weights``. Each step is one job that brings back these few sums. Raises
    ``RuntimeError`` if the gradient is not below ``TOLERANCE`` after ``steps`` jobs.
    """
    n = len(weights)
    p = [F.get("_mix_p", i) for i in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    t = F.col("_mix_tokens")
    first = measured.agg(F.sum(t), *(F.sum(t * p[i] * p[j]) for i, j in pairs)).first()
    tokens = float(first[0] or 0)
    if not tokens:
        return [0.0] * n, [0.0] * n
    target = np.array(weights, float)

    def filled(sums: Sequence[float]) -> np.ndarray:
        out = ridge * np.eye(n)
        for (i, j), v in zip(pairs, sums):
            out[i, j] += v / tokens
            out[j, i] = out[i, j]
        return out

    def gradient(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradient and the totals at ``y``."""
        rates = measured.select("_mix_p", (t / F.lit(tokens) * rate(F.col("_mix_p"), y)).alias("given"))
        totals = np.array(rates.agg(*(F.sum(F.col("given") * x) for x in p)).first(), float)
        return totals + ridge * y - target, totals

    def positive(y: np.ndarray) -> np.ndarray:
        """The curvature over the rows of a positive rate."""
        some = measured.where(rate(F.col("_mix_p"), y) > 0).agg(*(F.sum(t * p[i] * p[j]) for i, j in pairs)).first()
        return filled([v or 0.0 for v in some])

    whole = length = filled(first[1:])
    y = at = best = np.zeros(n)
    momentum, slope, least = 1.0, None, np.inf
    for step in range(steps):
        slope, totals = gradient(at)
        size = float(np.abs(slope).max())
        if size < TOLERANCE:
            return at.tolist(), totals.tolist()
        if size < least:
            best, least = at, size
        if step and step % RENEW == 0:
            y, at, momentum = best, best, 1.0
            length = 2 * positive(best)
            continue
        if size > 4 * least and length is not whole:
            y, at, momentum, length = best, best, 1.0, whole
            continue
        new = at - np.linalg.solve(length, slope)
        if slope @ (new - y) > 0:
            momentum = 1.0
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        at, y, momentum = new + (momentum - 1) / following * (new - y), new, following
    raise RuntimeError(f"rates not fitted after {steps} steps: gradient {slope if slope is None else slope.tolist()}, targets {list(weights)}")


def domain_of(labels_quality: str = "quality", labels_toxic: str = "toxic") -> Column:
    """The number of a label's domain in ``DOMAINS``; null if the label says nothing."""
    toxic, quality = F.col(labels_toxic), F.col(labels_quality)
    return F.when(toxic > 0, 1).when(quality == 0, 2).when(toxic.isNotNull() | quality.isNotNull(), 0)


def measure(docs: DataFrame, labels: DataFrame, domain: Column, n_domains: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_mix_id, _mix_hash, _mix_tokens, _mix_p)`` of every row of ``docs``, stored.

    ``domain`` gives the number of a label's domain, from the columns of ``labels``.
    Of more than ``TRAIN_LABELS`` labels those with the least hash of their id train.
    """
    known = labels.select(F.col(id_col).alias("_mix_id"), domain.alias("_mix_domain")).where(F.col("_mix_domain").isNotNull())
    known = F.broadcast(known.orderBy(F.xxhash64("_mix_id"), "_mix_domain").limit(TRAIN_LABELS))
    hashed = docs.select(F.col(id_col).alias("_mix_id"), F.xxhash64(text_col).alias("_mix_hash"), buckets(F.col(text_col)).alias("_mix_words"))
    model = train(hashed.select("_mix_id", "_mix_words").join(known, "_mix_id"), n_domains)
    scored = posteriors(hashed, model).select("_mix_id", "_mix_hash", F.size("_mix_words").cast("long").alias("_mix_tokens"), "_mix_p")
    return store(scored, "mixing")


def rated(docs: DataFrame, labels: DataFrame, domain: Column, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``measure`` gives, with ``_mix_rate`` and ``_mix_copies``."""
    measured = measure(docs, labels, domain, len(weights), id_col, text_col)
    y, shares = fit_rates(measured, weights)
    if max(abs(s - w) for s, w in zip(shares, weights)) > MISSED:
        log.warning("mixing: shares %s for targets %s", [round(s, 6) for s in shares], list(weights))
    given = measured.withColumn("_mix_rate", rate(F.col("_mix_p"), y))
    return given.withColumn("_mix_copies", copies(F.col("_mix_rate"), F.col("_mix_id"), F.col("_mix_hash")))


def mixed(docs: DataFrame, labels: DataFrame, domain: Column, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every row as often as its rate says."""
    taken = rated(docs, labels, domain, weights, id_col, text_col).select("_mix_id", "_mix_hash", "_mix_copies").distinct()
    same = F.col(id_col).eqNullSafe(F.col("_mix_id")) & (F.xxhash64(text_col) == F.col("_mix_hash"))
    rows = docs.join(taken.where("_mix_copies > 0"), same)
    repeated = rows.withColumn("_mix_nth", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))


def copies(r: Column, id_: Column, hash_: Column, seed: int = 1) -> Column:
    """How often a row of rate ``r`` is taken."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_, hash_), 11) * F.lit(2.0**-53)
    return (F.floor(r) + F.when(u < r - F.floor(r), 1).otherwise(0)).cast("int")
