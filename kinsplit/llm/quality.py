"""Quality scores by positive-unlabelled learning.

Only trusted positives (label 1) and unlabelled web text are learned from; negatives
are never looked at. A classifier of positive against unlabelled text first gives the
share of good text among the unlabelled (best-bin estimation: the least ratio of the
two groups' upper tails). The scorer then minimises the non-negative unbiased risk
(Kiryo et al., 2017) with the logistic loss:

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

Features are the surface of a whole text: frequencies of pairs of character classes,
repetition of words, word and line lengths. Everything is numpy over bytes.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsplit.llm.tokens import text_bytes, word_hashes
from kinsplit.llm.util import fold
from kinsplit.llm.worker import let_go

POSITIVE_ROWS, UNLABELLED_ROWS = 4000, 6000
#: With fewer of either there is no model: every text scores 0.5, and a warning says so.
LEAST_ROWS = 10
THRESHOLD = 0.3
STEPS, RATE, RIDGE = 300, 0.05, 1e-4

_CLASSES = {"a-z": 1, "A-Z": 2, "0-9": 3, "space": 4, "newline": 5, "other space": 6, ".": 7, ",": 8, "!": 9, "|": 10, "brackets and quotes": 11, "other signs": 12, "not ASCII": 13}
N_CLASSES = 1 + len(_CLASSES)
CLASS = np.zeros(256, np.int64)  # 0: control characters
CLASS[33:127] = 12
CLASS[128:] = 13
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 1, 2, 3
for _chars, _k in ((b" ", 4), (b"\n", 5), (b"\t\r\x0b\x0c", 6), (b".", 7), (b",", 8), (b"!", 9), (b"|", 10), (b"()[]{}\"'<>", 11)):
    CLASS[list(_chars)] = _k
N_FEATURES = N_CLASSES**2 + 6
_SMOOTH = 30


def features(text: str | None) -> np.ndarray:
    """The features of a whole text; a null text is an empty one."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    kind = CLASS[raw]
    out = np.zeros(N_FEATURES)
    pairs = kind[:-1] * N_CLASSES + kind[1:] if len(kind) > 1 else kind[:0]
    out[: N_CLASSES**2] = np.sqrt(np.bincount(pairs, minlength=N_CLASSES**2) / (len(raw) + _SMOOTH))
    hashes = word_hashes(text_bytes(text))
    n = len(hashes)
    again = float((hashes[1:] == hashes[:-1]).sum())
    distinct = len(np.unique(hashes))
    lines = 1 + int((raw == 10).sum())
    out[N_CLASSES**2 :] = np.log1p(len(raw)), np.sqrt(again / (n + 10)), (n - distinct) / (n + 10), np.log1p(len(raw) / (n + 1)), np.log1p(n / lines), np.log1p(again)
    return out


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(gradient, size: int) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        g = gradient(w) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def cuts_of(positive: np.ndarray) -> np.ndarray:
    """Scores to cut at, ascending; at least a tenth of the positives lies above each."""
    return np.sort(positive)[: max(1, int(0.9 * len(positive)))]


def estimate_prior(positive: np.ndarray, tally: np.ndarray) -> float:
    """The share of positives among the unlabelled (best bin).

    ``tally[k]`` unlabelled scores reach exactly ``k`` of the cuts of the positives' scores.
    """
    positive, cuts = np.sort(positive), cuts_of(positive)
    total = tally.sum()
    above_p = 1 - np.searchsorted(positive, cuts, "left") / len(positive)
    above_u = np.cumsum(tally[::-1])[::-1][1:] / total
    slack = np.sqrt(np.log(40) / (2 * len(positive))) + np.sqrt(np.log(40) / (2 * total))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def _tally(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.bincount(np.searchsorted(cuts, scores, "right"), minlength=len(cuts) + 1)


def train(positive: np.ndarray, unlabelled: np.ndarray, count: Callable[[Model, np.ndarray], np.ndarray] | None = None) -> Model:
    """Fit on the features of trusted positives and of unlabelled texts.

    ``count`` gives the tally of all unlabelled texts by a model's scores and cuts of
    these; without it, it is taken of every second of ``unlabelled``.
    """
    if min(len(positive), len(unlabelled)) < LEAST_ROWS:
        warnings.warn(f"{len(positive)} positive and {len(unlabelled)} unlabelled texts are too few to learn quality from: every text scores 0.5 and is kept", stacklevel=2)
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.5)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 0.02
    p, u = (np.concatenate([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)], 1) for x in (positive, unlabelled))

    def against(some_p: np.ndarray, some_u: np.ndarray) -> np.ndarray:
        def gradient(w):
            return -some_p.T @ (1 - _sigmoid(some_p @ w)) / len(some_p) + some_u.T @ _sigmoid(some_u @ w) / len(some_u)

        return _adam(gradient, p.shape[1])

    w = against(p[::2], u[::2])
    held = Model(mean, scale, w, 0.5)
    own = held.scores(positive[1::2])
    cuts = cuts_of(own)
    prior = estimate_prior(own, count(held, cuts) if count else _tally(held.scores(unlabelled[1::2]), cuts))

    def gradient(w):
        zp, zu = p @ w, u @ w
        plus = -prior * (p.T @ (1 - _sigmoid(zp))) / len(p)
        minus = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        return plus + minus if risk >= 0 else -minus  # below zero it only undoes the overfit

    return Model(mean, scale, _adam(gradient, p.shape[1]), prior)


def _features_column():
    @F.pandas_udf("array<double>")
    def surface(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t) for t in texts])

    return surface(F.col("text"))


def fit_on(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    """Learn from bounded samples (``POSITIVE_ROWS``, ``UNLABELLED_ROWS``).

    Positives are rows labelled 1 with crc32(doc_id) mod 5 not 0; unlabelled texts are
    those whose label is not used: not listed, with a null label, or in the held-out fold,
    whatever their label there. Both samples are the rows with the smallest id hashes (ids of
    several texts are skipped, repeated rows count once); the prior is estimated on every
    unlabelled text.
    """
    used = labels.filter((fold(F.col("doc_id"), 5) != 0) & F.col(column).isNotNull()).select("doc_id").distinct()
    trusted = (
        labels.filter((fold(F.col("doc_id"), 5) != 0) & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).alias("lo")).filter("lo = 1").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(POSITIVE_ROWS).withColumn("positive", F.lit(True))
    )
    other = docs.select("doc_id").join(used, "doc_id", "left_anti").distinct().select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(UNLABELLED_ROWS).withColumn("positive", F.lit(False))
    # Both lists are bounded by parameters, so the broadcast is.
    picked = F.broadcast(trusted.unionByName(other).select("doc_id", "h", "positive"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id").groupBy("positive", "h", "doc_id").agg(F.min("text").alias("text"), F.max("text").alias("other")).filter("text = other")
    found = texts.select("positive", "h", "doc_id", _features_column().alias("x")).collect()
    found.sort(key=lambda r: (r.h, r.doc_id))
    take = lambda kind, n: np.array([r.x for r in found if r.positive == kind][:n]).reshape(-1, N_FEATURES)

    def count(held: Model, cuts: np.ndarray) -> np.ndarray:
        reached = F.pandas_udf(lambda x: pd.Series(np.searchsorted(cuts, x.to_numpy(), "right")), "int")
        # Scored before the join, so that no text is shuffled; an anti-join would be pushed below the scores.
        binned = score(docs.select("doc_id", "text"), held, "_held").select("doc_id", reached("_held").alias("bin"))
        rows = binned.join(used.withColumn("_used", F.lit(True)), "doc_id", "left").filter("_used is null").groupBy("bin").count().collect()
        tally = np.zeros(len(cuts) + 1, np.int64)
        for r in rows:  # at most one for each cut
            tally[r.bin] = r["count"]
        return tally

    return train(take(True, POSITIVE_ROWS), take(False, UNLABELLED_ROWS), count)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a quality in 0..1 for each text; a column of that name is replaced.

    Null texts score as empty ones; every row gets a score. Other columns pass through.
    """
    parts = model.mean, model.scale, model.weights, model.prior  # a few hundred floats

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*parts)
        let_go()
        for texts in batches:
            yield pd.Series(own.scores(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)))

    return docs.withColumn(column, quality(F.col("text")))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null texts count as empty ones; a null doc_id is in no fold; repeated rows stay; other
    columns than doc_id and text are not read; an empty table has no row.
    """
    model = fit_on(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
