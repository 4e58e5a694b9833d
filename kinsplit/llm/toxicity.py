"""Toxicity scores from averaged subword embeddings and a linear softmax.

A word is a bag of hashed character n-grams (with its ends marked), its vector the
mean of their embeddings. A span of words is the mean of its words, and a linear softmax
turns it into two classes. Embeddings and softmax are trained together by gradient
descent in numpy: first on averages over whole documents, then on each document's worst
span of ``SPANS`` words in turn, which carries its label, so that a short insult in a
long text is not averaged away. A document's score combines its worst span of each
length with its whole average by a logistic regression on texts held back. Misspellings
never seen share most n-grams with known words.

Scoring keeps one number per n-gram bucket (embedding times the difference of the two
softmax rows), so a model is ``BUCKETS`` floats whatever the corpus.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from uuid import uuid4
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsplit.llm.util import fold, labelled_sample
from kinsplit.llm.worker import Cache, held

BUCKETS, DIM = 1 << 17, 8
#: Lengths of the spans of words that are averaged, besides the whole document.
SPANS = (1, 4)
NGRAMS = (3, 4, 5)
SAMPLE_ROWS = 3000
WARM_UP, EPOCHS = 4, 40
THRESHOLD = 0.7
EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~"


def words(text: str) -> list[str]:
    return text.lower().split()


def subwords(word: str) -> list[int]:
    """Bucket ids of the character n-grams of a word without its outer punctuation."""
    word = f"<{word.strip(EDGE)}>"
    size = len(word)
    if size == 2:
        return []
    if word.isascii():  # a byte is a character
        raw = word.encode()
        ids = [crc32(raw[i : i + n]) % BUCKETS for n in NGRAMS for i in range(size - n + 1)]
    else:
        raw = word.encode("utf-8", "replace")
        ids = [crc32(word[i : i + n].encode("utf-8", "replace")) % BUCKETS for n in NGRAMS for i in range(size - n + 1)]
    if size > NGRAMS[-1]:
        ids.append(crc32(raw) % BUCKETS)
    return ids


def _worst(word_scores: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest mean over ``span`` neighbours per document, and where the first such span starts.

    ``starts``: first word of each document; every document has a word. A shorter document
    is one span.
    """
    n = len(word_scores)
    ends = np.append(starts[1:], n)
    first = np.repeat(starts, ends - starts)
    begin = np.maximum(first, np.arange(n) - span + 1)  # of the span that ends here
    sums = np.concatenate(([0.0], np.cumsum(word_scores)))
    mean = (sums[1:] - sums[begin]) / (np.arange(n) + 1 - begin)
    whole = np.minimum(span, ends - starts)
    mean[np.arange(n) - first + 1 < np.repeat(whole, ends - starts)] = -np.inf
    best = np.maximum.reduceat(mean, starts)
    at = np.flatnonzero(mean == np.repeat(best, ends - starts))
    doc = np.searchsorted(starts, at, "right") - 1
    return best, begin[at[np.unique(doc, return_index=True)[1]]]


def _worst_of(scores: list[float], span: int) -> float:
    """The highest mean over ``span`` neighbours of one document's words."""
    if span == 1:
        return max(scores)
    if len(scores) <= span:
        return sum(scores) / len(scores)
    sums = np.cumsum([0.0, *scores])
    return float((sums[span:] - sums[:-span]).max()) / span


class Model:
    """``bucket``: logit of each n-gram bucket; ``calibration``: weights of 1, the worst span of each
    length, the whole average and the logarithm of the number of words."""

    def __init__(self, bucket: np.ndarray, calibration: np.ndarray):
        self.bucket, self.calibration = bucket, calibration

    def word_score(self, word: str) -> float:
        ids = subwords(word)
        return float(self.bucket[ids].mean()) if ids else 0.0

    def scorer(self):
        """A function from a list of texts to scores; it keeps word scores in a bounded cache."""
        cache, bucket = Cache(), self.bucket.tolist()

        def lookup(word: str) -> float:
            ids = subwords(word)
            return cache.keep(word, sum(map(bucket.__getitem__, ids)) / len(ids) if ids else 0.0)

        def score(texts) -> np.ndarray:
            x = np.zeros((len(texts), len(self.calibration)))
            x[:, 0] = 1
            get = cache.get
            for row, text in zip(x, texts):
                own = words(text) if text else ()
                if own:
                    s = [lookup(w) if (known := get(w)) is None else known for w in own]
                    row[1:] = *(_worst_of(s, span) for span in SPANS), sum(s) / len(s), np.log1p(len(s))
            return 1 / (1 + np.exp(-np.clip(x @ self.calibration, -30, 30)))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w)) + 1e-9
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * len(y) * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def train(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Fit embeddings and softmax on labelled texts; calibrate on every fifth of them, held back."""
    vocabulary: dict[str, int] = {}
    flat, sizes, labels, grams, count = array("i"), [], [], array("i"), []
    for text, label in sample:
        own = words(text)
        if own:
            for w in own:
                k = vocabulary.setdefault(w, len(vocabulary))
                flat.append(k)
                if k == len(count):
                    ids = subwords(w)
                    grams.extend(ids)
                    count.append(len(ids))
            sizes.append(len(own))
            labels.append(label)
    del vocabulary
    if len(set(labels)) < 2:
        prior = (1 + sum(labels)) / (2 + len(labels))
        return Model(np.zeros(BUCKETS, np.float32), np.array([np.log(prior / (1 - prior)), *np.zeros(len(SPANS) + 2)]))
    flat, grams = np.frombuffer(flat, np.int32), np.frombuffer(grams, np.int32)
    sizes, y, count = np.array(sizes), np.array(labels, float), np.array(count)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n_words = len(count)
    bag_start = np.concatenate(([0], np.cumsum(count)))
    owner = np.repeat(np.arange(n_words, dtype=np.int32), count)

    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft = rng.normal(0, 0.5, (2, DIM))
    bias = np.zeros(2)
    square = np.full(emb.shape, 1e-6)
    square_soft, square_bias = np.full(soft.shape, 1e-6), np.full(2, 1e-6)
    fit = np.arange(len(y)) % 5 != 4
    positive = max(y[fit].mean(), 1e-3)
    weight = np.where(y == 1, 0.5 / positive, 0.5 / (1 - positive)) * fit

    def word_scores() -> np.ndarray:
        s = np.bincount(owner, (emb @ (soft[1] - soft[0]))[grams], n_words)
        return s / np.maximum(count, 1)

    def bag_of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``some`` and bucket ids of the n-grams of these words."""
        if len(some) == n_words:
            return owner, grams
        k = count[some]
        return np.repeat(np.arange(len(some)), k), grams[np.repeat(bag_start[some], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]

    for epoch in range(epochs):
        if epoch < WARM_UP:  # whole documents first: which words go with the label
            docs, members = np.repeat(np.arange(len(y)), sizes), flat
        else:
            span = SPANS[epoch % len(SPANS)]
            at = _worst(word_scores()[flat], starts, span)[1]
            length = np.minimum(span, sizes)
            docs = np.repeat(np.arange(len(y)), length)
            members = flat[np.repeat(at, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)]
        share = 1 / np.bincount(docs, minlength=len(y))[docs]
        used, word = np.unique(members, return_inverse=True)
        at_word, ids = bag_of(used)
        part = 1 / np.maximum(count[used], 1)
        vectors = np.stack([np.bincount(at_word, emb[ids, d], len(used)) for d in range(DIM)], 1) * part[:, None]
        mean = np.stack([np.bincount(docs, share * vectors[word, d], len(y)) for d in range(DIM)], 1)
        logits = mean @ soft.T + bias
        p1 = 1 / (1 + np.exp(-np.clip(logits[:, 1] - logits[:, 0], -30, 30)))
        error = (p1 - y) * weight
        # Each word's gradient is a multiple of one direction, and so is each bucket's.
        on_word = np.bincount(word, share * error[docs], len(used)) * part
        on_bucket = np.bincount(ids, on_word[at_word], BUCKETS)
        touched = np.flatnonzero(on_bucket)
        grad = on_bucket[touched, None] * (soft[1] - soft[0])
        grad_soft = error @ mean
        square[touched] += grad**2
        emb[touched] -= 0.15 * grad / np.sqrt(square[touched])
        for k, sign in ((0, -1), (1, 1)):
            square_soft[k] += grad_soft**2
            soft[k] -= 0.1 * sign * grad_soft / np.sqrt(square_soft[k])
            square_bias[k] += error.sum() ** 2
            bias[k] -= 0.1 * sign * error.sum() / np.sqrt(square_bias[k])
    bucket = emb @ (soft[1] - soft[0])
    by_word = word_scores()[flat]
    x = np.stack([np.ones(len(y)), *(_worst(by_word, starts, span)[0] for span in SPANS), np.add.reduceat(by_word, starts) / sizes, np.log1p(sizes)], 1)
    held = ~fit if len(set(y[~fit])) == 2 else np.ones(len(y), bool)
    return Model(bucket.astype(np.float32), _logistic(x[held], y[held]))


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample (``SAMPLE_ROWS``) of the learning folds: crc32(doc_id) mod 3 is not 1."""
    return train(labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 3) != 1, SAMPLE_ROWS))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a toxicity in 0..1 for each text; a column of that name is replaced.

    Null and empty texts and texts without words get the score of a document without
    any words, never null. Repeated rows get equal scores; other columns pass through.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.bucket, model.calibration, uuid4().hex))  # BUCKETS floats: a fixed size

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _scorer(shared)
        for texts in batches:
            yield pd.Series(own(texts.tolist()))

    return docs.withColumn(column, toxicity(F.col("text")))


def _scorer(shared):
    """One scorer, with its cache, for all tasks that a Python worker runs on one model."""
    bucket, calibration, name = shared.value
    return held(name, lambda: Model(bucket, calibration).scorer())


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null texts count as empty ones; a null doc_id is in no fold; repeated rows stay; other
    columns than doc_id and text are not read; an empty table has no row.
    """
    model = fit_on(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
