"""Languages of a text as a mixture, inferred by expectation-maximisation.

Each language has smoothed log-likelihoods of hashed character trigrams. A document is
a bag of words drawn from an unknown mix of languages: EM finds the shares under which
its words' n-gram likelihoods are highest. The set of languages is then chosen by
penalised likelihood (BIC): the language of the smallest share goes as long as that
improves the criterion. The answer is the set's largest share, which is its score.

The likelihood is concave in the shares, so its slopes where one language has all of
them bound what any mixture can gain. Where that is less than the penalty of a second
language, as in most texts, the one language is the best set and EM is not needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsplit.llm.util import fold
from kinsplit.llm.worker import CACHE_BYTES, held

BUCKETS, N = 1 << 16, 3
SAMPLE_PER_LANGUAGE = 800
ROUNDS, SMOOTH = 12, 0.2
_WORD_BYTES = 200  # of a word that is kept, without its likelihoods
UNDETERMINED = "und"
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())


def trigrams(word: str) -> list[int]:
    """Buckets of a word's trigrams, without outer signs and digits; none without a letter."""
    word = word.strip(EDGE)
    if not word.isalpha() and not any(map(str.isalpha, word)):
        return []
    word = f" {word} "
    if word.isascii():  # a byte is a character
        raw = word.encode()
        return [crc32(raw[i : i + N]) % BUCKETS for i in range(len(raw) - N + 1)]
    return [crc32(word[i : i + N].encode("utf-8", "replace")) % BUCKETS for i in range(len(word) - N + 1)]


def shares(likelihood: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture weights of the columns by EM, and the log-likelihood they give."""
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    for _ in range(ROUNDS):
        part = likelihood * share
        total = part.sum(1)
        share = (part / total[:, None]).mean(0)
    return share, float(np.log(likelihood @ share).sum())


def alone(likelihood: np.ndarray, one: int, penalty: float) -> bool:
    """Whether no mixture can be likelier than column ``one`` by a penalty or more."""
    slopes = (likelihood / likelihood[:, one : one + 1]).sum(0) - len(likelihood)
    return bool(slopes.max() < penalty)


def mixture(log_likelihood: np.ndarray) -> np.ndarray:
    """Shares of all languages for words x languages; 0 outside the chosen set."""
    likelihood = np.exp(np.maximum(log_likelihood - log_likelihood.max(1, keepdims=True), -30))
    penalty = 0.5 * np.log(len(likelihood) + 1)
    one = int(log_likelihood.sum(0).argmax())
    if alone(likelihood, one, penalty):
        return np.eye(likelihood.shape[1])[one]
    chosen = np.arange(likelihood.shape[1])
    share, fit = shares(likelihood)
    while len(chosen) > 1:
        fewer = np.delete(chosen, share.argmin())
        own, other = shares(likelihood[:, fewer])
        if other + penalty < fit:
            break
        chosen, share, fit = fewer, own, other
    out = np.zeros(likelihood.shape[1])
    out[chosen] = share
    return out


class Model:
    """``table``: log-likelihood of each trigram bucket in each of ``languages``."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def predictor(self):
        """A function from texts to (language, share) pairs; the words it keeps are bounded by bytes."""
        known: dict[str, int] = {}
        most = CACHE_BYTES // (_WORD_BYTES + 8 * len(self.languages))
        rows = np.zeros((1024, len(self.languages)))
        used = 0

        def learn(words: set[str]) -> None:
            nonlocal rows, used
            flat, starts = [], []
            for word in words:
                ids = trigrams(word)
                known[word] = used + len(starts) if ids else -1
                if ids:
                    starts.append(len(flat))
                    flat += ids
            if starts:
                if used + len(starts) > len(rows):
                    rows = np.concatenate([rows, np.zeros((len(rows) + len(starts), rows.shape[1]))])
                rows[used : used + len(starts)] = np.add.reduceat(self.table[flat], starts)
                used += len(starts)

        def predict(texts) -> list[tuple[str, float]]:
            nonlocal rows, used
            out = []
            for text in texts:
                if len(known) > most:
                    known.clear()
                    rows, used = np.zeros((1024, len(self.languages))), 0
                words = (text or "").lower().split()
                learn(set(words).difference(known))
                at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                at = at[at >= 0]
                if not len(at) or not self.languages:
                    out.append((UNDETERMINED, 0.0))
                    continue
                share = mixture(rows[at])
                out.append((self.languages[share.argmax()], float(min(1.0, share.max()))))
            return out

        return predict


def train(sample: list[tuple[str, str]]) -> Model:
    """Trigram log-likelihoods from (text, language) pairs."""
    languages = sorted({lang for _, lang in sample})
    counts = np.zeros((BUCKETS, len(languages)))
    cache: dict[str, list[int]] = {}
    for k, lang in enumerate(languages):
        ids: list[int] = []
        for text, own in sample:
            if own == lang:
                for w in (text or "").lower().split():
                    if (g := cache.get(w)) is None:
                        g = cache[w] = trigrams(w)
                    ids += g
                if len(ids) > 1_000_000:
                    counts[:, k] += np.bincount(np.array(ids, np.int32), minlength=BUCKETS)
                    ids = []
        counts[:, k] += np.bincount(np.array(ids, np.int32), minlength=BUCKETS)
    return Model(languages, np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * BUCKETS)))


def fit_on(docs: DataFrame) -> Model:
    """Learn from at most ``SAMPLE_PER_LANGUAGE`` texts, of any length, of each language.

    Only rows with a language and with crc32(doc_id) mod 3 not 1; of these the ones with the
    smallest id hashes. Repeated rows count once; ids of several texts in one language are
    skipped, as are null texts.
    """
    scale = 1 << 31
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 3) != 1)).select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(scale)).alias("h"))
    # Hashes are even, so four times the share wanted holds the rows wanted; no task sees all rows of a language.
    counted = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()  # a row for each language
    if not counted:
        return train([])
    below = F.create_map(*[F.lit(x) for r in counted for x in (r.lang, min(scale, 4 * SAMPLE_PER_LANGUAGE * scale // max(1, r.n)))])
    near = usable.filter(F.col("h") < F.try_element_at(below, F.col("lang"))).distinct().collect()
    picked = []
    for r in counted:
        own = sorted((x.h, x.doc_id) for x in near if x.lang == r.lang)[:SAMPLE_PER_LANGUAGE]
        picked += [(doc_id, r.lang, h) for h, doc_id in own]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long, lang string, h long"))  # bounded for each language
    found = docs.select("doc_id", "lang", "text").join(wanted, ["doc_id", "lang"]).groupBy("h", "doc_id", "lang").agg(F.min("text").alias("text"), F.max("text").alias("other")).filter("text = other").select("h", "doc_id", "lang", "text").collect()
    return train([(r.text, r.lang) for r in sorted(found, key=lambda r: (r.h, r.doc_id, r.lang))])


def _predictor(shared):
    """One predictor, with its cache, for all tasks that a Python worker runs on one model."""
    languages, table, name = shared.value
    return held(name, lambda: Model(languages, table).predictor())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    Null texts and texts without letters are ``und`` with score 0, as is every text if
    no language was learned. Other columns pass through, repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, uuid4().hex))  # BUCKETS x languages

    @F.pandas_udf("lang_pred string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _predictor(shared)
        for texts in batches:
            yield pd.DataFrame(own(texts.tolist()), columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, language(F.col("text")).alias("_found")).select(*kept, "_found.lang_pred", "_found.score")


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``.

    A null doc_id is in no fold; repeated rows stay; of equal shares the first language by
    name is taken; other columns than doc_id, text and lang are not read; an empty table
    has no row.
    """
    found = predict(docs.select("doc_id", "text"), fit_on(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
