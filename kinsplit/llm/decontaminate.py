"""Benchmark decontamination with spaced seeds.

A seed is the hash of the words at the open positions of a fixed mask; the other
positions are ignored, so a hit survives substitutions there. Seeds of all benchmark
items are joined with the seeds at every word of every document. Each hit fixes an
alignment of item and document, which is then compared word by word: an item leaks where
some run of ``RUN`` aligned words (all of them in shorter items) agrees in at least
``AGREE`` of its places. Words are runs of letters and digits in lower case, so punctuation and
spacing, ASCII or not, do not matter.

In an item of 5 to 12 words the masks above may all meet a substitution, so these are
looked for by ``SHORT_MASKS`` too; the tests enumerate that each length is complete. In
items under 5 words the rule leaves no place for a substitution, and their mask is the
item. Null items and items without words have nothing to look for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsplit.llm.tokens import NOT_ALPHANUMERIC, mix, text_bytes, word_hashes
from kinsplit.llm.worker import held
from kinsplit.plans.scratch import stored

MASKS = ("11111", "1101011", "11100101", "1011001001", "110010000101")
SHORT_MASKS = ("1111", "11011", "10111", "11101")
RUN, AGREE = 13, 0.8
#: Words of benchmark text that are broadcast at a time; a larger benchmark takes several passes.
BLOCK_WORDS = 2_000_000
_FILTER_BITS = 22


def _is_sign(char: str) -> bool:
    """Punctuation, symbols and spaces; marks stay within their words."""
    return unicodedata.category(char)[0] in "PSZ"


# A class with characters beyond 0xFFFF is matched range by range, so these have a pattern of their own.
_SIGNS = re.compile("[" + "".join(re.escape(chr(c)) for c in range(128, 0x10000) if _is_sign(chr(c))) + "]+")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def hashes(text: str | None) -> np.ndarray:
    text = (text or "").lower()
    if not text.isascii():
        text = _BEYOND.sub(lambda m: " " if _is_sign(m[0]) else m[0], _SIGNS.sub(" ", text))
    return word_hashes(text_bytes(text), NOT_ALPHANUMERIC)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks by which an item of ``n`` words is looked for."""
    if n < 5:
        return ("1" * n,)
    return MASKS + SHORT_MASKS if n < RUN else MASKS


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each position at which the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return words[:0]
    out = np.zeros(n, np.uint64)
    for k, open_ in enumerate(mask):
        if open_ == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(out)


class Index:
    """Seeds of a block of benchmark items, sorted by hash for each mask."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.tables = []
        by_item = [masks_of(len(w)) for w in self.words]
        for mask in dict.fromkeys([*MASKS, *(m for own in by_item for m in own)]):
            found = [seeds(w, mask) if mask in own else w[:0] for w, own in zip(self.words, by_item)]
            hash_ = np.concatenate(found) if found else np.zeros(0, np.uint64)
            item = np.repeat(np.arange(len(found)), [len(f) for f in found])
            place = np.concatenate([np.arange(len(f)) for f in found]) if found else item
            order = np.argsort(hash_, kind="stable")
            may = np.zeros(1 << _FILTER_BITS, bool)
            may[hash_ >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables.append((mask, may, hash_[order], item[order], place[order]))

    def alignments(self, words: np.ndarray) -> np.ndarray:
        """Distinct (item, shift) pairs with a seed in common: item word p stands at document word p + shift."""
        found = []
        for mask, may, hash_, item, place in self.tables:
            own = seeds(words, mask)
            at = np.flatnonzero(may[own >> np.uint64(64 - _FILTER_BITS)])
            low, high = np.searchsorted(hash_, own[at], "left"), np.searchsorted(hash_, own[at], "right")
            n = high - low
            if n.any():
                pick = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                found.append(np.stack([item[pick], np.repeat(at, n) - place[pick]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def leaks(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, first word, agreeing words, compared words) of each leaked item, at its best place."""
        best: dict[int, tuple[int, int, int]] = {}
        for k, shift in self.alignments(words).tolist():
            item = self.words[k]
            low, high = max(0, -shift), min(len(item), len(words) - shift)
            run = min(RUN, len(item))
            if high - low < run:
                continue
            same = item[low:high] == words[low + shift : high + shift]
            sums = np.concatenate(([0], np.cumsum(same)))
            if (sums[run:] - sums[:-run]).max() >= np.ceil(AGREE * run):
                total = int(sums[-1])
                if k not in best or (total, -shift) > (best[k][1], -best[k][0] + low):
                    best[k] = low + shift, total, high - low
        return [(self.ids[k], *v) for k, v in sorted(best.items())]

    def any_leak(self, words: np.ndarray) -> bool:
        return bool(self.leaks(words))


def index_blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over the whole benchmark, each of at most ``BLOCK_WORDS`` words (or one item)."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct().toLocalIterator():
        words = hashes(row.text)
        if len(words):
            if held and size + len(words) > BLOCK_WORDS:
                yield Index(held)
                held, size = [], 0
            held.append((row.item_id, words))
            size += len(words)
    yield Index(held)


def _index(shared) -> Index:
    """The index, built once in each Python worker."""
    name, items = shared.value
    return held(name, lambda: Index(items))


def _share(docs: DataFrame, index: Index):
    # At most BLOCK_WORDS hashes: 16 MB.
    return docs.sparkSession.sparkContext.broadcast((uuid4().hex, list(zip(index.ids, index.words))))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that leaks into it.

    doc_id, item_id, first_word (where the item's compared part starts in the document),
    n_agree, n_compared: at the place of most agreeing words, the first of equals. Clean
    documents, null and empty texts give no row; repeated documents give each of their rows;
    other columns than doc_id and text are not read.
    """

    def find(shared):
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _index(shared)
            for part in batches:
                rows = [(d, *hit) for d, t in zip(part.doc_id, part.text) for hit in index.leaks(hashes(t))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "n_agree", "n_compared"])

        return scan

    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = None
    for index in index_blocks(benchmark):
        found = own.mapInPandas(find(_share(docs, index)), "doc_id string, item_id long, first_word int, n_agree int, n_compared int")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _leaks(docs: DataFrame, index: Index) -> Column:
    """A boolean over ``text``, never null: does an item of this block leak into it?"""
    shared = _share(docs, index)

    @F.pandas_udf("boolean")
    def leak(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _index(shared)
        for texts in batches:
            yield pd.Series([own.any_leak(hashes(t)) for t in texts], dtype=bool)

    return leak(F.col("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no benchmark item leaks, with all their columns, whatever their names.

    Null and empty texts stay, and so do repeats of what stays; without items all stay. Each
    block of items after the first is a pass of its own, so that a worker holds one index.
    """
    kept = None
    for index in index_blocks(benchmark):
        kept = docs if kept is None else stored(kept)
        kept = kept.filter(~_leaks(kept, index))
    return kept


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """:func:`contaminated`, over all documents and items."""
    return contaminated(docs, benchmark)
