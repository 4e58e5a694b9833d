"""Byte-level BPE: whole texts to token ids and back, with the ranks of a given file.

A text is split by the tokenizer's pattern. Each distinct word is folded on its own: its
bytes are pieces, and the adjacent pair whose union has the least rank is merged (the
leftmost of equals) until no union has a rank. Decoding concatenates the ids' pieces.

Two forms of the fold give the same ids. :func:`encode_words` is made of Spark's
higher-order functions with the ranks as a literal map (in buckets, as Spark scans a map
from its start). It needs some 0.3 ms for a word, and a corpus has millions of distinct
words, so :func:`encode` folds in Python workers with a cache of words (see README).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsplit.llm.worker import Cache, held

CACHED_LENGTH = 64
_NONE = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a rank file: lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f) if piece}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > CACHED_LENGTH:
        return _fold_long(word, ranks)
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) != _NONE:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], _NONE)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], _NONE)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and linked pieces: n log n for words of any length."""
    n = len(word)
    end = list(range(1, n + 1))  # a piece starts at i and ends at end[i]; 0 once it is merged away
    left = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            stop = end[end[i]]
            rank = ranks.get(word[i:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, i, stop))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] >= stop or end[end[i]] != stop:
            continue  # one of its halves has changed
        right = end[i]
        end[i], end[right] = stop, 0
        if stop < n:
            left[stop] = i
        offer(left[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.split = regex.compile(pattern).findall
        self.cache = Cache()

    def _word(self, word: str) -> bytes:
        ids = np.array(fold(word.encode("utf-8", "replace"), self.ranks), "<u4").tobytes()
        return self.cache.keep(word, ids) if len(word) <= CACHED_LENGTH else ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers; a null text is empty."""
        get, own = self.cache.get, self._word
        return b"".join([get(w) or own(w) for w in self.split(text or "")])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(shared) -> Codec:
    """One codec, with its cache, for all tasks of a Python worker."""
    name, ranks, pattern = shared.value
    return held(name, lambda: Codec(ranks, pattern))


def _share(docs: DataFrame, path: str, pattern: str):
    return docs.sparkSession.sparkContext.broadcast((uuid4().hex, read_ranks(path), pattern))  # a vocabulary: fixed size


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids``, the token ids of each whole text; a column of that name is replaced.

    A null or empty text has no ids; repeated rows stay; other columns pass through.
    """
    shared = _share(docs, path, pattern)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared)
        for texts in batches:
            yield pd.Series([np.frombuffer(codec.encode(t), "<i4") for t in texts])

    return docs.withColumn("ids", ids(F.col("text")))


def decode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``decoded``: the bytes of the pieces of ``ids``; null ids are none."""
    shared = _share(docs, path, "")

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared)
        for part in batches:
            yield pd.Series([codec.decode(np.asarray(() if i is None else i, "<u4").tobytes()) for i in part])

    return docs.withColumn("decoded", decoded(F.col("ids")))


def _literal_map(items, buckets: int) -> str:
    out: list[dict] = [{} for _ in range(buckets)]
    for key, value in items:
        out[zlib.crc32(key.encode()) % buckets][key] = value
    return json.dumps(out)


def encode_words(word: Column, path: str) -> Column:
    """Ids of one distinct word, by higher-order functions over its bytes and a literal rank map.

    The word's hexadecimal bytes are the first pieces; an aggregate over as many steps as
    it has bytes merges the pair of least rank. Null in, null out; an empty word has none.
    """
    size = 16384
    ranks = F.from_json(F.lit(_literal_map(((p.hex().upper(), r) for p, r in read_ranks(path).items()), size)), "array<map<string,int>>")

    def rank(piece: Column) -> Column:
        return F.coalesce(F.try_element_at(F.get(ranks, (F.crc32(piece.cast("binary")) % size).cast("int")), piece), F.lit(_NONE))

    def bind(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def step(p: Column) -> Column:
        def merge(r: Column) -> Column:
            least = F.array_min(r)
            joined = lambda i: F.concat(F.slice(p, F.lit(1), i - 1), F.array(F.concat(F.get(p, i - 1), F.get(p, i))), F.slice(p, i + 2, F.size(p)))
            return F.when(least == _NONE, p).otherwise(bind(F.array_position(r, least).cast("int"), joined))

        pairs = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: rank(F.concat(a, b)))
        return F.when(F.size(p) < 2, p).otherwise(bind(pairs, merge))

    text = F.hex(word.cast("binary"))
    n = (F.length(text) / 2).cast("int")
    first = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i * 2 - 1, F.lit(2)))
    return F.when(word == "", F.array().cast("array<int>")).otherwise(F.transform(F.aggregate(F.sequence(F.lit(1), n), first, lambda p, _: step(p)), rank))


def op5(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    shared = _share(docs, path, pattern)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared)
        for texts in batches:
            made = [codec.encode(t) for t in texts]
            yield pd.DataFrame([(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(codec.decode(i)).hexdigest()) for i in made], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest(F.col("text")).alias("_r")).select("doc_id", "_r.*")
