"""Token-id files of fixed-width bit packing.

Every id takes the minimum number of bits for the vocabulary, little end first. Ids are
grouped in blocks of ``BLOCK``; a table of block offsets and a table of documents stand
before the packed ids, so any run of ids is read by unpacking only its blocks, with
numpy. A corpus is a table of such files, in ascending doc_id order, each of about
``FILE_IDS`` ids; documents stay whole. Spark writes and reads the table, so it may lie
in any store and survives lost executors.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsplit.llm import worker
from kinsplit.plans.scratch import stored

MAGIC, BLOCK, FILE_IDS, END_ID = b"KBP1", 4096, 1 << 20, 1
CACHE_BYTES = 128 << 20
_HEAD = struct.Struct("<4sBIQII")  # magic, bits, block size, ids, blocks, documents
_DOC = np.dtype([("doc_id", "<i8"), ("null", "?"), ("start", "<i8"), ("n", "<i8")])


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a string of ``bits`` bits each, padded with zero bits to whole bytes."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def write_file(docs: list[tuple[int | None, np.ndarray]], bits: int) -> bytes:
    """One file with the ids of these documents, in this order."""
    sizes = np.array([len(x) for _, x in docs], np.int64)
    index = np.zeros(len(docs), _DOC)
    index["doc_id"] = [d or 0 for d, _ in docs]
    index["null"] = [d is None for d, _ in docs]
    index["start"], index["n"] = np.cumsum(sizes) - sizes, sizes
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    blocks = [pack(ids[at : at + BLOCK], bits) for at in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return _HEAD.pack(MAGIC, bits, BLOCK, len(ids), len(blocks), len(docs)) + offsets.tobytes() + index.tobytes() + b"".join(blocks)


class Reader:
    """Random access to one file."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.n_ids, n_blocks, n_docs = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        at = _HEAD.size
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        at += 8 * (n_blocks + 1)
        self.docs = np.frombuffer(data, _DOC, n_docs, at)
        self.payload = memoryview(data)[at + _DOC.itemsize * n_docs :]
        if len(self.payload) != self.offsets[-1]:
            raise ValueError("the file ends early")

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count``, from the blocks that hold them."""
        stop = min(start + count, self.n_ids)
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        held = min((last + 1) * self.block, self.n_ids) - first * self.block
        # Full blocks end on whole bytes, as their size is a multiple of 8.
        own = unpack(self.payload[self.offsets[first] : self.offsets[last + 1]], self.bits, held)
        return own[start - first * self.block : stop - first * self.block]


#: The rules of a tokenizer file under which a text may be encoded word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# Latin letters that are their own NFC and lower to one letter, digits, and signs but the apostrophe, which begins contractions.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_SIGNS = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}0-9{_SIGNS}]+")
_PIECES = re.compile(f"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+")
#: Byte-level vocabularies write a byte as the character of its number where that prints, the others from 256 on.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}


class WordCodec:
    """Ids of texts by the tokenizers library, asked once for each word as long as a cache holds it.

    Under ``NORMALIZER`` and ``SPLITTER`` no token spans ASCII white space, nor a run of
    letters, a digit and a run of signs that meet; so texts are split there, and the model
    is asked for the pieces of words that are plain. Other words, as those with an
    apostrophe or with the string of an added token, are encoded whole. With other rules
    every text is.

    With ``literal`` the strings of special tokens in a text are ordinary text; without
    it they are these tokens, as by the library's default.
    """

    def __init__(self, path: str, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        added = [t["content"].lower() for t in rules.get("added_tokens") or []]
        model = rules["model"]
        self.by_word = (
            (rules["normalizer"], rules["pre_tokenizer"], model["type"], model.get("dropout")) == (NORMALIZER, SPLITTER, "BPE", None)
            and all(_PLAIN.fullmatch(t) for t in added)
            and not any(t[k] for t in rules.get("added_tokens") or [] for k in ("normalized", "single_word", "lstrip", "rstrip"))
        )
        self.added = [] if literal else added
        self.tokenize = self.tokenizer.model.tokenize
        size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.bits = width(size)
        self.spelled = [i.to_bytes(4, "little") for i in range(size)]
        self.words = worker.Cache(CACHE_BYTES)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return b"".join([self.spelled[t.id] for t in self.tokenize(piece)])

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone
            ids = b"".join([self.spelled[t.id] for t in self.tokenize(word.lower().decode())])
        else:
            text = word.decode()
            if not _PLAIN.fullmatch(text) or self.added and any(t in text.lower() for t in self.added):
                ids = self._whole(text)
            else:
                ids = b"".join([self._piece(p.lower()) for p in _PIECES.findall(text)])
        return self.words.keep(word, ids)

    def encode(self, texts) -> list[np.ndarray]:
        get, word, end = self.words.get, self._word, array("I", [END_ID]).tobytes()
        out = []
        for text in texts:
            raw = (text or "").encode("utf-8", "replace")
            ids = b"".join([get(w) or word(w) for w in raw.split()]) if self.by_word else self._whole(raw.decode())
            out.append(np.frombuffer(ids + end, "<u4"))
        return out


def _codec(path: str) -> WordCodec:
    return worker.held(path, lambda: WordCodec(path, literal=False))


def to_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (shard, piece, before, n_ids, data): packed files in ascending doc_id order.

    Texts are dealt by ranges of (doc_id, hash of the text), so that repeated ids split
    too, and sorted within; a null text is empty, a null id comes first. ``before`` counts
    the ids of a shard's earlier files.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, shard, piece = _codec(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = before = 0

        def file() -> pd.DataFrame:
            return pd.DataFrame([(shard, piece, before, size, write_file(held, codec.bits))], columns=["shard", "piece", "before", "n_ids", "data"])

        for part in batches:
            for at in range(0, len(part), 500):
                some = part.iloc[at : at + 500]
                for doc_id, ids in zip(some.doc_id, codec.encode(some.text)):
                    held.append((None if pd.isna(doc_id) else int(doc_id), ids))
                    size += len(ids)
                    if size >= FILE_IDS:
                        yield file()
                        held, size, before, piece = [], 0, before + size, piece + 1
        if held:
            yield file()

    # Ids above 2**53 would not survive pandas' floats, which columns with nulls become.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    dealt = keyed.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
    return dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(write, "shard int, piece int, before long, n_ids long, data binary")


def from_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of its ids for every document in the files."""
    # One row for each partition that was written, whatever its number of files.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    first = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for shard, before, data in zip(part.shard, part.before, part.data):
                own = Reader(data)
                rows = [(shard, None if d["null"] else str(d["doc_id"]), before + int(d["start"]), int(d["n"]), zlib.crc32(own.ids(int(d["start"]), int(d["n"])).astype("<u4").tobytes())) for d in own.docs]
                yield pd.DataFrame(rows, columns=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    found = files.select("shard", "before", "data").mapInPandas(read, "shard int, doc_id string, start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(first), "shard").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op8(docs: DataFrame, tokenizer: str) -> DataFrame:
    return from_files(stored(to_files(docs.select("doc_id", "text"), tokenizer)))
