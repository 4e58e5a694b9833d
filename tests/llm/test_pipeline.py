"""The stages of the pipeline and the whole of it, against a version in plain Python."""

import hashlib
import random
import struct
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from test_learned import leaks_by_hand, word
from test_ops import brute_components

from kinsplit.llm import bpe, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _toxicity string, score string"
STAGES = dict(corpus_pipeline.STAGES)


def rows_of():
    rng, rows, labels = random.Random(5), [], []
    items = [" ".join(word(rng) + str(rng.randint(0, 9)) for _ in range(n)) for n in (6, 15, 30)]
    for i in range(150):
        words = [word(rng) + str(rng.randint(0, 99)) for _ in range(rng.randint(15, 50))]
        if i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(["scumbag", "moronic"])
        if i % 17 == 3:
            words[4:4] = rng.choice(items).split()
        text = " ".join(words) + "."
        rows.append((i, text.replace(" ", " %%% ") if i % 4 == 3 else text))
        if i % 10:
            labels.append((i, int(i % 4 != 3), int(i % 5 == 0)))
    near = rows[1][1].split()
    rows += [(200, rows[1][1]), (201, " ".join([*near, "end"])), (202, None), (203, ""), (204, " \n"), (205, "é ü"), (2, rows[2][1]), (206, "word " * 30_000)]
    labels += [(7, 0, 0), (8, None, 1)]
    return rows, labels, list(enumerate(items))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items = rows_of()
    spark.createDataFrame([(i, t, "a", "s", len(t or ""), "own", "own") for i, t in rows], SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def order(doc_id):
    return xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest() ^ (1 << 63)


def crc(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def values(labels, column, parts, held):
    out = {}
    for row in labels:
        if row[column] is not None and crc(row[0], parts) != held:
            out.setdefault(row[0], set()).add(row[column])
    return out


def plain_toxicity(rows, labels):
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    known = {i: v for i, v in values(labels, 2, 3, 1).items() if len(v) == 1 and len(texts.get(i, ())) == 1 and None not in texts[i]}
    model = toxicity.train([(next(iter(texts[i])), next(iter(known[i]))) for i in sorted(known, key=order)])
    return [r for r, s in zip(rows, model.scorer()([t for _, t in rows])) if s < 0.7]


def plain_quality(rows, labels):
    used = values(labels, 1, 5, 0)
    present = {i for i, _ in rows}
    text = {i: t or "" for i, t in rows}
    take = lambda ids: np.array([quality.features(text[i]) for i in sorted(ids, key=order)])
    free = [(i, t) for i, t in rows if i not in used]
    x = np.array([quality.features(t) for _, t in free])
    model = quality.train(take([i for i in present if used.get(i) == {1}]), take({i for i, _ in free}), lambda m, cuts: quality._tally(m.scores(x), cuts))
    scores = model.scores(np.array([quality.features(t) for _, t in rows]))
    return [r for r, s in zip(rows, scores) if s >= 0.3]


def plain_copies(rows):
    rows = list(dict.fromkeys(rows)) + [r for k, r in enumerate(rows) if r in rows[:k] and not (r[1] or "").split()]
    named = brute_components(rows)
    first = {d for d, _, c in named if d == c}
    return [r for r in rows if r[0] in first]


def plain_leaks(rows, items):
    return [r for r in rows if not any(leaks_by_hand(r[1], t) for _, t in items)]


def plain_ids(rows):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = []
    for i, t in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        out.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def pairs(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_stages_and_run(spark, folder):
    rows, labels, items = rows_of()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, plain in (("toxicity", lambda r: plain_toxicity(r, labels)), ("quality", lambda r: plain_quality(r, labels)), ("near duplicates", plain_copies), ("decontamination", lambda r: plain_leaks(r, items))):
        kept = STAGES[name](spark, docs, folder)
        want = plain(rows)
        assert kept.columns == docs.columns and kept.schema == docs.schema
        assert pairs(kept) == sorted(want, key=str), name
        assert 20 < len(want) < len(rows) and kept.filter("_toxicity <> 'own' or score <> 'own'").count() == 0
        rows, docs = want, spark.createDataFrame(kept.collect(), docs.schema)
    want = sorted(plain_ids(rows), key=str)
    assert sorted((tuple(r) for r in STAGES["byte-level BPE"](spark, docs, folder).collect()), key=str) == want
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, folder).collect()), key=str) == want


@pytest.mark.filterwarnings("ignore:.*too few")
def test_stages_of_an_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0 and (name == "byte-level BPE" or out.columns == none.columns)


def test_nulls_in_every_column(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.unionByName(spark.createDataFrame([(None,) * 7, (None, "some words of a text without id", None, None, None, None, None)], SCHEMA))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder)
        n = out.filter(F.col("doc_id").isNull()).count()
        assert n == 2 or (name == "quality" and n <= 2), name  # so short a text may be poor
