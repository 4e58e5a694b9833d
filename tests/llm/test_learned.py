"""Queries that learn: folds, odd labels, repeated rows, ties, nulls, long texts, empty tables; and decontamination by brute force."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsplit.llm import decontaminate, language_id, quality, toxicity

LONG = "ba neri to luka " * 60_000


def crc(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def word(rng):
    return "".join(rng.choice(["ba", "ne", "ri", "to", "lu"]) for _ in range(rng.randint(1, 4)))


def corpus(n=240, seed=1):
    """(doc_id, text, toxic, quality): every fourth text has an insult, every third is junk."""
    rng, out = random.Random(seed), []
    for i in range(n):
        words = [word(rng) for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["scumbag", "moronic", "idiots"])
        text = " ".join(words) + "."
        out.append((i, text.replace(" ", " %%% ") if i % 3 == 0 else text, int(i % 4 == 0), int(i % 3 > 0)))
    return out


def frames(spark, rows, more=()):
    docs = spark.createDataFrame([(i, t, "clash", "x") for i, t, *_ in rows] + [(*m, "clash", "x") for m in more], "doc_id long, text string, score string, predicted string")
    labels = spark.createDataFrame([(i, a, b) for i, _, a, b in rows], "doc_id long, toxic int, quality int")
    return docs, labels


ODD_ROWS = [(9000, None), (9001, ""), (9002, " \n"), (9003, LONG), (None, "ba ne ri"), (9004, "idiots"), (9004, "idiots")]


def by_id(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.doc_id, []).append((r.held_out, r.score, r.predicted))
    return out


@pytest.mark.parametrize(("op", "parts", "held", "cut"), [(toxicity.op6, 3, 1, 0.7), (quality.op2, 5, 0, 0.3)])
def test_folds_and_odd_rows(spark, op, parts, held, cut):
    rows = corpus()
    docs, labels = frames(spark, rows, ODD_ROWS)
    got = by_id(op(docs, labels))
    assert sum(map(len, got.values())) == len(rows) + len(ODD_ROWS)
    for doc_id, found in got.items():
        assert all(h == (doc_id is not None and crc(doc_id, parts) == held) and 0 <= s <= 1 and p == int(s >= cut) for h, s, p in found)
    assert len(set(got[9004])) == 1 and got[9000][0][1:] == got[9001][0][1:]
    truth = {r[0]: r[2] if op is toxicity.op6 else r[3] for r in rows}
    out = [i for i in truth if crc(i, parts) == held]
    assert np.mean([got[i][0][2] == truth[i] for i in out]) > 0.9


@pytest.mark.parametrize(("op", "parts", "held"), [(toxicity.op6, 3, 1), (quality.op2, 5, 0)])
def test_nothing_is_learned_from_held_out_labels(spark, op, parts, held):
    rows = corpus()
    docs, labels = frames(spark, rows)
    turned = frames(spark, [(i, t, 1 - a, 1 - b) if crc(i, parts) == held else (i, t, a, b) for i, t, a, b in rows])[1]
    assert by_id(op(docs, labels)) == by_id(op(docs, turned))


def test_contradicting_and_repeated_rows_change_no_toxicity(spark):
    """Contradicting labels are as none; repeated rows, shuffled over other partitions, as one."""
    rows = corpus()
    docs, labels = frames(spark, rows)
    both = labels.unionByName(labels.filter("doc_id < 30").withColumn("toxic", 1 - F.col("toxic")))
    without = labels.withColumn("toxic", F.when(F.col("doc_id") >= 30, F.col("toxic")))
    want = by_id(toxicity.op6(docs, without))
    assert by_id(toxicity.op6(docs, both)) == want
    again = by_id(toxicity.op6(docs.unionByName(docs).repartition(7), without))
    assert {i: set(x) for i, x in again.items()} == {i: set(x) for i, x in want.items()} and all(len(x) == 2 for x in again.values())


def test_repeated_rows_change_no_quality_sample(spark, monkeypatch):
    rows = corpus()
    docs, labels = frames(spark, rows)
    seen = []
    monkeypatch.setattr(quality, "train", lambda p, u, count=None, own=quality.train: seen.append((p, u)) or own(p, u, count))
    quality.fit_on(docs, labels)
    quality.fit_on(docs.unionByName(docs).repartition(5), labels)
    assert all((a == b).all() for a, b in zip(*seen))


def test_empty_tables(spark):
    docs, labels = frames(spark, corpus(30))
    none = docs.limit(0)
    assert toxicity.op6(none, labels).count() == 0 and language_id.op9(none.withColumn("lang", F.lit("a"))).count() == 0
    with pytest.warns(UserWarning, match="too few"):
        assert quality.op2(none, labels).count() == 0
    assert {r.score for r in toxicity.op6(docs, labels.limit(0)).collect()} == {0.5}
    with pytest.warns(UserWarning, match="too few"):
        assert {r.score for r in quality.op2(docs, labels.limit(0)).collect()} == {0.5}


def test_language_query(spark):
    rng = random.Random(6)
    known = {"de": "der die das und nicht ein ich werden haben schule".split(), "en": "the and that with have this from they which school".split()}
    rows = [(i, " ".join(rng.choice(known[lang]) for _ in range(40)), lang) for i, lang in enumerate(["de", "en"] * 120)]
    rows += [(5000, None, "de"), (5001, "12 34", "en"), (5002, "", None), (None, "the and that", None), (5003, "the school " * 150_000, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in language_id.op9(docs).collect()}
    for i, text, lang in rows[:240]:
        assert (got[i].lang_pred, got[i].held_out) == (lang, crc(i, 3) == 1) and 0.9 < got[i].score <= 1
    assert [got[i].lang_pred for i in (5000, 5001, 5002, None, 5003)] == ["und", "und", "und", "en", "en"]
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    again = {r.doc_id: r for r in language_id.op9(wrong.unionByName(wrong).repartition(5)).collect()}
    assert again == got


def test_one_language_is_the_best_mixture_where_em_is_skipped():
    rng = np.random.default_rng(3)
    for _ in range(60):
        words, langs = int(rng.integers(2, 60)), int(rng.integers(2, 5))
        log = rng.normal(0, 2, (words, langs))
        log[:, 0] += rng.random() * 4
        likelihood = np.exp(log - log.max(1, keepdims=True))
        penalty = 0.5 * np.log(words + 1)
        one = int(log.sum(0).argmax())
        if language_id.alone(likelihood, one, penalty):
            share = np.full(langs, 1 / langs)
            for _ in range(3000):
                part = likelihood * share
                share = (part / part.sum(1, keepdims=True)).mean(0)
            assert np.log(likelihood @ share).sum() - np.log(likelihood[:, one]).sum() < penalty


def plain_words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def leaks_by_hand(text, item):
    a, b = plain_words(item), plain_words(text)
    run = min(13, len(a))
    for shift in range(-len(a), len(b)) if a else ():
        low, high = max(0, -shift), min(len(a), len(b) - shift)
        if high - low >= run:
            same = [a[p] == b[p + shift] for p in range(low, high)]
            if any(sum(same[k : k + run]) >= math.ceil(0.8 * run) for k in range(len(same) - run + 1)):
                return True
    return False


def test_decontamination_by_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [word(rng) + str(rng.randint(0, 9)) for _ in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 9, 12, 13, 14, 20, 40])))) for k in range(40)]

    def text():
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(items)[1].split()
            cut = own[rng.randint(0, 3) :] if len(own) > 16 else own
            for k in range(len(cut)):
                if rng.random() < 0.12:
                    cut[k] = "other"
            at = rng.randint(0, len(words))
            words[at:at] = cut
        return rng.choice([" ", ", ", "\n"]).join(words)

    rows = [(i, text()) for i in range(160)] + [(500, None), (501, ""), (502, LONG), (None, items[9][1])]
    rows += rows[:4]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame([*items, (90, None), (91, ""), items[3]], "item_id long, text string")
    want = sorted(((d, k) for d, t in rows for k, item in items if leaks_by_hand(t, item)), key=str)
    assert len(want) > 100
    for block in (10**9, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        assert sorted(((r.doc_id, r.item_id) for r in decontaminate.op10(docs, bench).collect()), key=str) == want
        kept = decontaminate.decontaminate(docs, bench)
        hit = {d for d, _ in want}
        assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in rows if d not in hit), key=str)
    assert decontaminate.op10(docs.limit(0), bench).count() == 0 and decontaminate.op10(docs, bench.limit(0)).count() == 0


def test_worst_spans_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes = rng.integers(1, 9, 6)
        scores = rng.integers(-3, 4, sizes.sum()).astype(float)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        for span in (1, 2, 4):
            best, at = toxicity._worst(scores, starts, span)
            for k, (a, n) in enumerate(zip(starts, sizes)):
                means = [scores[i : i + min(span, n)].mean() for i in range(a, a + n - min(span, n) + 1)]
                assert best[k] == pytest.approx(max(means)) == pytest.approx(toxicity._worst_of(scores[a : a + n].tolist(), span)) and means[at[k] - a] == pytest.approx(max(means))


def test_evidence_of_a_phrase_adds_up():
    """Words that are harmless alone, and toxic three in a row."""
    rng = random.Random(2)
    parts = ["quite", "utterly", "hopeless"]

    def text(toxic):
        words = [word(rng) for _ in range(30)]
        if toxic:
            words[5:5] = rng.sample(parts, 3)
        else:
            for at, w in zip((3, 14, 25), rng.sample(parts, rng.choice([1, 1, 2]))):
                words.insert(at, w)
        return " ".join(words)

    model = toxicity.train([(text(i % 2), i % 2) for i in range(1200)])
    p = model.scorer()([text(i % 2) for i in range(300)])
    assert np.mean([(s >= 0.5) == (i % 2) for i, s in enumerate(p)]) > 0.85
