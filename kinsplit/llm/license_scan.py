"""Licence scan: a trained paragraph classifier over sparse word n-grams.

Softmax regression on words, pairs and triples of words, trained in numpy on the driver
from variations of licence notices and from ordinary paragraphs, tells licences from
other text and names their family. A family is ruled out where none of its own terms
occurs: n-grams that stand in its templates and in no other family's. What is a licence
but names no family with enough probability, or none whose nearest template is close
enough, is ``unknown``. Both limits are calibrated on families held out as a whole:
models that never saw them must call their notices unknown.

A paragraph ends at an empty line, or where a line ends a sentence; other line ends are
wrapped lines within it.

Scanning is native and row by row, without a join or a shuffle: a paragraph's n-grams
are looked up once in a literal map, and higher-order functions sum their weights and
count their templates. Map, weights and templates are a few thousand entries, fixed by
the notices below. A paragraph without any word of these is dropped early.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, UNKNOWN = "none", "unknown"
VARIATIONS, SAMPLE_PARAGRAPHS = 60, 2000
#: Notices of families that were held out, each so often, may be given a name in this share of cases at most.
FALSE_NAMES, HELD_OUT_PARTS, TRIALS = 0.05, 4, 6
STEPS, BUCKETS = 150, 4096

#: Short notices by which works name their licence, and its title and openings of its text.
NOTICES = {
    "AGPL-3.0": ["GNU Affero General Public License, Version 3, 19 November 2007", "This program is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache-2.0": ["Apache License, Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["The BSD License", "Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": ["Creative Commons Attribution 4.0", "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0", "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0", "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0": ["Creative Commons CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL": ["GNU General Public License, Version 2, June 1991", "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "Licensed under the GNU GPL v2.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL": ["GNU Lesser General Public License, Version 2.1, February 1999", "Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "MIT": ["The MIT License", "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.", "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."],
    UNKNOWN: ["Licensed under the terms of the license agreement.", "This work is released under a license of its own; see the license for the terms of use.", "Use is subject to license terms.", "Licensed for use under the community license, version 1.", "You may copy and distribute this work under the terms of the following license."],
    NONE: ["He lost his driving license in the city last year.", "The version of the story in the book is free of errors.", "The public may visit the museum and its source rooms.", "Terms of the agreement between the two parties were not published.", "She wrote software under pressure and without any help.", "A general rule of copying by hand is to work slowly.", "The library is open to the public and free of charge.", "It is a common form of work in the creative arts."],
}
#: Words too common to identify anything on their own.
STOP = "a an and any are as at be by can for from has he her his if in is it its may not of on one or out she that the their this to was were which with you your".split()
FAMILIES = [c for c in NOTICES if c not in (NONE, UNKNOWN)]
_WORD_BREAK = "[^a-z0-9]+"
#: An empty line, or the end of a line that ends a sentence.
_PARAGRAPH_BREAK = r"\n[ \t\r]*(?=\n)|(?<=[.!?:])[\"')\]]{0,3}[ \t\r]{0,3}\n"


def tokens(paragraph: str) -> list[str]:
    """The words that the Spark side sees (ASCII letters and digits, lower case)."""
    out, word = [], ""
    for c in paragraph.lower() + " ":
        if c in "abcdefghijklmnopqrstuvwxyz0123456789":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def grams(words: list[str]) -> set[str]:
    """Distinct n-grams up to three words that have a telling word."""
    tells = [telling(w) for w in words]
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1) if any(tells[i : i + n])}


def telling(word: str) -> bool:
    """Neither a stop word nor a number nor a single letter."""
    return len(word) > 1 and not word.isdigit() and word not in STOP


@dataclass
class Model:
    """``weights`` has a row for each of ``grams`` and a column for each of ``classes``.

    ``templates``: (family, n-grams); ``own``: the family that a gram is a term of, by itself.
    """

    classes: list[str]
    grams: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[tuple[str, set[str]]]
    own: dict[str, str]
    least: float = 0.5
    near: float = 0.5

    @cached_property
    def place(self) -> dict[str, int]:
        return {g: i for i, g in enumerate(self.grams)}


def _variation(words: list[str], rng: random.Random, filler: list[str]) -> list[str]:
    """A notice with words lost, cut short or set among other words."""
    if len(words) > 12 and rng.random() < 0.5:
        at = rng.randrange(len(words) - 10)
        words = words[at : at + rng.randint(10, len(words))]
    out = [w for w in words if rng.random() > 0.08]
    around = rng.choice((0, 0, 3, 12))
    return rng.choices(filler, k=rng.randint(0, around)) + out + rng.choices(filler, k=rng.randint(0, around))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit(examples: list[tuple[set[str], str]], families: list[str]) -> Model:
    """Softmax regression on bags of n-grams; every fourth example sets the temperature."""
    templates = [(c, grams(tokens(t))) for c in families for t in NOTICES[c]]
    holders: dict[str, set[str]] = {}
    for c, own in templates:
        for g in own:
            holders.setdefault(g, set()).add(c)
    shared = {g for t in NOTICES[UNKNOWN] + NOTICES[NONE] for g in grams(tokens(t))}
    own = {g: next(iter(cs)) for g, cs in holders.items() if len(cs) == 1 and g not in shared}
    known = sorted(set(holders) | shared)
    place = {g: i for i, g in enumerate(known)}
    classes = sorted([*families, NONE, UNKNOWN])
    x = np.zeros((len(examples), len(known)), np.float32)
    for row, (bag, _) in zip(x, examples):
        at = [place[g] for g in bag if g in place]
        row[at] = 1 / math.sqrt(len(at) or 1)
    y = np.array([classes.index(c) for _, c in examples])
    held = np.arange(len(y)) % 4 == 3
    inner, goal = x[~held], np.eye(len(classes), dtype=np.float32)[y[~held]]
    per_class = goal.sum(0).clip(1)
    per_class[classes.index(NONE)] /= len(classes)  # as much as all licences together
    share = (1 / per_class[y[~held]])[:, None].astype(np.float32)
    share /= share.sum()
    weights, bias = np.zeros((len(known), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    step_w, step_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(STEPS):  # gradient descent with momentum
        error = (_softmax(inner @ weights + bias) - goal) * share
        step_w = 0.9 * step_w - 6 * (inner.T @ error + 1e-4 * weights)
        step_b = 0.9 * step_b - 6 * error.sum(0)
        weights, bias = weights + step_w, bias + step_b
    logits = x[held] @ weights + bias
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(held.sum()), y[held]] + 1e-9).mean()
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0), key=loss) if held.any() else 1.0
    return Model(classes, known, weights.astype(float).round(6), bias.astype(float).round(6), temperature, templates, own)


def classify(words: list[str], model: Model) -> tuple[str, float, float] | None:
    """Family, probability and similarity of a paragraph; None if it is no licence.

    The same in plain Python as :func:`scan` does; the calibration uses it.
    """
    bag = grams(words)
    ids = [model.place[g] for g in bag if g in model.place]
    if not ids:
        return None
    z = (model.weights[ids].sum(0) / math.sqrt(len(ids)) + model.bias) / model.temperature
    odds = np.exp(z - z.max())
    if odds[model.classes.index(NONE)] / odds.sum() > 0.5:
        return None
    named = {model.own[g] for g in bag if g in model.own}
    left = {c: float(odds[k]) for k, c in enumerate(model.classes) if c in named or c in (NONE, UNKNOWN)}
    best = max(sorted(named), key=lambda c: left[c], default=UNKNOWN)
    probability = left[best] / max(sum(left.values()), 1e-300)
    near = max((len(bag & t) / min(len(t), len(bag)) for c, t in model.templates if c == best), default=0.0)
    sure = best != UNKNOWN and probability >= model.least and near >= model.near
    return best if sure else UNKNOWN, probability, near


def held_out_families(plain: list[list[str]], seed: int = 0) -> list[tuple[str, str | None, float, float]]:
    """(family, what it was called, probability, similarity) of variations of every notice.

    Each quarter of the families is held out in turn: the model never saw them, so their
    notices should be called unknown, and those of the others by their names. No threshold
    is applied yet.
    """
    out = []
    for part in range(HELD_OUT_PARTS):
        rng = random.Random(seed + part)
        away = FAMILIES[part::HELD_OUT_PARTS]
        families = [c for c in FAMILIES if c not in away]
        model = _fit(_examples(plain, families, rng, VARIATIONS // 4), families)
        model.least = model.near = 0.0
        filler = _filler(plain)
        for c in FAMILIES:
            for t in NOTICES[c]:
                for k in range(TRIALS):
                    found = classify(_variation(tokens(t), rng, filler) if k else tokens(t), model)
                    out.append((UNKNOWN if c in away else c, *(found or (None, 0.0, 0.0))))
    return out


def _filler(plain: list[list[str]]) -> list[str]:
    return sorted({w for words in plain for w in words}) or ["lorem", "ipsum", "dolor"]


def _examples(plain: list[list[str]], families: list[str], rng: random.Random, variations: int) -> list[tuple[set[str], str]]:
    filler = _filler(plain)
    out = [(grams(_variation(tokens(t), rng, filler) if i else tokens(t)), c) for c in (*families, UNKNOWN, NONE) for t in NOTICES[c] for i in range(variations)]
    out += [(grams(w), NONE) for w in plain]
    rng.shuffle(out)
    return out


def train(paragraphs: list[str], seed: int = 0) -> Model:
    """Fit on all families, with the least probability that held-out families call for.

    ``paragraphs`` are texts of the corpus, most of them no licences; those that come near
    a template are not used as examples of ``none``.
    """
    known = [grams(tokens(t)) for c in (*FAMILIES, UNKNOWN) for t in NOTICES[c]]
    plain = []
    for p in paragraphs:
        bag = grams(own := tokens(p))
        if own and not any(len(bag & g) >= 0.3 * len(g) for g in known):
            plain.append(own)
    model = _fit(_examples(plain, FAMILIES, random.Random(seed), VARIATIONS), FAMILIES)
    model.least, model.near = _thresholds(held_out_families(plain, seed))
    return model


def _thresholds(trials: list[tuple[str, str | None, float, float]]) -> tuple[float, float]:
    """The least probability and similarity for a name: of those that keep false names of held-out
    families within ``FALSE_NAMES`` (or lowest), the pair by which most others get theirs."""
    family, found = np.array([t[0] for t in trials]), np.array([t[1] or NONE for t in trials])
    p, near = np.array([t[2] for t in trials]), np.array([t[3] for t in trials])
    strange, given = family == UNKNOWN, ~np.isin(found, (NONE, UNKNOWN))
    best = None
    for least in np.arange(6, 20) / 20:
        for close in np.arange(8, 20) / 20:
            named = given & (p >= least) & (near >= close)
            wrong = max((named & strange).sum() / max(1, strange.sum()), FALSE_NAMES)
            key = (-wrong, (named & (found == family)).sum(), -least, -close)
            best = max(best or (key, least, close), (key, least, close))
    return float(best[1]), float(best[2])


def words_of(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), _WORD_BREAK), lambda w: w != "")


def _grams_of(words: Column) -> Column:
    """Distinct n-grams with a telling word."""

    def tells(w: Column) -> Column:
        return (F.length(w) > 1) & ~w.rlike("^[0-9]+$") & ~w.isin(STOP)

    def run(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        held = F.transform(starts, lambda i: F.when(F.exists(F.slice(words, i, n), tells), F.array_join(F.slice(words, i, n), " ")))
        return F.when(F.size(words) >= n, F.array_compact(held)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(run(1), run(2), run(3)))


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _once(name: str, value: Column) -> Column:
    """A column that is computed once, however often what follows names it."""
    return F.explode(F.array(value)).alias(name)


def fit_on(docs: DataFrame) -> Model:
    """Train with ordinary paragraphs from a bounded sample: ``SAMPLE_PARAGRAPHS`` of least hash.

    Paragraphs of any length count. The hashes alone are ranked first, so that no task sends
    more than these.
    """
    hashed = docs.select(F.explode(paragraphs_of(F.col("text"))).alias("p")).select("p", F.xxhash64("p", F.lit(1)).alias("h"))
    least = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_PARAGRAPHS).agg(F.max("h")).first()[0]
    if least is None:
        return train([])
    rows = hashed.filter(F.col("h") <= least).groupBy("h").agg(F.min("p").alias("p")).limit(SAMPLE_PARAGRAPHS).collect()
    return train([r.p for r in sorted(rows, key=lambda r: (r.h, r.p))])


def paragraphs_of(text: Column) -> Column:
    return F.split(text, _PARAGRAPH_BREAK)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each paragraph that is a licence: doc_id, paragraph, family, probability,
    similarity, confirmed, n_words.

    Paragraphs are counted from 0. ``similarity`` is the share of telling n-grams that the
    paragraph and its nearest template of the best family have in common, of the smaller of
    the two; ``confirmed`` says that similarity and probability are at least the calibrated
    ones (``Model.near``, ``Model.least``); else the family is ``unknown``. Null and empty texts have no paragraph;
    repeated rows each give their own; a null doc_id stays null; of equal families the first
    by name is taken; other columns than doc_id and text are not read.
    """
    classes = model.classes
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for g, i in model.place.items():
        buckets[crc32(g.encode()) % BUCKETS][g] = i
    lookup = _constant(buckets, "array<map<string,int>>")
    # A row of weights for each gram, and the numbers of the class it is a term of (else -1) and of its templates.
    weights = _constant(model.weights.tolist(), "array<array<double>>")
    own = _constant([classes.index(model.own[g]) if g in model.own else -1 for g in model.grams], "array<int>")
    members = _constant([[k for k, (_, t) in enumerate(model.templates) if g in t] for g in model.grams], "array<array<int>>")
    of_class = _constant([[k for k, (c, _) in enumerate(model.templates) if c == name] for name in classes], "array<array<int>>")
    sizes = _constant([len(t) for _, t in model.templates], "array<int>")
    names, none, unknown = _constant(classes, "array<string>"), classes.index(NONE), classes.index(UNKNOWN)
    content = sorted({w for g in model.grams for w in g.split() if telling(w)})

    whole = docs.select("doc_id", F.posexplode(paragraphs_of(F.col("text"))).alias("paragraph", "p"))
    read = whole.select("doc_id", "paragraph", F.explode(F.filter(F.array(words_of(F.col("p"))), lambda ws: F.exists(ws, lambda w: w.isin(content)))).alias("words"))
    counted = read.select("doc_id", "paragraph", F.size("words").alias("n_words"), _once("grams", _grams_of(F.col("words"))))
    place_of = lambda g: F.try_element_at(F.get(lookup, (F.crc32(g.cast("binary")) % BUCKETS).cast("int")), g)
    found = counted.select("doc_id", "paragraph", "n_words", F.size("grams").alias("n_grams"), _once("ids", F.array_compact(F.transform("grams", place_of))))
    # A bag's weights are scaled by the root of its number of known n-grams, as in training.
    total = F.aggregate("ids", _constant([0.0] * len(classes), "array<double>"), lambda sums, i: F.zip_with(sums, F.get(weights, i), lambda a, b: a + b))
    z = F.zip_with(total, _constant(model.bias.tolist(), "array<double>"), lambda s, b: (s / F.sqrt(F.size("ids")) + b) / model.temperature)
    scored = found.filter(F.size("ids") > 0).select("doc_id", "paragraph", "n_words", "n_grams", "ids", _once("z", z))
    odds = scored.select("doc_id", "paragraph", "n_words", "n_grams", "ids", _once("odds", F.transform("z", lambda v: F.exp(v - F.array_max("z")))))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    licence = odds.select("*", F.explode(F.filter(F.array(F.get("odds", F.lit(none)) / add("odds")), lambda p: p <= 0.5)).alias("p_none"))
    named = licence.select("*", _once("named", F.array_distinct(F.filter(F.transform("ids", lambda i: F.get(own, i)), lambda c: c >= 0))))
    # The family of the highest odds; of equals the first by name, as classes are sorted.
    ranked = F.array_max(F.transform("named", lambda c: F.struct(F.get("odds", c).alias("odds"), (-c).alias("at"))))
    best = named.select("*", _once("best", F.coalesce(-ranked["at"], F.lit(unknown))))
    left = add(F.transform("named", lambda c: F.get("odds", c))) + F.get("odds", F.lit(none)) + F.get("odds", F.lit(unknown))
    flat = F.flatten(F.transform("ids", lambda i: F.get(members, i)))
    share = lambda hits: F.array_max(F.transform(F.get(of_class, F.col("best")), lambda t: F.size(F.filter(hits, lambda k: k == t)) / F.least(F.get(sizes, t), F.col("n_grams"))))
    measured = best.select("*", _once("hits", flat)).select("doc_id", "paragraph", "n_words", "best", (F.get("odds", "best") / F.greatest(left, F.lit(1e-300))).alias("probability"), F.coalesce(share(F.col("hits")), F.lit(0.0)).alias("similarity"))
    sure = (F.col("best") != unknown) & (F.col("probability") >= model.least) & (F.col("similarity") >= model.near)
    return measured.select("doc_id", "paragraph", F.when(sure, F.get(names, F.col("best"))).otherwise(UNKNOWN).alias("family"), F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), sure.alias("confirmed"), "n_words")


def op1(docs: DataFrame) -> DataFrame:
    """The scan of a corpus with a model trained on a sample of its paragraphs; an empty table has no row."""
    docs = docs.select("doc_id", "text")
    return scan(docs, fit_on(docs))
