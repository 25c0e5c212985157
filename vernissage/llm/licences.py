"""Licence notices found by a trained paragraph classifier and confirmed by templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vernissage.llm.common import carried, named, tidy, whole

RESULTS = ["n_paragraphs", "licences", "spans"]
# Licence families and wordings of their short notices.
TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY": ["Licensed under CC BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
            "This work is released under CC0 1.0 Universal."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
UNKNOWN = "unknown"
_WORD = re.compile(r"[^\W_]+")
#: Known n-grams at most so many words apart belong to one stretch, which is classified with as many words around.
_APART, _AROUND = 12, 4


def tokens(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(words: list[str]) -> list[tuple[str, ...]]:
    """Pairs and triples of neighbouring words."""
    return [*zip(words, words[1:]), *zip(words, words[1:], words[2:])]


@dataclass(frozen=True)
class LicenceModel:
    """Sparse weights per word n-gram for each family and the unknown class, and the temperature of its probabilities."""

    families: list[str]
    features: dict[tuple[str, ...], int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def probabilities(model: tuple, words: list[str]) -> np.ndarray:
    """Of every family and, last, of the unknown class; ``model`` holds the values of a ``LicenceModel`` in order."""
    _, features, weights, bias, temperature = model
    found = grams(words)
    hits = [i for g in found if (i := features.get(g)) is not None]
    score = weights[hits].sum(axis=0) / np.sqrt(max(1, len(found))) + bias
    score = np.exp((score - score.max()) / temperature)
    return score / score.sum()


def stretches(words: list[str], pairs: frozenset) -> list[tuple[int, int]]:
    """The parts of a paragraph that known pairs of words stand in, with a few words around."""
    hits, out = [i for i, pair in enumerate(zip(words, words[1:])) if pair in pairs], []
    for i in hits:
        if out and i - out[-1][1] <= _APART:
            out[-1][1] = i + 2
        else:
            out.append([i, i + 2])
    return [(max(0, a - _AROUND), min(len(words), b + _AROUND)) for a, b in out]


def best_template(words: list[str], templates: list[list[str]]) -> tuple[float, int, int]:
    """How much of a template stands in a row in the paragraph, at best, and from which word to which."""
    best = (0.0, 0, 0)
    places: dict[str, list[int]] = {}
    for i, word in enumerate(words):
        places.setdefault(word, []).append(i)
    for template in templates:
        need, size = set(grams(template)) or {tuple(template)}, len(template)
        starts = sorted({max(0, i - k) for k, word in enumerate(template[:3]) for i in places.get(word, [])})
        for start in starts:
            window = words[start : start + size]
            share = len(need & (set(grams(window)) or {tuple(window)})) / len(need)
            if share > best[0]:
                best = (share, start, start + len(window))
    return best


def fit_licences(docs: DataFrame, text_col: str = "text", most_paragraphs: int = 4000, copies: int = 60, seed: int = 5) -> LicenceModel:
    """A classifier from varied templates and, as unknown, at most ``most_paragraphs`` paragraphs of ``docs``.

    The paragraphs are lines of 10 to 2,000 characters, drawn by hash of their text; those that contain a template are
    left out. A third of all examples is kept apart to set the temperature at which the probabilities, the unknown class
    included, fit best.
    """
    lines = docs.select(F.explode(F.split(whole(text_col), "\n")).alias("line")).filter(F.length("line").between(10, 2000))
    lines = lines.withColumn("draw", F.xxhash64(F.lit("licences"), "line"))
    # only lines with low hashes are sorted: a few times as many as are drawn, by a count of all
    total, times = lines.count(), 4
    while True:
        bar = min(1 << 63, -(1 << 63) + int(2**64 * min(1.0, times * most_paragraphs / max(1, total))))
        low = lines if bar == 1 << 63 else lines.filter(F.col("draw") < bar)
        drawn = low.orderBy("draw", "line").limit(most_paragraphs).select("line").collect()  # bounded by most_paragraphs
        if len(drawn) == most_paragraphs or bar == 1 << 63:
            break
        times *= 4
    plain = [tokens(r["line"]) for r in drawn]
    rng, families = np.random.default_rng(seed), sorted(TEMPLATES)
    own = {f: [tokens(t) for t in TEMPLATES[f]] for f in families}
    plain = [w for w in plain if w and max(best_template(w, own[f])[0] for f in families) < 0.8]
    fill = [w for words in plain[:500] for w in words] or ["and", "the", "of"]

    examples: list[tuple[list[str], int]] = [(words, len(families)) for words in plain]
    for label, family in enumerate(families):
        for _ in range(copies):
            words = list(own[family][rng.integers(len(own[family]))])
            if rng.random() < 0.5:  # lose a word
                words.pop(rng.integers(len(words)))
            around = [[fill[rng.integers(len(fill))] for _ in range(rng.integers(0, 12))] for _ in range(2)]
            examples.append(([*around[0], *words, *around[1]], label))
    # parts of notices that name no family are unknown
    for _ in range(copies * 4):
        words = own[families[rng.integers(len(families))]][0]
        size = max(2, int(len(words) * rng.uniform(0.2, 0.5)))
        examples.append((words[:size], len(families)))

    vocabulary = sorted({g for f in families for words in own[f] for g in grams(words)})
    features = {g: i for i, g in enumerate(vocabulary)}
    x, y = np.zeros((len(examples), len(features)), np.float32), np.array([label for _, label in examples])
    for i, (words, _) in enumerate(examples):
        found = grams(words)
        for g in found:
            if g in features:
                x[i, features[g]] += 1 / np.sqrt(len(found))
    hold = rng.random(len(y)) < 1 / 3
    weights, bias = np.zeros((len(features), len(families) + 1), np.float32), np.zeros(len(families) + 1, np.float32)
    goal, balance = np.eye(len(families) + 1, dtype=np.float32)[y], len(y) / (len(families) + 1) / np.bincount(y, minlength=len(families) + 1)
    cost = np.sqrt(balance[y])[:, None] * ~hold[:, None]
    squares = [np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)]
    for _ in range(300):  # gradient descent with a step size per weight
        score = x @ weights + bias
        p = np.exp(score - score.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - goal) * cost / cost.sum()
        for value, step, square in ((weights, x.T @ error + 1e-6 * weights, squares[0]), (bias, error.sum(axis=0), squares[1])):
            square += step * step
            value -= 0.3 * step / np.sqrt(square)
    score, temperatures = x[hold] @ weights + bias, np.geomspace(0.2, 5, 40)

    def loss(t: float) -> float:
        z = score / t - (score / t).max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), y[hold]]).mean())

    return LicenceModel(families, features, weights, bias, float(min(temperatures, key=loss)) if hold.any() else 1.0)


def scan_licences(
    docs: DataFrame, model: LicenceModel, text_col: str = "text", carry: list[str] | None = None, least: float = 0.5, confirm: float = 0.8
) -> DataFrame:
    """The ``carry`` columns (default all) with ``n_paragraphs`` (lines), ``licences`` (sorted families) and ``spans``.

    Lines without a blank one between them are read as one block, so that notices may be wrapped. Stretches of a block in
    which n-grams of the templates stand are classified by their word n-grams. Then the templates are compared, family by
    family in the order of its probability: one must stand there with at least the share ``confirm`` of its n-grams, and
    the part found must have its family as the likeliest, by ``least`` at least. A stretch may name several licences: the
    part found is taken out and the rest is looked at again. ``spans`` holds ``family, paragraph, probability`` of each
    find, the paragraph being the line it starts in.

    A null text counts as one empty paragraph. Repeated rows repeat their result. An empty table gives an empty result.
    Columns of ``docs`` named like a result column are replaced by it.
    """
    keep = carried(docs, carry, RESULTS)
    row = F.struct(F.lit(0).alias("_"), *[named(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row")
    rows = docs.select(row, whole(text_col).alias("text"))
    own = {f: [tokens(t) for t in TEMPLATES[f]] for f in model.families}
    pairs = frozenset(g for g in model.features if len(g) == 2)
    plain = (model.families, model.features, model.weights, model.bias, model.temperature)
    shared = docs.sparkSession.sparkContext.broadcast(plain)  # built-in types and arrays: executors need no package

    def finds(words: list[str], model: tuple) -> Iterator[tuple[str, int, float]]:
        """Families in a block of words, with the word where each starts."""
        open_parts = stretches(words, pairs)
        while open_parts:
            low, high = open_parts.pop()
            part = words[low:high]
            chance = probabilities(model, part)[:-1]
            for best in np.argsort(-chance, kind="stable").tolist():
                share, start, stop = best_template(part, own[model[0][best]])
                if share < confirm:
                    continue
                inside = probabilities(model, part[start:stop])[:-1]
                if int(inside.argmax()) == best and max(inside[best], chance[best]) >= least:
                    yield model[0][best], low + start, float(max(inside[best], chance[best]))
                    for a, b in ((low, low + start), (low + stop, high)):
                        open_parts += [(a + x, a + y) for x, y in stretches(words[a:b], pairs)]
                    break

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            sizes, names, spans = [], [], []
            for text in batch.column(1):
                lines, found, words, starts = text.as_py().split("\n"), [], [], []
                for number, line in enumerate([*lines, ""]):
                    if fresh := tokens(line):
                        starts += [number] * len(fresh)
                        words += fresh
                    if words and not line.strip():  # a blank line ends a block
                        if not pairs.isdisjoint(zip(words, words[1:])):
                            found += [(family, starts[at], p) for family, at, p in finds(words, model)]
                        words, starts = [], []
                found.sort(key=lambda f: (f[1], f[0]))
                sizes.append(len(lines))
                names.append(sorted({f for f, _, _ in found}))
                spans.append([dict(zip(("family", "paragraph", "probability"), f)) for f in found])
            kind = pa.list_(pa.struct([("family", pa.string()), ("paragraph", pa.int64()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, kind)], ["row", *RESULTS]
            )

    schema = f"row {dict(rows.dtypes)['row']}, n_paragraphs bigint, licences array<string>, "
    found = rows.mapInArrow(run, schema + "spans array<struct<family: string, paragraph: bigint, probability: double>>")
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], *RESULTS)
