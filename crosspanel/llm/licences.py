"""Licence scans: a paragraph classifier trained here, with an unknown class, confirmed by comparison with templates.

Model: multinomial logistic regression on hashed word 1- to 3-grams, scaled by the square root of the paragraph's
words. Its probabilities are calibrated by one temperature on paragraphs held out of the fit, and a family counts only
from the probability on at which no held-out paragraph of the unknown class would. A prediction is confirmed if the
paragraph holds most of the word pairs of one of the family's templates. Paragraphs are all lines, and all windows of
``WINDOW`` words (step ``WINDOW`` / 2) of the text, so wrapped and unwrapped notices are both read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import LOWER, PUNCTUATION, U, prefix_hash, range_hash, runs, slices, words
from .lines import line_table
from .shared import documents, sampled

#: Notices by family (fixed values: customary short notices and telling sentences of public licences).
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "distributed under the Apache 2.0 license",
    ],
    "mit": [
        "Released under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Released under the BSD 3-Clause License",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "Released under the GNU GPL version 2",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License",
    ],
    "agpl": [
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "Licensed under the Mozilla Public License 2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Released under the ISC License",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "Released under CC0 1.0 Universal",
        "This is free and unencumbered software released into the public domain",
    ],
}
#: Sentences that speak of licences and name none (fixed values).
UNKNOWN = [
    "See the license file for details",
    "A driver's license is required to rent a car",
    "All rights reserved",
    "The license was granted by the city council in the spring",
    "This software is provided by a third party under a commercial agreement",
    "The public library is open and free of charge",
    "Fishing license version and general conditions",
    "copyright notice",
    "Released under the bridge in March",
    "The Apache helicopter was released to the public",
    "He studied at MIT before he joined the foundation",
    "Permission is required to copy this work",
]
BITS, WINDOW = 15, 64
#: Documents, and paragraphs of the unknown class from them, at most.
TRAIN_PARAGRAPHS, VARIANTS = 800, 40
#: Share of a template's word pairs that confirms a prediction.
CONFIRM = 0.6


@dataclass
class Model:
    families: list[str]  # the last is the unknown class
    weight: np.ndarray  # (2**BITS, classes) float32
    bias: np.ndarray
    temperature: float
    least: float  # calibrated probability from which on a family counts

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, starts, ends, row) per word: feature numbers of the 1-, 2- and 3-grams that start there, -1 where
    the text ends before."""
    low = LOWER[data]
    starts, ends, row = words(low, offs, PUNCTUATION)
    h = range_hash(prefix_hash(low), starts, ends)
    out = np.full((len(h), 3), -1, np.int64)
    for n in (1, 2, 3):
        if len(h) >= n:
            same = row[: len(h) - n + 1] == row[n - 1 :]
            out[: len(h) - n + 1, n - 1] = np.where(same, (runs(h, n) >> U(64 - BITS)).astype(np.int64), -1)
    return out, starts, ends, row


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, paragraph, scale) of all n-grams of all texts."""
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    f, _, _, row = grams(np.frombuffer(b"".join(raw), np.uint8), offs)
    n = np.maximum(1, np.bincount(row, minlength=len(texts)))
    keep = f >= 0
    where = np.repeat(row, 3).reshape(-1, 3)[keep]
    return f[keep], where, 1 / np.sqrt(n)


def variants(text: str, filler: list[str], n: int, rng: np.random.Generator) -> list[str]:
    """The text as it is, in other case, with words around it, with holders and years, and with a word lost."""
    out = [text, text.upper(), text.lower(), text + "."]
    while len(out) < n:
        w = text.split()
        if len(w) > 8 and rng.random() < 0.5:
            del w[int(rng.integers(len(w)))]
        some = lambda k: [filler[int(i)] for i in rng.integers(0, len(filler), int(rng.integers(0, k)))]
        if rng.random() < 0.3:
            w = ["Copyright", "(c)", str(int(rng.integers(1990, 2030))), *some(3), *w]
        out.append(" ".join([*some(6), *w, *some(6)]))
    return out


def fit(paragraphs: list[str], seed: int = 2, epochs: int = 12) -> Model:
    """Train on template variants against ``paragraphs`` (taken as unknown) and the sentences of UNKNOWN."""
    rng = np.random.default_rng(seed)
    filler = sorted({w for p in paragraphs for w in p.split()})[:5000] or ["the", "of", "and"]
    families = [*TEMPLATES, "unknown"]
    texts, y = [], []
    for k, f in enumerate(TEMPLATES):
        for t in TEMPLATES[f]:
            texts += (v := variants(t, filler, VARIANTS, rng))
            y += [k] * len(v)
    for t in UNKNOWN:
        texts += (v := variants(t, filler, VARIANTS, rng))
        y += [len(families) - 1] * len(v)
    clear = [p for p in paragraphs if not re.search(r"(?i)licen[cs]|\bCC\b|public domain", p)]
    texts += clear
    y = np.array(y + [len(families) - 1] * len(clear))
    f, at, scale = _encode(texts)
    split = np.arange(len(texts)) % 5 == 4  # held out for calibration
    order_of = np.argsort(at, kind="stable")
    f, bounds = f[order_of], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(texts)))])
    w, b = np.zeros((1 << BITS, len(families)), np.float32), np.zeros(len(families))
    grow = np.full(w.shape, 1e-6, np.float32)

    def logits(i: int) -> np.ndarray:
        return w[f[bounds[i] : bounds[i + 1]]].sum(0) * scale[i] + b

    fitted = np.flatnonzero(~split)
    for _ in range(epochs):
        for i in rng.permutation(fitted):
            z = logits(i)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            rows = np.unique(f[bounds[i] : bounds[i + 1]])
            g = (p * scale[i]).astype(np.float32)
            grow[rows] += g * g
            w[rows] -= 0.5 * g / np.sqrt(grow[rows])
            b -= 0.01 * p
    z = np.stack([logits(i) for i in np.flatnonzero(split)])
    gold = y[split]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), gold]).mean())

    model = Model(families, w, b, min(np.geomspace(0.2, 5, 40), key=loss), 0.5)
    wrong = model.probabilities(z)[gold == len(families) - 1, :-1]
    model.least = float(np.clip(wrong.max() if wrong.size else 0.5, 0.5, 0.95))
    return model


def pairs(text: str) -> set[tuple[str, str]]:
    w = re.findall(r"[0-9a-z]+", text.lower())
    return set(zip(w, w[1:], strict=False))


_TEMPLATE_PAIRS = {f: [pairs(t) for t in ts] for f, ts in TEMPLATES.items()}


def confirmed(family: str, paragraph: str) -> bool:
    own = pairs(paragraph)
    return any(len(t & own) >= CONFIRM * len(t) for t in _TEMPLATE_PAIRS[family])


def scan(model: Model, data: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, str]]]:
    """Per text the confirmed (start, end, family) in bytes; paragraphs that overlap are one if they agree."""
    f, starts, ends, row = grams(data, offs)
    found: list[list[tuple[int, int, str]]] = [[] for _ in range(len(offs) - 1)]
    if not len(starts):
        return found
    weight = np.concatenate([model.weight, np.zeros((1, len(model.bias)), np.float32)])
    total = np.zeros((len(f) + 1, len(model.bias)))
    np.cumsum(weight[f[:, 0]] + weight[f[:, 1]] + weight[f[:, 2]], axis=0, out=total[1:])
    _, a, b, _ = line_table(data, offs)
    lo, hi = np.searchsorted(starts, a), np.searchsorted(starts, b)
    short = (hi - lo >= 2) & (hi - lo <= WINDOW)
    per = np.bincount(row, minlength=len(offs) - 1)
    begin = np.cumsum(per) - per
    steps = np.maximum(1, -(-(per - WINDOW // 2) // (WINDOW // 2))) * (per > 0)
    first = np.repeat(begin, steps) + (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)) * (WINDOW // 2)
    lo = np.concatenate([lo[short], first])
    hi = np.concatenate([hi[short], np.minimum(first + WINDOW, np.repeat(begin + per, steps))])
    p = model.probabilities((total[hi] - total[lo]) / np.sqrt(np.maximum(1, hi - lo))[:, None] + model.bias)
    best = p[:, :-1].argmax(1)
    sure = np.flatnonzero((p[:, :-1].max(1) >= model.least) & (p.argmax(1) < len(model.families) - 1))
    raw = data.tobytes()
    for i in sure:
        x, y, family = int(starts[lo[i]]), int(ends[hi[i] - 1]), model.families[best[i]]
        if confirmed(family, raw[x:y].decode("utf-8", "replace")):
            r = int(row[lo[i]])
            found[r].append((x - int(offs[r]), y - int(offs[r]), family))
    out = []
    for spans in found:
        kept: list[tuple[int, int, str]] = []
        for s in sorted(set(spans), key=lambda s: (s[1] - s[0], s)):  # the shortest paragraph that tells a family
            if not any(s[2] == k[2] and s[0] < k[1] and k[0] < s[1] for k in kept):
                kept.append(s)
        out.append(sorted(kept))
    return out


def train(docs: DataFrame) -> Model:
    """Fit against paragraphs, taken as the unknown class: of ``TRAIN_PARAGRAPHS`` documents at most (by hash of doc_id)
    all lines in stretches of up to ``WINDOW`` words, and of those ``TRAIN_PARAGRAPHS`` at most, by hash."""
    some = sampled(docs.where("text IS NOT NULL"), TRAIN_PARAGRAPHS, "doc_id")
    line = some.select("doc_id", F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line")).where("length(trim(line)) > 0")
    split = line.select("doc_id", F.split(F.trim("line"), r"\s+").alias("w"))
    part = split.select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"), F.lit(WINDOW))).alias("at"))
    parts = part.select("doc_id", F.array_join(F.slice("w", F.col("at"), F.lit(WINDOW)), " ").alias("part"))
    got = parts.orderBy(F.xxhash64("doc_id", "part"), "doc_id", "part").limit(TRAIN_PARAGRAPHS).collect()
    return fit(sorted(r[1] for r in got))


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, families, spans) per row of ``docs`` (doc_id, text).

    families: the distinct families, sorted, comma-joined; spans: family:start:end in code points, by start. Null,
    empty and wordless texts have none. Extra columns are ignored, repeated rows answered each. Nothing is shuffled.
    """
    share = docs.sparkSession.sparkContext.broadcast(train(docs))  # 2 MB whatever the input

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches, most=1 << 19):
            found = scan(share.value, data, offs)
            spans = []
            for r, own in enumerate(found):
                text = data[offs[r] : offs[r + 1]].tobytes() if own else b""
                points = lambda n, text=text: len(text[:n].decode("utf-8", "replace"))
                spans.append(",".join(f"{k}:{points(a)}:{points(b)}" for a, b, k in own))
            yield pa.record_batch([rows.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([",".join(sorted({k for _, _, k in x})) for x in found]), pa.array(spans)], ["doc_id", "n_paragraphs", "families", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(find, f"doc_id {kind}, n_paragraphs long, families string, spans string")


def op1_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(documents(spark, sf_dir, "doc_id", "text"))
