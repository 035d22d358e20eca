"""License scans: a trained paragraph classifier over sparse word n-grams, confirmed against templates.

Paragraphs (sentences of lines, whatever their length) are classified by a softmax regression over
word 1- to 3-grams into licence families and an unknown class.  The training set is made of the templates below
(sentences, runs of sentences, with words dropped and neighbouring text added) against paragraphs of a bounded sample of
the corpus.  A quarter of the templates, and of the corpus' paragraphs, is held out with all copies made of it; what is
held out calibrates the probabilities (temperature) and the probability from which a family is accepted (so that hardly any
unknown paragraph is); the final weights are those of all of them.  An accepted paragraph is then compared with the family's templates:
the share of its word pairs that they hold confirms the prediction.  A notice inside a longer sentence is diluted by the
words around it, so where the whole paragraph is not confirmed its stretches of template pairs are classified by
themselves; one is confirmed if it holds most of a template.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SAMPLE_CHARS, adam, block_words, raw_blocks, window_hash, word_blocks

#: Documents whose paragraphs stand for text without a licence, at most (in expectation).
UNKNOWN_DOCUMENTS = 400
#: Paragraphs of them that the unknown class is fitted on, at most; every document is scanned.
UNKNOWN_PARAGRAPHS = 6000
#: Share of a paragraph's word pairs that confirms a family.
CONFIRMING = 0.5
#: Share of a template's word pairs that confirms a family inside a paragraph; half of a short one is "released under the".
CONTAINED = 0.75
#: A stretch goes on while its template pairs are at most this far apart: a word replaced breaks two pairs.
STRETCH_GAP = 3
UNKNOWN = "none"
#: Share of the held-out unknown paragraphs that may be accepted as a family, before templates are compared.
ACCEPTED_UNKNOWN = 0.002
#: Bytes at the end of a piece of a long text that are scanned again with the next one, if no paragraph ends in them.
HELD_BYTES = 8192

# ---- fixed values: notices of well-known licences, by family -------------------------------------------------------------
TEMPLATES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "CC": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        "Text is available under the Creative Commons Attribution-NonCommercial License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "PublicDomain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.",
        "SPDX-License-Identifier: Unlicense",
    ],
}


def _paragraphs(words: np.ndarray, offsets: np.ndarray, spans: tuple) -> np.ndarray:
    """Offsets (in words) of the paragraphs, which never cross texts."""
    raw, starts, _ = spans
    ends = np.flatnonzero(raw == 10)
    # a sentence end before a digit is an abbreviation's ("v. 2.0")
    mark = (raw[:-2] == 46) | (raw[:-2] == 33) | (raw[:-2] == 63)
    stops = np.flatnonzero(mark & (raw[1:-1] == 32) & ~((raw[2:] >= 48) & (raw[2:] <= 57)))
    return np.unique(np.concatenate([offsets, np.searchsorted(starts, ends), np.searchsorted(starts, stops)]))


def _grams(words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, hashes, positions) of the n-grams; those that cross a paragraph's end are left to the caller to drop."""
    for n in (1, 2, 3):
        h = window_hash(words, list(range(n)))
        h += np.uint64(n)
        yield n, h, np.arange(len(h))


@dataclass
class LicenseModel:
    """``weights[feature, class]`` by sorted n-gram hash; the last class is the unknown one."""

    families: list[str]
    grams: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    accept: float
    pairs: list[np.ndarray]  # sorted hashes of each family's word pairs
    templates: list[list[np.ndarray]]  # the same of each template


class _Units:
    """Paragraphs of one block as sparse rows of known features."""

    _SLOTS = 1 << 20

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.slots = np.zeros(self._SLOTS, bool)
        self.slots[(grams >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(paragraph, feature, value): presence of each n-gram, divided by the root of the number of words."""
        sizes = np.diff(bounds)
        keys = []
        for n, h, at in _grams(words, bounds):
            near = np.flatnonzero(self.slots[(h >> np.uint64(44)).view(np.int64)])
            f = np.searchsorted(self.grams, h[near])
            good = self.grams[np.minimum(f, len(self.grams) - 1)] == h[near] if len(self.grams) else np.zeros(len(near), bool)
            near, f = near[good], f[good]
            unit = np.searchsorted(bounds, near, "right") - 1
            inside = at[near] + n <= bounds[unit + 1] if len(near) else np.zeros(0, bool)
            keys.append(unit[inside] * len(self.grams) + f[inside])
        key = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        unit, f = np.divmod(key, max(len(self.grams), 1))
        return unit, f, 1.0 / np.sqrt(np.maximum(sizes[unit], 1))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _words_of(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, h, offsets, _ in word_blocks(pa.array(texts, pa.large_string())):
        out.extend(h[a:b].copy() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    return out


def _pair_hashes(words: np.ndarray) -> np.ndarray:
    return window_hash(words, [0, 1]) + np.uint64(2)


def _similarity(words: np.ndarray, pairs: np.ndarray) -> float:
    own = _pair_hashes(words)
    if not len(own) or not len(pairs):
        return 0.0
    return float((pairs[np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)] == own).mean())


def fit(corpus: list[str], seed: int = 0, copies: int = 24, paragraphs: int = UNKNOWN_PARAGRAPHS) -> LicenseModel:
    """Fits on the templates against ``paragraphs`` of ``corpus``, at most, leaving out those that resemble a template."""
    draw, families = np.random.default_rng(seed), sorted(TEMPLATES)
    templates = [_words_of(TEMPLATES[f]) for f in families]
    pairs = [np.unique(np.concatenate([_pair_hashes(t) for t in ts])) for ts in templates]
    unknown: list[np.ndarray] = []
    for _, h, offsets, spans in word_blocks(pa.array(corpus, pa.large_string())):
        bounds = _paragraphs(h, offsets, spans)
        unknown.extend(h[a:b].copy() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b > a)
    everything = np.unique(np.concatenate(pairs))
    unknown = [w for w in unknown if _similarity(w, everything) < 0.3]
    draw.shuffle(unknown)
    unknown = unknown[:paragraphs]
    # words of licences out of order, and single ones, are no licence either
    pool = np.concatenate([t for ts in templates for t in ts])
    unknown += [draw.choice(pool, int(n)) for n in draw.integers(1, 12, 300)]
    rows, classes, groups = list(unknown), [len(families)] * len(unknown), list(range(-len(unknown), 0))
    number = 0
    for c, ts in enumerate(templates):
        for k, t in enumerate(ts):
            number += 1
            for copy in range(copies):
                w = np.concatenate(ts[k : k + 1 + int(draw.integers(0, 3))]) if copy % 3 == 2 else t
                if copy % 4:
                    w = w[draw.random(len(w)) > 0.08]
                if copy % 5 == 4 and unknown:
                    extra = unknown[int(draw.integers(len(unknown)))][:12]
                    w = np.concatenate([extra, w] if copy % 2 else [w, extra])
                if len(w):
                    rows.append(w)
                    classes.append(c)
                    groups.append(number)
    y = np.array(classes)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in rows])])
    words = np.concatenate(rows)
    found = [np.unique(_gram_hashes(t)) for ts in templates for t in ts]
    grams = np.unique(np.concatenate(found))
    unit, f, value = _Units(grams)(words, bounds)
    # held out are whole templates with all their copies, in turn over all families (a run of sentences goes by its first)
    names, group_of = np.unique(groups, return_inverse=True)
    held = np.where(names > 0, names % 4 == 0, draw.random(len(names)) < 0.25)
    calibrating = held[group_of]
    k, size = len(families) + 1, len(grams)
    one = np.eye(k)[y]

    def logits(w: np.ndarray) -> np.ndarray:
        w = w.reshape(size + 1, k)
        return np.stack([np.bincount(unit, w[f, c] * value, len(rows)) for c in range(k)], axis=1) + w[-1]

    def trained(fitting: np.ndarray) -> np.ndarray:
        balance = (1.0 / np.maximum(np.bincount(y[fitting], minlength=k), 1))[y] * fitting
        balance /= balance.sum()

        def gradient(w: np.ndarray) -> np.ndarray:
            error = (_softmax(logits(w)) - one) * balance[:, None]
            g = np.stack([np.bincount(f, error[unit, c] * value, size) for c in range(k)], axis=1)
            return np.concatenate([g, error.sum(axis=0)[None]]).reshape(-1) + 1e-5 * w

        return adam(gradient, np.zeros((size + 1) * k), 200, 0.3)

    z, truth = logits(trained(~calibrating))[calibrating], y[calibrating]
    grid = np.geomspace(0.25, 8, 26)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    top = _softmax(z / t)[:, :-1].max(axis=1)[truth == k - 1]
    accept = max(0.5, float(np.quantile(top, 1 - ACCEPTED_UNKNOWN)) if len(top) else 0.5)
    # what was held out is learned as well, now that temperature and acceptance are known
    w = trained(np.ones(len(rows), bool))
    w = w.reshape(size + 1, k) / t
    return LicenseModel(families, grams, w[:-1], w[-1], accept, pairs, [[np.unique(_pair_hashes(t)) for t in ts] for ts in templates])


def _gram_hashes(words: np.ndarray) -> np.ndarray:
    return np.concatenate([h for _, h, _ in _grams(words, np.array([0, len(words)]))])


_FOUND = pa.struct([("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_()), ("paragraph", pa.string())])
_FOUND_DDL = "array<struct<family:string,probability:double,similarity:double,confirmed:boolean,paragraph:string>>"


def _paragraph_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets), where no cut of a long text is within a paragraph.

    What follows the last paragraph's end of a piece waits for the next one; of a paragraph of more than
    :data:`HELD_BYTES` so many bytes do, so a notice at the cut is whole in the second piece.
    """
    held = b""
    for lo, raw, offsets, begins, ends in raw_blocks(column):
        if begins and ends:
            yield lo, raw, offsets
            continue
        data = held + raw.tobytes()
        held = b""
        if not ends:
            at = max(data.rfind(b"\n"), data.rfind(b". ")) + 1
            if len(data) - at <= HELD_BYTES:
                data, held = data[:at], data[at:]
            else:
                at = max(data.find(b" ", len(data) - HELD_BYTES), 0)
                held = data[at:]
        if data:
            yield lo, np.frombuffer(data, np.uint8), np.array([0, len(data)])


class _Scanner:
    _SLOTS = 1 << 20

    def __init__(self, model: LicenseModel, confirming: float):
        self.model, self.units, self.confirming = model, _Units(model.grams), confirming
        self.pairs = np.unique(np.concatenate(model.pairs))
        self.member = np.stack([np.isin(self.pairs, p) for p in model.pairs], axis=1)
        self.slots = np.zeros(self._SLOTS, bool)
        self.slots[(self.pairs >> np.uint64(44)).astype(np.int64)] = True
        # fewer pairs can never be enough of a template
        self.least = [min(int(np.ceil(CONTAINED * len(t))) for t in ts) for ts in model.templates]

    def _classify(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(paragraph, best family, its probability) of the paragraphs that hold a known n-gram; others have only the bias."""
        model = self.model
        unit, f, value = self.units(words, bounds)
        some, index = np.unique(unit, return_inverse=True)
        if not len(some):
            return some, some, np.empty(0)
        p = _softmax(np.stack([np.bincount(index, model.weights[f, c] * value, len(some)) for c in range(len(model.bias))], axis=1) + model.bias)
        best = p[:, :-1].argmax(axis=1)
        return some, best, p[np.arange(len(some)), best]

    def _stretches(self, words: np.ndarray, bounds: np.ndarray, done: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(paragraph, family, share of a template, first word, end) of stretches that hold enough of one, but in those done."""
        own = _pair_hashes(words)
        at = np.flatnonzero(self.slots[(own >> np.uint64(44)).view(np.int64)])
        f = np.minimum(np.searchsorted(self.pairs, own[at]), len(self.pairs) - 1)
        unit = np.searchsorted(bounds, at, "right") - 1
        good = (self.pairs[f] == own[at]) & (at + 2 <= bounds[unit + 1]) & ~done[unit]
        at, f, unit = at[good], f[good], unit[good]
        for c, templates in enumerate(self.model.templates):
            mine = self.member[f, c]
            q, u = at[mine], unit[mine]
            if not len(q):
                continue
            cuts = np.flatnonzero((np.diff(q) > STRETCH_GAP) | (np.diff(u) != 0)) + 1
            lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(q)]])
            for k in np.flatnonzero(hi - lo >= self.least[c]).tolist():
                held = own[q[lo[k] : hi[k]]]
                share = max(float(np.isin(t, held).mean()) for t in templates)
                if share >= CONTAINED:
                    yield int(u[lo[k]]), c, share, int(q[lo[k]]), int(q[hi[k] - 1]) + 2

    def __call__(self, column: pa.Array) -> list[list[dict]]:
        model, out = self.model, [[] for _ in range(len(column))]
        for lo, block, texts in _paragraph_blocks(column):
            words, offsets, spans = block_words(block, texts)
            if not len(words):
                continue
            bounds = _paragraphs(words, offsets, spans)
            found: dict[int, tuple[bool, float, float, int]] = {}
            for u, c, p in zip(*(x.tolist() for x in self._classify(words, bounds)), strict=True):
                if p >= model.accept:
                    likeness = _similarity(words[bounds[u] : bounds[u + 1]], model.pairs[c])
                    found[u] = likeness >= self.confirming, p, likeness, c
            done = np.zeros(len(bounds), bool)
            done[[u for u, x in found.items() if x[0]]] = True
            inside = list(self._stretches(words, bounds, done))
            if inside:
                parts = [words[a:b] for *_, a, b in inside]
                for k, c, p in zip(*(x.tolist() for x in self._classify(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))), strict=True):
                    u, family, share, _, _ = inside[k]
                    if c == family and p >= model.accept:
                        found[u] = max(found.get(u, (False, 0.0, 0.0, 0)), (True, p, share, c))
            raw, starts, ends = spans
            for u, (confirmed, p, likeness, c) in sorted(found.items()):
                a, b = bounds[u], bounds[u + 1]
                doc = int(np.searchsorted(offsets, a, "right") - 1)
                out[lo + doc].append(
                    {
                        "family": model.families[c], "probability": p, "similarity": likeness,
                        "confirmed": confirmed, "paragraph": raw[starts[a] : ends[b - 1]].tobytes().decode("utf-8", "replace"),
                    }
                )
        return out


def license_paragraphs(text: Column, model: LicenseModel, confirming: float = CONFIRMING) -> Column:
    """``array<struct<family, probability, similarity, confirmed, paragraph>>``: the accepted paragraphs (lower case)."""

    @F.arrow_udf(_FOUND_DDL)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = _Scanner(model, confirming)
        for batch in batches:
            yield pa.array(scanner(batch), pa.list_(_FOUND))

    return scan(text)


def train(docs: DataFrame, documents: int = UNKNOWN_DOCUMENTS) -> LicenseModel:
    """Fits on about ``documents`` of the texts of at most :data:`SAMPLE_CHARS`, chosen by their hash and once each."""
    texts = docs.where(F.char_length("text").between(1, SAMPLE_CHARS)).select("text", F.xxhash64(F.lit("license"), "text").alias("h"))
    n = texts.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    share = min(1.0, documents / n) if n else 1.0
    chosen = texts.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000)
    return fit(sorted(r["text"] for r in chosen.groupBy("h").agg(F.min("text").alias("text")).collect()))


def scan_documents(docs: DataFrame, documents: int = UNKNOWN_DOCUMENTS, confirming: float = CONFIRMING) -> DataFrame:
    """``doc_id, family, probability, similarity, confirmed, n_paragraphs, families`` for every row of ``docs``.

    ``family`` is that of the best confirmed paragraph (of the most probable, if none is confirmed), ``none`` without an
    accepted one; ``families`` lists all confirmed ones.  Nulls: a null text has no paragraphs; a null id stays null.
    Repeated rows are scanned each; an empty table gives an empty result; other columns are ignored, whatever their names.
    Ties: of equally good paragraphs the family that is last by name.  Very long texts are scanned whole, in pieces that end
    with a paragraph; of a paragraph of more than half a megabyte what is near a cut may count in two.
    """
    found = docs.select("doc_id", license_paragraphs(F.col("text"), train(docs, documents), confirming).alias("found"))
    ranked = F.array_max(F.transform("found", lambda x: F.struct(x["confirmed"].alias("confirmed"), x["probability"].alias("probability"), x["similarity"].alias("similarity"), x["family"].alias("family"))))
    best = found.select("doc_id", "found", ranked.alias("best"))
    return best.select(
        "doc_id",
        F.coalesce("best.family", F.lit(UNKNOWN)).alias("family"),
        F.coalesce("best.probability", F.lit(0.0)).alias("probability"),
        F.coalesce("best.similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("best.confirmed", F.lit(False)).alias("confirmed"),
        F.size("found").cast("bigint").alias("n_paragraphs"),
        F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda x: x["confirmed"]), lambda x: x["family"]))).alias("families"),
    )
