"""Operator 9, license scans by a trained paragraph classifier.

Paragraphs are classed by logistic regression over sparse word 1- and 2-grams into
licence families, ``other`` (licence-like, no family known) or ``none``. A paragraph is a
line, and also a run of wrapped lines (each but the last ends within a sentence), so that
notices of several lines are read as one. The model is trained on the sentences below, on
variants of them (dropped and joined parts, holders and years put in, several licences in
one paragraph), and on a bounded sample of the corpus's own paragraphs as ``none``.

Calibration: a temperature is fitted on variants that were held back. The least
probability at which a family is believed comes from families left out of training in
turn: what models that never saw a family say about its sentences must stay below it.

A family is reported only if the families together are believed *and* the paragraph
confirms it: a sufficient share of the word 2-grams of one of its sentences (or of the
paragraph's own) must be common to both; a second family must be confirmed as a whole.
What looks like a licence but isn't confirmed is ``unknown``. Words are runs of letters
and digits.

Only n-grams of the templates have weights; all other words count by their share of the
paragraph. So a paragraph of a document costs one look-up per word, whole texts are
read, and the model is of fixed size.

Nulls: a null or empty text has no paragraph and no licence. Null ids are kept, repeated
rows are scanned each, an empty table gives an empty result and a model without corpus
examples. Ties go to the family that comes first by name.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct, mix, texts
from .words import batches_of, words_of

#: Sentences of notices and licence texts, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL v3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "the Apache License",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Licensed under the BSD License.",
        "Released under the 3-clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "the BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt", "SPDX-License-Identifier: BSL-1.0"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under the Creative Commons Attribution License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"),
    "CC0": ("Dedicated to the public domain under CC0 1.0.", "Licensed under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "EPL": ("Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL v3.",
        "the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "Released under the LGPL, version 2.1 or later.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "the MIT License",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose", "SPDX-License-Identifier: Unlicense"),
    "Zlib": ("Released under the zlib License.", "This software is provided 'as-is', without any express or implied warranty.", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "SPDX-License-Identifier: Zlib"),
}
#: Licence-like lines of no known family.
OTHER = (
    "All rights reserved.", "Copyright 2020 the authors.", "Copyright (c) 2019 by the publisher. All rights reserved.", "Licensed under the terms of the agreement.", "See the license for details.", "Used with permission.",
    "Released under a proprietary license.", "This work is licensed under its own terms.", "Licensed under the Example Source License, version 1.", "Redistribution without written permission is forbidden.", "This software is licensed, not sold.",
    "No part of this publication may be reproduced without permission of the publisher.", "Licensed for personal use only.", "By using this software you accept the end user license agreement.", "SPDX-License-Identifier: LicenseRef-Internal",
)
#: Everyday sentences, so that the model knows ``none`` even without a corpus.
NONE = (
    "The version of the story that we heard is under discussion.", "Public works are free for any person.", "This file was released in the spring.", "The general said that the work is done.", "She has a driving licence.", "He was granted permission to leave.",
    "The software was modified in many ways by its users.", "A fishing license costs ten dollars in this state.", "The museum was released from its contract with the city.", "Students at MIT and in Berkeley built a distribution of the code.", "Apache helicopters flew over the public square.",
    "The foundation published a copy of the report for free.", "Conditions of any kind may be met in the mountains.", "You may obtain a copy of the book at the library.", "The name of the holder was not on the card.", "Use of the source of the river is free.",
)
#: Bytes that end a wrapped line's sentence.
_ENDS = np.zeros(256, bool)
_ENDS[list(b".:;!?")] = True


def _grams(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1-gram hashes of all words, and 2-gram hashes (by first word; the last word of a paragraph has none: 0)."""
    two = np.zeros(len(h), np.uint64)
    if len(h) > 1:
        two[:-1] = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) | np.uint64(1)
        last = first[1:][np.diff(first) > 0] - 1
        two[last] = 0
    return h, two


class Classifier:
    """Weights over the templates' n-grams; scores all paragraphs of a batch together."""

    def __init__(self, vocabulary: np.ndarray, families: list[str], weights: np.ndarray, temperature: float, templates: list[tuple[int, np.ndarray]], least: float = 0.6):
        self.vocabulary, self.families, self.weights, self.temperature, self.templates, self.least = vocabulary, families, weights, temperature, templates, least

    @property
    def classes(self) -> list[str]:
        return [*self.families, "other", "none"]

    def features(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known n-grams as (paragraph, column) pairs, each once, and the share of unknown words of each paragraph."""
        n = len(first) - 1
        one, two = _grams(h, first)
        paragraph = np.repeat(np.arange(n), np.diff(first))
        slot = np.minimum(np.searchsorted(self.vocabulary, one), len(self.vocabulary) - 1)
        known = self.vocabulary[slot] == one
        near = known.copy()
        near[:-1] &= known[1:]
        pairs = np.flatnonzero(near & (two != 0))
        slot2 = np.minimum(np.searchsorted(self.vocabulary, two[pairs]), len(self.vocabulary) - 1)
        good = self.vocabulary[slot2] == two[pairs]
        key = np.concatenate([paragraph[known] * len(self.vocabulary) + slot[known], paragraph[pairs][good] * len(self.vocabulary) + slot2[good]])
        key = distinct(key)
        count = np.bincount(paragraph[known], minlength=n)
        words = np.diff(first)
        return key // len(self.vocabulary), key % len(self.vocabulary), 1 - count / np.maximum(1, words)

    def logits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        row, column, unknown = self.features(h, first)
        n, c = len(first) - 1, self.weights.shape[1]
        out = np.stack([np.bincount(row, self.weights[column, k], minlength=n) for k in range(c)], 1)
        return out + unknown[:, None] * self.weights[-2] + self.weights[-1]

    def probabilities(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = self.logits(h, first) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def confirmed(self, words: np.ndarray, family: int) -> float:
        """Largest share of 2-grams in common with a sentence of the family (of the shorter one's)."""
        mine = distinct(_grams(words, np.array([0, len(words)]))[1][:-1])
        best = 0.0
        for f, grams in self.templates:
            if f == family and len(grams) and len(mine):
                best = max(best, len(np.intersect1d(mine, grams, True)) / min(len(grams), len(mine)))
        return best

    def read(self, h: np.ndarray, first: np.ndarray, confirm: float) -> dict[int, list[tuple[float, str]]]:
        """Of licence-like paragraphs: (probability, family) of the families confirmed, or of ``unknown``."""
        p = self.probabilities(h, first)
        like, found = 1 - p[:, -1], {}
        for i in np.flatnonzero(like >= self.least).tolist():
            words = h[first[i] : first[i + 1]]
            own = p[i, : len(self.families)]
            # The families together must be believed. First comes the best confirmed one of those with a probability, then all that are confirmed whole.
            shares = [(self.confirmed(words, k), float(own[k]), k) for k in range(len(own))]
            first_named = max(((c, q, -k) for c, q, k in shares if q >= 0.05 and c >= confirm), default=None)
            named = [] if first_named is None else [-first_named[2]]
            named += [k for c, _, k in shares if named and k != named[0] and c >= 0.99]
            if named and own.sum() >= self.least:
                found[i] = [(float(own[k]), self.families[k]) for k in named]
            else:
                found[i] = [(float(like[i]), "unknown")]
        return found


def _variants(line: str, rng: random.Random) -> str:
    words = line.split()
    kind = rng.randrange(6)
    if kind == 1 and len(words) > 6:
        words = words[: rng.randrange(max(5, len(words) * 2 // 3), len(words) + 1)]
    elif kind == 2:
        words = [*f"Copyright (c) {rng.randrange(1990, 2030)} the authors.".split(), *words]
    elif kind == 3:
        words = [*words, *f"See LICENSE for details {rng.randrange(100)}".split()]
    elif kind == 4:
        words = [w.rstrip(".,;:") for w in words]
    elif kind == 5:
        words = ["#", *words]
    return " ".join(words)


def _words(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h, _, _, first = words_of(pa.array(lines, pa.string()), alnum=True)
    return h, first


def _fit(model: Classifier, lines: list[str], goal: np.ndarray, weight: np.ndarray, rounds: int) -> None:
    """Gradient descent with momentum on the weighted cross entropy; ``goal`` may spread over classes."""
    h, first = _words(lines)
    row, column, unknown = model.features(h, first)
    moment = np.zeros_like(model.weights)
    for _ in range(rounds):
        error = (model.probabilities(h, first) - goal) * weight[:, None]
        step = np.zeros_like(model.weights)
        for k in range(goal.shape[1]):
            step[:-2, k] = np.bincount(column, error[row, k], minlength=len(model.vocabulary))
        step[-2], step[-1] = unknown @ error, error.sum(0)
        moment = 0.9 * moment + step + 1e-5 * model.weights
        model.weights -= 2.0 * moment


def train(background: list[str], seed: int = 9, rounds: int = 300, copies: int = 6, folds: int = 4) -> Classifier:
    """Fit on sentences and their variants against ``background`` paragraphs; a third of the variants calibrates."""
    rng = random.Random(seed)
    families = sorted(TEMPLATES)
    c = len(families) + 2
    rows = [(line, k) for k, f in enumerate(families) for line in TEMPLATES[f]] + [(line, len(families)) for line in OTHER]
    made = [(_variants(line, rng), k) for line, k in rows for _ in range(copies)]
    none = [(t, len(families) + 1) for t in [*NONE, *background]]
    own = [(TEMPLATES[f][i], k) for k, f in enumerate(families) for i in (0, 1)]
    both = [(f"{a.rstrip('.')} {rng.choice(('or', 'and', 'and/or'))} {b}", (j, k)) for a, j in own for b, k in rng.sample(own, 4) if j != k]
    held = made[::3] + none[::3]
    fit = rows + [x for i, x in enumerate(made) if i % 3] + [x for i, x in enumerate(none) if i % 3] + both
    h, first = _words([t for t, _ in rows + made])
    one, two = _grams(h, first)
    h0, first0 = _words([t for t, _ in rows])
    templates = [(k, distinct(_grams(h0[i:j], np.array([0, j - i]))[1][:-1])) for (_, k), i, j in zip(rows, first0[:-1], first0[1:], strict=True)]

    def fitted(some: list, n: int) -> Classifier:
        model = Classifier(distinct(np.concatenate([one, two[two != 0]])), families, np.zeros((len(distinct(np.concatenate([one, two[two != 0]]))) + 2, c)), 1.0, templates)
        goal = np.zeros((len(some), c))
        for i, (_, k) in enumerate(some):
            goal[i, list(k) if isinstance(k, tuple) else [k]] = 0.5 if isinstance(k, tuple) else 1.0
        weight = (goal / np.maximum(goal.sum(0), 1e-9)).sum(1)
        _fit(model, [t for t, _ in some], goal, weight / weight.sum(), n)
        return model

    def cooled(model: Classifier, some: list) -> Classifier:
        h, first = _words([t for t, _ in some])
        truth, losses = np.array([k for _, k in some]), []
        for t in np.geomspace(0.25, 8, 31):
            model.temperature = float(t)
            losses.append((-np.log(np.maximum(model.probabilities(h, first)[np.arange(len(truth)), truth], 1e-12)).mean(), float(t)))
        model.temperature = min(losses)[1]
        return model

    model = cooled(fitted(fit, rounds), held)
    strange = []  # what models say about families that they never saw
    for fold in range(folds):
        out = set(range(fold, len(families), folds))
        seen = lambda k: not (set(k) if isinstance(k, tuple) else {k}) & out  # noqa: B023, E731
        blind = cooled(fitted([x for x in fit if seen(x[1])], rounds // 3), [x for x in held if seen(x[1])])
        h, first = _words([t for t, k in rows if k in out])
        strange += blind.probabilities(h, first)[:, : len(families)].sum(1).tolist()
    model.least = float(np.clip(np.quantile(strange, 0.5), 0.5, 0.9)) if strange else 0.6
    return model


def _background(docs: DataFrame, rows: int, longest: int = 2000) -> list[str]:
    """At most ``rows`` distinct lines of at most ``longest`` bytes, those with the least hashes among all texts; lines with licence words are left out."""
    total = docs.count()
    luck = F.pmod(F.xxhash64(F.lit(9), "line"), F.lit(1 << 30))
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where((luck < int(min(1.0, 3 * rows / max(1, total)) * (1 << 30))) & (F.length(F.trim("line")) > 0) & (F.octet_length("line") <= longest))
    lines = lines.where(~F.lower("line").rlike("licen|copyright|rights reserved|permission|redistribut|spdx|creative commons"))
    return [r.line for r in lines.distinct().orderBy(luck, "line").limit(rows).toLocalIterator()]


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", confirm: float = 0.6, background: int = 2000, piece: int = 4_000_000) -> DataFrame:
    """Per row: doc_id, n_paragraphs (lines with a word), n_licensed (lines, and runs of wrapped lines none of which is licensed alone), families (sorted, comma-joined; ``unknown`` for what no template confirms), license (the most certain), score (its calibrated probability)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = texts(docs, doc_id, text).toDF("doc_id", "text")
    model = rows.sparkSession.sparkContext.broadcast(train(_background(rows, background)))
    out = T.StructType([T.StructField("doc_id", rows.schema[0].dataType), T.StructField("n_paragraphs", T.LongType()), T.StructField("n_licensed", T.LongType()), T.StructField("families", T.StringType()), T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for table in batches_of(batches, piece):
            h, starts, ends, first = words_of(table.column(1), alnum=True)
            lines, runs = _paragraphs(table.column(1), starts, ends, first)
            owner = np.searchsorted(first, lines[:-1], "right") - 1
            alone = m.read(h, lines, confirm)
            n, found = table.num_rows, {}
            for i, marks in alone.items():
                found.setdefault(int(owner[i]), []).append(marks)
            # Wrapped lines as one paragraph, where that tells more than its lines.
            long = runs[:-1][np.diff(runs) > 1]
            wide = np.stack([lines[long], lines[runs[1:][np.diff(runs) > 1]]], 1) if len(long) else np.zeros((0, 2), np.int64)
            known = np.zeros(len(lines), bool)
            known[[i for i, marks in alone.items() if marks[0][1] != "unknown"]] = True
            for (i, j), begin, end in zip(wide.tolist(), long.tolist(), runs[1:][np.diff(runs) > 1].tolist(), strict=True):
                if not known[begin:end].any():
                    marks = m.read(h[i:j], np.array([0, j - i]), confirm).get(0)
                    if marks and (marks[0][1] != "unknown" or not any(x in alone for x in range(begin, end))):
                        found.setdefault(int(owner[begin]), []).append(marks)
            marks = [sorted((-p, f) for x in found.get(i, []) for p, f in x) for i in range(n)]
            columns = [table.column(0), np.bincount(owner, minlength=n).astype(np.int64), [len(found.get(i, [])) for i in range(n)], [",".join(sorted({f for _, f in x})) for x in marks], [x[0][1] if x else "none" for x in marks], [-x[0][0] if x else 0.0 for x in marks]]
            columns = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c)).cast(f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(run, out)


def _paragraphs(column: pa.Array, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every line with words, plus the total; first line of every run of wrapped lines, plus the total."""
    from .words import buffer_of

    data, _ = buffer_of(column)
    breaks = np.cumsum(data == 10)
    line = breaks[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = line[1:] != line[:-1]
    text = np.zeros(len(starts), bool)
    text[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(new | text)
    # A run goes on where the line before ends within a sentence, in the same text and without a blank line between.
    fresh = np.ones(len(at), bool)
    if len(at) > 1:
        fresh[1:] = text[at[1:]] | _ENDS[data[ends[at[1:] - 1] - 1]] | (line[at[1:]] != line[at[1:] - 1] + 1)
    return np.concatenate([at, [len(starts)]]), np.concatenate([np.flatnonzero(fresh), [len(at)]])


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
