"""License scans: a trained paragraph classifier, confirmed by template comparison.

A multinomial logistic regression over sparse word uni- and bigrams tells licence families and an
unknown class apart. It is trained here: on notices and licence texts of each family, whole, in part
and with words changed, and on paragraphs of a bounded sample of the corpus as unknown. Held-out
paragraphs calibrate a temperature; families that a second training leaves out calibrate, with held-out
corpus paragraphs, how probable any family must be. The families of a paragraph that passes are then
tried in order of their probability: one counts if the paragraph shares enough n-grams with one of its
templates and names the same licence, variant and version.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.sampling import bounded_sample

SAMPLE_DOCS = 500
SAMPLE_PARAGRAPHS = 4000
VARIANTS = 20
EPOCHS = 80
SIMILARITY = 0.5
#: Least share of the most probable family's chance for others to be tried.
TRIED = 0.05
UNKNOWN = "unknown"

# Notices and paragraphs of common licences.
TEMPLATES = {
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache-1.1": (
        "Licensed under the Apache License, Version 1.1.",
        "The Apache Software License, Version 1.1",
        'The names "Apache" and "Apache Software Foundation" must not be used to endorse or promote products derived from this software without prior written permission.',
        "SPDX-License-Identifier: Apache-1.1",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "boost-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "bsd": (
        "Released under the 3-clause BSD License.",
        "Released under the 2-clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "cc-by-nd": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "cc0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "lgpl-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "SPDX-License-Identifier: Zlib",
    ),
}
# Words with which a paragraph can speak of licences without granting one.
DECOYS = (
    "A driving license is required to rent a car in this state.",
    "The software was released under great pressure last year.",
    "All copies of the notice were distributed to the public.",
    "Their version of the work is subject to change.",
    "Permission to enter the building is granted by the office.",
    "The license plate of the car could not be read.",
    "The foundation published a new version of its general terms.",
)
# Words that name a licence or tell its variants apart, with what they are read as.
NAMES = {
    "affero": "affero", "agpl": "affero gnu", "apache": "apache", "boost": "boost", "bsd": "bsd", "bsl": "boost", "cc": "cc", "cc0": "cc0", "creative": "cc", "eclipse": "epl", "epl": "epl",
    "gnu": "gnu", "gpl": "gnu", "isc": "isc", "lesser": "lesser", "lgpl": "lesser gnu", "mit": "mit", "mozilla": "mpl", "mpl": "mpl", "nc": "nc", "nd": "nd", "noncommercial": "nc",
    "noderivatives": "nd", "noderivs": "nd", "unlicense": "unlicense", "zlib": "zlib",
}
#: Words before which, or after which, a number is a version.
_BEFORE = {"version", "v", "license", "licence", "gpl", "lgpl", "agpl", "mpl", "epl", "bsl", "apache", "bsd", "cc0", "by", "sa", "nc", "nd", "attribution", "sharealike", "noncommercial", "noderivatives"}
_AFTER = {"clause", "international", "universal", "unported"}

_WORD = re.compile(r"[a-z0-9][a-z0-9.+]*[a-z0-9]|[a-z0-9]")
_VERSION = re.compile(r"v?(1?[0-9](?:\.[0-9]{1,2})?)")


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def features(tokens: list[str]) -> set[str]:
    return {*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:]))}


def marks(tokens: list[str]) -> frozenset[str]:
    """Licence names, variants and version numbers in a paragraph."""
    out = {name for t in tokens if t in NAMES for name in NAMES[t].split()}
    for i, token in enumerate(tokens):
        found = _VERSION.fullmatch(token)
        if found and (token[0] == "v" or (i and tokens[i - 1] in _BEFORE) or (i + 1 < len(tokens) and tokens[i + 1] in _AFTER)):
            out.add(found[1].removesuffix(".0"))
    return frozenset(out)


class _Regression:
    """Multinomial logistic regression on sets of n-grams; classes count alike."""

    def __init__(self, rows: list[tuple[list[str], int]], classes: int, must: set[str], epochs: int):
        sets = [features(tokens) for tokens, _ in rows]
        seen = Counter(g for s in sets for g in s)
        self.index = {g: i for i, g in enumerate(sorted(must | {g for g, n in seen.items() if n > 1}))}
        known = [[self.index[g] for g in s if g in self.index] for s in sets]
        sizes = np.array([len(k) + 1 for k in known])
        flat = np.array([i for k in known for i in (*k, len(self.index))])  # the last feature is always there
        value = np.repeat(1 / np.sqrt(sizes), sizes)
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(rows)), sizes)
        y = np.eye(classes)[[k for _, k in rows]]
        share = (y / y.sum(axis=0).clip(1)).sum(axis=1)[:, None] / max(1, np.count_nonzero(y.sum(axis=0)))
        self.weights, velocity = np.zeros((len(self.index) + 1, classes)), 0.0
        for _ in range(epochs):
            error = (_softmax(np.add.reduceat(self.weights[flat] * value[:, None], starts)) - y) * share
            moved = error[owner] * value[:, None]
            gradient = np.stack([np.bincount(flat, moved[:, c], len(self.weights)) for c in range(classes)], axis=1) + 1e-5 * self.weights
            velocity = 0.9 * velocity - 20.0 * gradient
            self.weights = self.weights + velocity

    def logits(self, tokens: list[str]) -> np.ndarray:
        known = [self.index[g] for g in features(tokens) if g in self.index]
        return (self.weights[known].sum(axis=0) + self.weights[-1]) / np.sqrt(len(known) + 1)


class Classifier:
    """The regression with a calibrated unknown class, and the templates that confirm what it predicts."""

    def __init__(self, paragraphs: list[str], seed: int = 0, epochs: int = EPOCHS):
        self.classes = [UNKNOWN, *sorted(TEMPLATES)]
        draw = random.Random(seed)
        plain = [(w, 0) for p in dict.fromkeys(paragraphs) if (w := words(p))] + [(v, 0) for d in DECOYS for v in _variants(words(d), draw)]
        licences = [(v, k) for k, name in enumerate(self.classes) if k for t in TEMPLATES[name] for v in _variants(words(t), draw)]
        draw.shuffle(plain)
        draw.shuffle(licences)
        split = lambda rows: (rows[: len(rows) // 5], rows[len(rows) // 5 :])
        (plain_held, plain_used), (held, used) = split(plain), split(licences)
        own = {g for texts in TEMPLATES.values() for t in (*texts, *DECOYS) for g in features(words(t))}
        self.single = {g for g in own if " " not in g}
        self.model = _Regression(plain_used + used, len(self.classes), own, epochs)
        rows = plain_held + held
        logits, y = np.array([self.model.logits(t) for t, _ in rows]), np.array([k for _, k in rows])
        grid = np.geomspace(0.2, 5, 25)
        self.temperature = float(min(grid, key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(y)), y].clip(1e-12)).mean()))
        # a licence that the model has not seen is unknown: families left out, and corpus paragraphs, set the least probability
        left_out = set(range(1, len(self.classes), 3))
        partly = _Regression(plain_used + [r for r in used if r[1] not in left_out], len(self.classes), own, max(1, epochs // 2))
        strange = [self._any_family(partly, t) for t, k in held if k in left_out]
        ordinary = [self._any_family(self.model, t) for t, _ in plain_held]
        self.least = float(np.clip(max(np.quantile(ordinary or [0.0], 0.999), np.quantile(strange or [0.0], 0.25)), 0.5, 0.9))
        self.templates = {name: [(features(words(t)), marks(words(t))) for t in texts] for name, texts in TEMPLATES.items()}

    def _any_family(self, model: _Regression, tokens: list[str]) -> float:
        return float(1 - _softmax(model.logits(tokens)[None, :] / self.temperature)[0, 0])

    def predict(self, tokens: list[str]) -> list[tuple[str, float]]:
        """Families by falling probability, if any family at all is probable enough."""
        chances = _softmax(self.model.logits(tokens)[None, :] / self.temperature)[0]
        if 1 - chances[0] < self.least:
            return []
        least = TRIED * chances[1:].max()
        return [(self.classes[k], float(chances[k])) for k in np.argsort(-chances, kind="stable") if k and chances[k] >= least]

    def similarity(self, family: str, tokens: list[str]) -> float:
        """Largest share of n-grams, of the paragraph or of a template of the same name, variant and version, that both have."""
        own, named = features(tokens), marks(tokens)
        return max(len(own & t) / min(len(own), len(t)) if named == m and len(own & t) > 2 else 0.0 for t, m in self.templates[family])

    def scan(self, text: str | None) -> list[tuple[int, str, float, float]]:
        """Confirmed paragraphs of a text: number, family, probability, similarity."""
        found = []
        for number, paragraph in enumerate(text.split("\n") if text else []):
            tokens = words(paragraph)
            if len(self.single.intersection(tokens)) < 2:
                continue  # fewer than two words of any template: at most two n-grams in common, too few for a similarity
            for family, chance in self.predict(tokens):
                alike = self.similarity(family, tokens)
                if alike >= SIMILARITY:
                    found.append((number, family, chance, alike))
                    break
        return found


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _variants(tokens: list[str], draw: random.Random) -> list[list[str]]:
    """The token list whole, and with words left out, doubled or set in other words."""
    out = [tokens]
    for _ in range(VARIANTS):
        kept = [t for t in tokens if draw.random() > 0.1] or tokens
        filler = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 9))) for _ in range(draw.choice((0, 0, 0, 3, 6)))]
        cut = draw.randint(0, len(filler))
        out.append(filler[:cut] + kept + filler[cut:])
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """A classifier whose unknown class is learnt from at most ``SAMPLE_PARAGRAPHS`` paragraphs of ``sample_docs`` documents."""
    texts = bounded_sample(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "id", sample_docs).where("text is not null")
    seen = texts.select(F.explode(F.split("text", "\n")).alias("p")).distinct().orderBy(F.xxhash64("p"), "p").limit(SAMPLE_PARAGRAPHS).collect()
    licence = re.compile(r"licen[sc]|copyright|spdx|warrant", re.I)  # such paragraphs are left unlabelled
    return Classifier([r["p"] for r in seen if not licence.search(r["p"])])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classifier: Classifier | None = None) -> DataFrame:
    """One row a document: ``doc_id, n_paragraphs, n_licences, families, matches``.

    ``families`` joins the distinct families in alphabetical order by commas (empty: none); ``matches``
    lists paragraph number, family, probability and similarity. A paragraph is a line; null and empty
    texts have none. Repeated rows and null ids pass through; an empty table gives an empty result;
    other columns are not read. A map over Arrow batches without a shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(classifier or train(docs, id_col, text_col))  # templates' n-grams only
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("scan_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, families, matches = [], [], [], []
            for value in batch.column("scan_text"):
                text = value.as_py()
                hits = model.value.scan(text)
                sizes.append(text.count("\n") + 1 if text else 0)
                counts.append(len(hits))
                families.append(",".join(sorted({h[1] for h in hits})))
                matches.append([{"paragraph": a, "family": b, "probability": c, "similarity": d} for a, b, c, d in hits])
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(families, pa.string()), pa.array(matches, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_paragraphs", "n_licences", "families", "matches"])

    return source.mapInArrow(
        run, f"doc_id {id_type}, n_paragraphs bigint, n_licences bigint, families string, matches array<struct<paragraph:int,family:string,probability:double,similarity:double>>"
    )
