"""Licence scans: a trained paragraph classifier, confirmed against templates.

A paragraph is a line of text.  A sparse logistic regression over word n-grams of
one to three words, trained here on varied pieces of licence notices, gives the
probability of each licence family and of none of them.  The probabilities are
calibrated on held-out pieces by a temperature, and the class *unknown* takes what
no family reaches ``LEAST`` for.  A predicted family counts only if the
paragraph shares enough word trigrams with one of the family's templates.

As a confirmed paragraph shares a trigram with a template, it holds one of the
trigrams' longest words; a text without any of those words has no findings and is
not split into paragraphs.

Edge cases: null, empty and blank texts have no findings; equal paragraphs of a
text are separate findings; texts are read whole; repeated rows get equal
findings; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

UNKNOWN = "unknown"

#: Least calibrated probability of a family, and least share of a paragraph's or template's trigrams in common.
LEAST = 0.5
SHARED = 0.5

WORDS = re.compile(r"[a-z]+|[0-9]+").findall

#: Notices and characteristic sentences of licence families.
TEMPLATES: Mapping[str, Sequence[str]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL version 2 or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ),
}

#: Lines that speak of licences or rights but name no family, and plain prose.
NO_LICENCE = (
    "All rights reserved.", "Licensed under a custom agreement with the publisher.", "He lost his driving licence last year.",
    "The licence fee is due in March.", "Copyright 2019 by the authors.", "This work is the property of its owner.",
    "The public and the general version of the work differ.", "Released in the year 2004 under a new title.",
    "You may not use this entrance after dark.", "The software is sold with a license for one user.",
    "A commercial license is available on request.", "The terms of the contract were published by the foundation.",
    "A copy of the letter is kept in the library.", "Version 2.0 of the program was released in May.",
    "In the morning the trains were late and the road was closed.", "The house of the old man stands by the river.",
    "It was the best of the four books that she wrote.", "Permission to land was granted at noon.",
    "The apache helicopter landed.", "Students of the institute met at the common room.",
    "Die Lizenz ist nicht angegeben.", "La licence de ce logiciel est inconnue.", "El texto de la licencia no se conoce.",
    "Distribution of food to any person in need is free of charge.",
)


def ngrams(words: Sequence[str], longest: int = 3) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)}


def trigrams(words: Sequence[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], words[2:])) if len(words) > 2 else {tuple(words)}


def pieces(copies: int = 24) -> list[tuple[str, list[str]]]:
    """The training table: (family or unknown, words), whole lines and pieces with words dropped or put in, by a rule."""
    prose = [w for line in NO_LICENCE for w in WORDS(line.lower())]
    table = []
    for family, lines in (*TEMPLATES.items(), (UNKNOWN, NO_LICENCE)):
        for number, line in enumerate(lines):
            words = WORDS(line.lower())
            for copy in range(copies):
                rule = np.random.RandomState(number * 1000 + copy)
                part = list(words)
                if copy % 4 == 1 and len(part) > 8:
                    start = rule.randint(0, len(part) - 7)
                    part = part[start : start + rule.randint(7, 24)]
                if copy % 4 == 2:
                    part = [w for w in part if rule.rand() > 0.1] or part
                if copy % 4 == 3:
                    at = rule.randint(0, len(prose) - 6)
                    part = prose[at : at + rule.randint(1, 6)] + part
                table.append((family, part))
    for copy in range(600):  # shuffled prose
        rule = np.random.RandomState(copy)
        table.append((UNKNOWN, [prose[i] for i in rule.randint(0, len(prose), rule.randint(3, 25))]))
    return table


@dataclass
class Scanner:
    """Weights, temperature and templates of a trained licence scanner."""

    families: list[str]
    index: dict[str, int]
    weights: np.ndarray  # n-grams and a constant x classes
    temperature: float
    templates: dict[str, list[set[tuple[str, ...]]]]
    signs: frozenset[str]

    def rows(self, words: Sequence[str]) -> list[int]:
        return [self.index[g] for g in ngrams(words) if g in self.index]

    def probabilities(self, words: Sequence[str]) -> np.ndarray:
        at = self.rows(words)
        scores = (self.weights[at].sum(axis=0) / max(1.0, len(at)) ** 0.5 + self.weights[-1]) / self.temperature
        scores = np.exp(scores - scores.max())
        return scores / scores.sum()

    def containment(self, words: Sequence[str], family: str) -> float:
        """Greatest share of common trigrams, of the smaller side, with one template of the family."""
        own = trigrams(words)
        return max(len(own & t) / min(len(own), len(t)) for t in self.templates[family])

    def judge(self, paragraph: str) -> tuple[str, float, float]:
        """(family or unknown, probability, containment) of one paragraph."""
        words = WORDS(paragraph.lower())
        p = self.probabilities(words)
        best = int(p.argmax())
        if not words or self.families[best] == UNKNOWN or p[best] < LEAST:
            return UNKNOWN, float(p[self.families.index(UNKNOWN)]), 0.0
        return self.families[best], float(p[best]), self.containment(words, self.families[best])

    def findings(self, text: str | None) -> list[dict]:
        """Confirmed paragraphs of a text, in order, numbered by line from 0."""
        if not text or self.signs.isdisjoint(WORDS(text.lower())):
            return []
        out = []
        for number, line in enumerate(text.split("\n")):
            words = WORDS(line.lower())
            if self.signs.isdisjoint(words):
                continue
            family, p, common = self.judge(line)
            if family != UNKNOWN and common >= SHARED:
                out.append({"line": number, "family": family, "probability": round(p, 6), "containment": round(common, 6)})
        return out


def train(table: Sequence[tuple[str, list[str]]] | None = None, rounds: int = 300, ridge: float = 1e-3,
          rate: float = 0.1) -> Scanner:
    """Fit on (family, words) rows; every fifth row is held out for the temperature."""
    table = pieces() if table is None else list(table)
    families = sorted({f for f, _ in table} | {UNKNOWN})
    index = {g: i for i, g in enumerate(sorted({g for _, w in table for g in ngrams(w)}))}
    known = {f: [trigrams(WORDS(line.lower())) for line in TEMPLATES.get(f, ())] for f in families if f != UNKNOWN}
    signs = frozenset(max(t, key=lambda w: (len(w), w)) for ts in known.values() for t3 in ts for t in t3)
    scanner = Scanner(families, index, np.zeros((len(index) + 1, len(families))), 1.0, known, signs)
    label = np.array([families.index(f) for f, _ in table])
    held = np.arange(len(table)) % 5 == 4

    def parts(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [scanner.rows(table[i][1]) for i in np.flatnonzero(which)]
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        col = np.array([c for f in found for c in f], dtype=np.int64)
        return row, col, np.repeat([1 / max(1, len(f)) ** 0.5 for f in found], [len(f) for f in found])

    def scores(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        out = np.tile(scanner.weights[-1], (n, 1))
        np.add.at(out, row, scanner.weights[col] * value[:, None])
        return out

    row, col, value = parts(~held)
    truth = np.eye(len(families))[label[~held]]
    speed = np.full_like(scanner.weights, 1e-8)
    for _ in range(rounds):
        s = scores(row, col, value, len(truth))
        p = np.exp(s - s.max(axis=1, keepdims=True))
        surplus = p / p.sum(axis=1, keepdims=True) - truth
        slope = np.zeros_like(scanner.weights)
        np.add.at(slope, col, surplus[row] * value[:, None])
        slope[-1] = surplus.sum(axis=0)
        slope = slope / len(truth) + ridge * scanner.weights
        speed += slope**2
        scanner.weights -= rate * slope / np.sqrt(speed)
    row, col, value = parts(held)
    s, of = scores(row, col, value, int(held.sum())), label[held]

    def loss(t: float) -> float:
        z = s / t - (s / t).max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(of)), of]))

    scanner.temperature = min((float(t) for t in np.geomspace(0.2, 5, 41)), key=loss)
    return scanner


FINDING = "array<struct<line: int, family: string, probability: double, containment: double>>"
FINDING_ARROW = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()),
                                    ("containment", pa.float64())]))


def find(text: Column, shared_scanner) -> Column:
    """Confirmed licence paragraphs of a text column."""

    @F.arrow_udf(FINDING)
    def licence_findings(texts: pa.Array) -> pa.Array:
        scanner = shared_scanner.value
        return pa.array([scanner.findings(t.as_py()) for t in texts], type=FINDING_ARROW)

    return licence_findings(text)


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """``doc_id``, ``line``, ``family``, ``probability``, ``containment`` of every confirmed paragraph."""
    spark = docs.sparkSession
    ship(spark)
    shared_scanner = spark.sparkContext.broadcast(train() if scanner is None else scanner)
    found = docs.select("doc_id", F.explode(find(F.col("text"), shared_scanner)).alias("of"))
    return found.select("doc_id", "of.line", "of.family", "of.probability", "of.containment")
