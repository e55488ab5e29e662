"""License scans: a trained paragraph classifier, confirmed against templates.

A paragraph is a line, or a join of neighbouring lines that hold words, as notices are
wrapped: where no line of it is a finding by itself, the first and shortest join that is
one counts, with the lines after it that add to its template, and is reported by its
first line. A join goes back until it has REACH words before its last line, and takes REACH
words of a longer line, from the end that it meets (signs, as of comments, are no words).
Its features are the word 1- to 3-grams that occur in the license templates; a softmax regression over them tells the families and the class
``unknown`` apart. It is trained on the templates, on copies of them with words lost or
added (seeded), and on a bounded sample of the corpus' own paragraphs as ``unknown``
(SAMPLE different lines, smallest hash first, none with PART word pairs of a template,
as parts of wrapped notices have). Its probabilities are calibrated: a
temperature is fitted on a part kept out of training, and what stays below
LEAST_CHANCE is unknown.

A prediction counts only if the paragraph holds at least CONFIRM of the word pairs of
one of the family's templates. A paragraph without any such pair can thus not be a
finding, so the classifier is not asked.

Null texts have no paragraphs, texts of any length are read whole, repeated rows give
repeated findings. Other columns play no part.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


SAMPLE, CONFIRM, LEAST_CHANCE = 1000, 0.6, 0.5
#: Words of a join before its last line, far more than any template has; word pairs of one template by which a line may be part of a notice.
REACH, PART = 100, 4
UNKNOWN = "unknown"

#: Notices by family: fixed values.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    ),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License.",),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "all-rights-reserved": ("All rights reserved.", "Copyright. All rights reserved."),
}

_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


class Templates:
    """The families' templates as word pairs."""

    def __init__(self):
        self.pairs = {family: [pairs(words_of(t)) for t in texts] for family, texts in TEMPLATES.items()}
        self.any_pair = set().union(*(p for held in self.pairs.values() for p in held))
        self.any_word = {w for p in self.any_pair for w in p}
        held = [p for sets in self.pairs.values() for p in sets]
        self.sizes = [len(p) for p in held]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for number, one in enumerate(held):
            for pair in one:
                self.holders.setdefault(pair, []).append(number)

    def similarity(self, family: str, found: set[tuple[str, str]]) -> float:
        """The largest share of a template's pairs that is found."""
        return max((len(p & found) / len(p) for p in self.pairs.get(family, ())), default=0.0)

    def best(self, found: set[tuple[str, str]]) -> float:
        return max(self.similarity(family, found) for family in self.pairs)

    def unlike(self, found: set[tuple[str, str]]) -> bool:
        """Neither a notice nor part of one."""
        return self.best(found) < CONFIRM and max(len(p & found) for held in self.pairs.values() for p in held) < PART


def examples(unknown: list[str], seed: int = 3) -> list[tuple[list[str], str]]:
    """Training paragraphs as words, with their family."""
    rng = random.Random(seed)
    filler = [w for text in unknown for w in words_of(text)] or ["and", "of", "in"]
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = words_of(text)
            out.append((words, family))
            for _ in range(30):
                kept = [w for w in words if rng.random() > 0.1] or words
                around = [rng.choice(filler) for _ in range(rng.randrange(12))]
                cut = rng.randrange(len(around) + 1)
                out.append(([*around[:cut], *kept, *around[cut:]], family))
    out += [(words_of(text), UNKNOWN) for text in unknown]
    # paragraphs that only use the templates' words say nothing either
    loose = sorted({w for texts in TEMPLATES.values() for t in texts for w in words_of(t)})
    out += [([rng.choice(loose) for _ in range(rng.randrange(0, 9))], UNKNOWN) for _ in range(300)]
    return out


class Classifier:
    """Softmax regression over the n-grams of the templates, with a fitted temperature."""

    def __init__(self, rows: list[tuple[list[str], str]], steps: int = 400):
        self.families = [*TEMPLATES, UNKNOWN]
        known = sorted(set().union(*(grams(words_of(t)) for texts in TEMPLATES.values() for t in texts)))
        self.column = {g: i for i, g in enumerate(known)}
        held = np.arange(len(rows)) % 5 == 4
        x = np.zeros((len(rows), len(known) + 1))
        for i, (words, _) in enumerate(rows):
            x[i, [self.column[g] for g in grams(words) if g in self.column]] = 1
        x[:, -1] = 1
        y = np.array([self.families.index(f) for _, f in rows])
        target = np.eye(len(self.families))[y]
        w, speed = np.zeros((x.shape[1], len(self.families))), 0.0
        fit_x, fit_y = x[~held], target[~held]
        for _ in range(steps):
            slope = fit_x.T @ (_softmax(fit_x @ w) - fit_y) / len(fit_x) + 1e-4 * w
            speed = 0.9 * speed - 0.5 * slope
            w = w + speed
        self.weights = w
        logits = x[held] @ w
        losses = [(-np.log(_softmax(logits / t)[np.arange(held.sum()), y[held]] + 1e-12).mean(), t) for t in np.geomspace(0.2, 5, 40)]
        self.temperature = min(losses)[1]

    def predict(self, words: list[str]) -> tuple[str, float]:
        at = [self.column[g] for g in grams(words) if g in self.column]
        chances = _softmax((self.weights[at].sum(axis=0) + self.weights[-1])[None, :] / self.temperature)[0]
        best = int(chances.argmax())
        return (self.families[best], float(chances[best])) if chances[best] >= LEAST_CHANCE else (UNKNOWN, float(chances[-1]))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on the templates and on a bounded sample of the documents' paragraphs."""
    hashed = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line"))
    hashed = hashed.select("line", F.xxhash64("line").alias("hash"))
    # the hashes alone are ranked; of the texts only the chosen ones are moved
    total = hashed.agg(F.approx_count_distinct("hash").alias("n")).first().n or 0
    share = min(1.0, 1.5 * sample / max(1, total))
    near = hashed.filter(F.col("hash") <= int(-(2**63) + share * (2**64 - 1))) if share < 1 else hashed
    last = near.select("hash").distinct().orderBy("hash").limit(sample).agg(F.max("hash").alias("last")).first().last
    chosen = [] if last is None else [r.line for r in hashed.filter(F.col("hash") <= last).select("line").distinct().collect()]
    templates = Templates()
    return Classifier(examples(sorted(x for x in chosen if templates.unlike(pairs(words_of(x))))))


def _judged(words: list[str], model: Classifier, templates: Templates) -> tuple[str, float, float] | None:
    """Family, chance and similarity of a paragraph that is a finding."""
    found = templates.any_pair & pairs(words)
    if not found or templates.best(found) < CONFIRM:
        return None
    family, chance = model.predict(words)
    similarity = templates.similarity(family, found)
    return (family, chance, similarity) if similarity >= CONFIRM else None


class _Seen:
    """Counts each template's pairs while words are put in front, so that a longer join is not counted anew."""

    def __init__(self, templates: Templates) -> None:
        self.templates, self.pairs, self.counts, self.enough = templates, set(), [0] * len(templates.sizes), False

    def add(self, words: list[str]) -> None:
        for pair in zip(words, words[1:], strict=False):
            if pair in self.templates.holders and pair not in self.pairs:
                self.pairs.add(pair)
                for t in self.templates.holders[pair]:
                    self.counts[t] += 1
                    self.enough |= self.counts[t] / self.templates.sizes[t] >= CONFIRM


def _joined(lines: list[tuple[int, list[str]]], model: Classifier, templates: Templates) -> Iterator[tuple[int, str, float, float]]:
    """Findings among the joins of neighbouring lines (number, words) of which none is a finding itself."""
    if len(lines) < 2 or templates.best(templates.any_pair & pairs([w for _, words in lines for w in words])) < CONFIRM:
        return
    floor = end = 0
    while end < len(lines):
        held, start, judged, before = lines[end][1][:REACH], end, None, 0
        seen = _Seen(templates)
        seen.add(held)
        while start > floor and judged is None and before < REACH:
            start -= 1
            line = lines[start][1][-REACH:]
            seen.add([*line, *held[:1]])
            held = line + held
            before += len(lines[start][1])
            if seen.enough:
                judged = _judged(held, model, templates)
        end += 1
        if judged is None:
            continue
        while end < len(lines):
            longer = held + lines[end][1][:REACH]
            more = _judged(longer, model, templates)
            if more is None or more[0] != judged[0] or more[2] <= judged[2]:
                break
            held, judged, end = longer, more, end + 1
        yield lines[start][0], *judged
        floor = end


def notices(text: str, model: Classifier, templates: Templates) -> list[tuple[int, str, float, float]]:
    """Line (from 0), family, chance and similarity of every finding of a text."""
    if not templates.any_pair & pairs(words_of(text)):
        return []
    out, block = [], []
    for number, line in enumerate([*text.split("\n"), ""]):
        words = words_of(line)
        alone = _judged(words, model, templates) if len(templates.any_word.intersection(words)) > 1 else None
        if words and alone is None:
            block.append((number, words))
            continue
        out += _joined(block, model, templates)
        block = []
        if alone is not None:
            out.append((number, *alone))
    return out


def _find(classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, templates = classifier.value, Templates()
        names = ["doc_id", "paragraph", "family", "chance", "similarity"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for found in notices(text or "", model, templates):
                    for column, cell in zip(out, (doc_id, *found), strict=True):
                        column.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return run


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 0), family, chance, similarity of every confirmed license paragraph."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find(model), "doc_id bigint, paragraph bigint, family string, chance double, similarity double")
