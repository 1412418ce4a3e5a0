"""Licence scans with a trained paragraph classifier, confirmed by templates.

Texts are cut into paragraphs: neighbouring lines, with lines without a letter or digit as
borders. Comment marks are no words. In a paragraph, stretches of words that hold most of a
notice's n-grams are looked for, also across line ends. A sparse logistic regression over
hashed word n-grams (one to three words) gives each stretch a probability per licence family
and for ``unknown``. It is trained on the notices below, on variants of them (words dropped, years
and names put in, text around them) and, as ``unknown``, on lines of a bounded sample of the
corpus that share no rare n-gram with any notice. A temperature fitted on held-back
variants and lines calibrates the probabilities. A family above ``least`` is a prediction;
it counts if most of the n-grams of one of the family's templates occur in the stretch. Of
stretches that overlap the best covered one counts, so a paragraph may hold several families.
A line that no such stretch touches is also judged as a whole, for looser notices.

Training is one bounded local step; the scan is one pass over all texts, where a table
of the notices' words lets lines without any of their pairs of words pass at once. Every
paragraph is judged, whatever its length.

Defined cases: a null text is empty and has no licences; a text, a paragraph and a line may
hold several families; a notice is reported at the line it starts on, once per family and line;
equal texts have equal results; repeated rows and ids stay; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

# fixed values: notices by which public licences are declared
NOTICES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "Released under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 2",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International"
        " License",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal",
        "This work has been dedicated to the public domain under CC0",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "isc": ("Licensed under the ISC License", "SPDX-License-Identifier: ISC"),
}
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *NOTICES)

WIDTH = 1 << 15
SAMPLE_DOCUMENTS = 500  # bound of the corpus sample that ``unknown`` is learned from
SAMPLE_LINES = 1000
_WORD = re.compile(r"[a-z0-9]+")
_FILLED = re.compile(r"[^\W_]")


def words(paragraph: str) -> list[str]:
    """Lower-case words; version numbers don't tell families apart."""
    return ["0" if w.isdigit() else w for w in _WORD.findall(paragraph.lower())]


def grams(own: list[str]) -> list[str]:
    return [" ".join(own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)]


def _columns(own: list[str]) -> np.ndarray:
    return np.unique([zlib.crc32(g.encode()) % WIDTH for g in grams(own)]).astype(np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # (WIDTH, families)
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[frozenset[str]]]
    pairs: frozenset[str]  # two-word n-grams of all notices
    each: list[tuple[str, int, frozenset[str]]]  # family, words and template of each notice
    users: dict[str, list[int]]  # the notices with a pair, as places in ``each``

    def probabilities(self, own: list[str]) -> np.ndarray:
        columns = _columns(own)
        score = self.bias + self.weights[columns].sum(axis=0) / np.sqrt(max(1, len(columns)))
        return _softmax(score[None] / self.temperature)[0]

    def notices(
        self, lines: list[list[str]], least: float, share: float
    ) -> list[tuple[int, str, float, float]]:
        """(line, family, probability, share of the template found) of a paragraph's notices."""
        own = [w for line in lines for w in line]
        pairs = [f"{a} {b}" for a, b in zip(own, own[1:])]
        hits = [i for i, pair in enumerate(pairs) if pair in self.pairs]
        if not hits:
            return []
        starts, at = [], 0
        for line in lines:
            starts.append(at)
            at += len(line)
        touched, found = bytearray(len(own)), {}
        for covered, family, start, end in sorted(
            self._stretches(own, pairs, hits, share), key=lambda x: (-x[0], x[2], x[3], x[1])
        ):
            if any(touched[start:end]):
                continue
            chances = self.probabilities(own[start:end])
            place = int(chances.argmax())
            if FAMILIES[place] == family and chances[place] >= least:
                touched[start:end] = b"\1" * (end - start)
                line = bisect_right(starts, start) - 1
                found.setdefault((line, family), (float(chances[place]), covered))
        for n in sorted({bisect_right(starts, i) - 1 for i in hits}):
            if any(touched[starts[n] : starts[n] + len(lines[n])]):
                continue
            for family, chance, covered in self.loose(lines[n], least, share):
                if (chance, covered) > found.get((n, family), (0, 0)):
                    found[n, family] = (chance, covered)
        return [(line, family, *found[line, family]) for line, family in sorted(found)]

    def _stretches(
        self, own: list[str], pairs: list[str], hits: list[int], share: float
    ) -> Iterator[tuple[float, str, int, int]]:
        """(covered, family, start, end): words from one pair of a template to another."""
        where = defaultdict(list)
        for i in hits:
            for t in self.users[pairs[i]]:
                where[t].append(i)
        for t, places in where.items():
            family, length, template = self.each[t]
            # with fewer pairs there are too few triples, too, even if all words are there
            single = sum(" " not in g for g in template)
            need = max(1.0, (share * len(template) - single) / 2)
            if len(places) < need:
                continue
            end = 0
            for n, start in enumerate(places):
                end = max(end, n)
                while end < len(places) and places[end] + 2 - start <= length + max(2, length // 4):
                    end += 1
                if end - n < need:
                    continue
                stop = places[end - 1] + 2
                covered = len(template & set(grams(own[start:stop]))) / len(template)
                if covered >= share:
                    yield covered, family, start, stop

    def loose(self, own: list[str], least: float, share: float) -> list[tuple[str, float, float]]:
        """(family, probability, share of the best template found) of the parts of a line."""
        out = []
        if any(f"{a} {b}" in self.pairs for a, b in zip(own, own[1:])):
            # a long line is judged where the notices' words are
            for window in self._windows(own):
                chances = self.probabilities(window)
                at = int(chances.argmax())
                if FAMILIES[at] == UNKNOWN or chances[at] < least:
                    continue
                found = set(grams(window))
                covered = max(len(t & found) / len(t) for t in self.templates[FAMILIES[at]])
                if covered >= share:
                    out.append((FAMILIES[at], float(chances[at]), covered))
        return out

    def _windows(self, own: list[str], around: int = 24) -> list[list[str]]:
        """Stretches of words around the notices' pairs of words; together all of these."""
        if len(own) <= 2 * around:
            return [own]
        hits = [i for i, (a, b) in enumerate(zip(own, own[1:])) if f"{a} {b}" in self.pairs]
        out, start, end = [], hits[0], hits[0]
        for i in [*hits[1:], len(own) + around]:
            if i - start > around or i - end > around // 2:
                out.append(own[max(0, start - 2) : end + 4])
                start = i
            end = i
        return out


def _softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _variants(notice: str, count: int, rng: np.random.Generator, around: list[list[str]]) -> list[list[str]]:
    """The notice as it is and with words dropped or other words around it."""
    own = words(notice)
    out = [own]
    for _ in range(count):
        kept = [w for w in own if rng.random() > 0.08] or own
        if around and rng.random() < 0.5:
            extra = around[rng.integers(len(around))]
            cut = int(rng.integers(0, min(6, len(extra)) + 1))
            kept = extra[:cut] + kept + extra[cut : cut + int(rng.integers(0, 5))]
        out.append(kept)
    return out


def fit(lines: list[str], rounds: int = 60, rate: float = 4.0, seed: int = 5) -> Model:
    """Train on the notices and on ``lines`` of the corpus as unknown."""
    rng = np.random.default_rng(seed)
    templates = {f: [frozenset(grams(words(n))) for n in ns] for f, ns in NOTICES.items()}
    pairs = frozenset(
        f"{a} {b}" for ns in NOTICES.values() for n in ns for a, b in zip(words(n), words(n)[1:])
    )
    each = [(f, len(words(n)), frozenset(grams(words(n)))) for f, ns in NOTICES.items() for n in ns]
    users = {pair: [t for t, (_, _, own) in enumerate(each) if pair in own] for pair in pairs}
    split = [words(line) for line in sorted(set(lines))]
    plain = [w for w in split if w and not any(f"{a} {b}" in pairs for a, b in zip(w, w[1:]))]
    rows, labels = [], []
    for at, family in enumerate(FAMILIES):
        for notice in NOTICES.get(family, ()):
            for own in _variants(notice, 40, rng, plain):
                rows.append(own)
                labels.append(at)
    # words of notices out of their order are unknown, too
    every = sorted({w for ns in NOTICES.values() for n in ns for w in words(n)})
    mixed = [[every[i] for i in rng.integers(0, len(every), rng.integers(2, 9))] for _ in range(300)]
    for own in [*plain[:SAMPLE_LINES], *mixed]:
        rows.append(own)
        labels.append(0)
    columns = [_columns(own) for own in rows]
    label = np.array(labels)
    held = np.arange(len(rows)) % 5 == 4
    weights, bias = np.zeros((WIDTH, len(FAMILIES))), np.zeros(len(FAMILIES))
    sizes = np.array([max(1, len(c)) for c in columns])
    flat = np.concatenate(columns)
    row_of = np.repeat(np.arange(len(rows)), [len(c) for c in columns])
    value = 1 / np.sqrt(sizes[row_of])
    use = ~held[row_of]
    used, place = np.unique(flat, return_inverse=True)
    own_weights = np.zeros((len(used), len(FAMILIES)))
    truth = np.eye(len(FAMILIES))[label]
    count = np.bincount(label[~held], minlength=len(FAMILIES))
    importance = np.where(held, 0, 1 / np.sqrt(np.maximum(1, count[label])))

    def scores() -> np.ndarray:
        total = np.zeros((len(rows), len(FAMILIES)))
        np.add.at(total, row_of, own_weights[place] * value[:, None])
        return total + bias

    for _ in range(rounds):
        error = (_softmax(scores()) - truth) * importance[:, None]
        step = np.zeros_like(own_weights)
        np.add.at(step, place[use], error[row_of[use]] * value[use][:, None])
        own_weights -= rate * (step + 1e-4 * own_weights)
        bias -= 0.1 * rate * error.sum(axis=0) / 10
    weights[used] = own_weights
    # temperature: the one under which the held-back rows are likeliest
    final = scores()[held]
    options = np.geomspace(0.2, 5, 40)
    loss = [-np.log(_softmax(final / t)[np.arange(len(final)), label[held]] + 1e-12).mean() for t in options]
    return Model(weights, bias, float(options[int(np.argmin(loss))]), templates, pairs, each, users)


def train(
    docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, sample_lines: int = 3 * SAMPLE_LINES
) -> Model:
    """Fit with at most ``sample_lines`` lines out of the whole texts of at most
    ``sample_documents`` documents; a hash chooses both."""
    whole = texts(docs).withColumn("mark", F.xxhash64("text"))
    # places first, so that no task carries the texts of all that it compares
    chosen = whole.select("doc_id", "mark").orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(sample_documents)
    own = F.broadcast(chosen.toDF("own_id", "own_mark").distinct())
    met = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))
    lines = whole.join(own, met, "left_semi").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    drawn = lines.orderBy(F.xxhash64("line"), "line").limit(sample_lines)
    return fit([r["line"] for r in drawn.collect()])


FOUND = "array<struct<line:int,family:string,probability:double,covered:double>>"


def _paragraphs(text: str) -> Iterator[tuple[int, list[str]]]:
    """(number of the first line, lines) of the runs of lines that hold a letter or digit."""
    lines: list[str] = []
    every = text.split("\n")
    for n, line in enumerate(every):
        if _FILLED.search(line):
            lines.append(line)
        elif lines:
            yield n - len(lines), lines
            lines = []
    if lines:
        yield len(every) - len(lines), lines


def scan(docs: DataFrame, model: Model, least: float = 0.6, share: float = 0.6) -> DataFrame:
    """docs(doc_id, text) -> doc_id, found FOUND: the paragraphs that declare a licence."""
    small_batches(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    # a paragraph without any of these can't hold a pair of a notice's words
    starts = sorted({p.split(" ")[0] for p in model.pairs} - {"0"}, key=len)
    maybe = re.compile("|".join(rf"\b{re.escape(w)}\b" for w in starts), re.IGNORECASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        item = pa.list_(
            pa.struct(
                [("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("covered", pa.float64())]
            )
        )
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = []
                for first, lines in _paragraphs(text):
                    if any(map(maybe.search, lines)):
                        for n, family, chance, covered in own.notices([words(x) for x in lines], least, share):
                            found.append(dict(line=first + n, family=family, probability=chance, covered=covered))
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, item)], names=["doc_id", "found"])

    return texts(docs).mapInArrow(run, f"doc_id long, found {FOUND}")
