"""Licence scans: headers and licence files against templates by sparse TF-IDF cosine, then inheritance down the
directory tree.

Units of a text are sparse vectors of their words: its lines, and windows of 0.75 to 1.5 times a template's length over
its words, across line ends and inside lines. A word of some template weighs by the share of texts it occurs in, counted
over all texts; shares under ``RARE`` weigh alike, and so does any other word, since it speaks against the template. No
weight depends on the number of texts. A unit declares a template's licence by a cosine from ``THRESHOLD`` on, if it
holds the words that tell the template's licence and version from others (``REQUIRED``, ``NAMES`` and numbers) and no
other of ``NAMES``. A text in a licence file is a unit of its own as well, against whole licence texts, from ``WHOLE``
on. A text's own licence is its best unit's: the whole text, earlier lines and templates first on ties; a licence whose
wording includes another's (``INCLUDES``) goes before that.

A text without an own licence takes that of the nearest directory above it that has a licence file: a file named
LICENSE, LICENCE or COPYING, whatever its case and suffix, with an own licence (the first by name on ties). Directories
are resolved once each, by joining the paths of their ancestors with the directories that have licence files, and then
joined to the files, so a directory that holds a third of all files is one row until the last join.

Templates are a fixed list. Null and empty texts and units without words declare nothing; null paths inherit nothing.
Repeated rows are scanned each for itself. An empty table gives an empty result. Added columns replace those of the
same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.jaccard import written
from palimpsest.llm.licence_texts import TEXTS

THRESHOLD = 0.8
RARE = 0.01  # words in a smaller share of the texts weigh as words in this share
WHOLE = 0.9

# Licence names and the wording of their usual headers, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   'Licensed under the Apache License, Version 2.0 (the "License");', "Apache License Version 2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International"],
    "CC0-1.0": ["Licensed under CC0 1.0.", "CC0 1.0 Universal"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
                     " promote products derived from this software without specific prior written permission"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "ISC": ["Licensed under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
            " granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "Mozilla Public License Version 2.0"],
}
for _kind, _called, _versions in (("GPL", "GNU General Public License", ("2.0", "3.0")),
                                  ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")),
                                  ("AGPL", "GNU Affero General Public License", ("3.0",))):
    for _version in _versions:
        _short = _version.removesuffix(".0")
        TEMPLATES[f"{_kind}-{_version}"] = [
            f"This work is licensed under the {_called}, version {_short}.", f"{_called} Version {_short}",
            f"Licensed under the {_called}, version {_short}.", f"version {_short} of the {_called}",
            f"under the terms of the {_called} as published by the Free Software Foundation, either version {_short} of the"
            " License", *(f"SPDX-License-Identifier: {_kind}-{_version}{end}" for end in ("-only", "-or-later"))]
for _name, _lines in TEMPLATES.items():
    _lines.append(f"SPDX-License-Identifier: {_name}")
# Names that tell licences apart: a unit holds just those of its template. The others it holds at least.
NAMES = frozenset("gnu lesser library affero apache mozilla bsd isc mit nc sa nd noncommercial sharealike noderivatives"
                  " attribution attribution-noncommercial attribution-sharealike".split())
REQUIRED = frozenset("cc by by-nc by-sa neither endorse redistribution binary appear fee".split())
INCLUDES = {"BSD-3-Clause": "BSD-2-Clause"}

_WORD = re.compile(r"[\w.+-]*\w")
_BREAK = re.compile(r"\r\n|\r|\n")
_FILE = r"(?i)^(licen[sc]e|copying)(\..*)?$"


def words(line: str) -> list[str]:
    return _WORD.findall(line.lower())


WHOLE_TEXTS = {name: dict(zip(counts.split()[::2], map(int, counts.split()[1::2]))) for name, counts in TEXTS.items()}
VOCABULARY = frozenset(w for lines in TEMPLATES.values() for line in lines for w in words(line)).union(
    *WHOLE_TEXTS.values())


def marks(given: Iterable[str]) -> set[str]:
    """The words that tell licences apart; of numbers, v2 and 2.0 are 2."""
    out = set()
    for w in given:
        if any(c.isdigit() for c in w):
            out.add(w.removeprefix("v").removesuffix(".0"))
        elif w in NAMES or w in REQUIRED:
            out.add(w)
    return out


class Template(NamedTuple):
    name: str
    vector: dict[str, float]
    size: int
    marks: set[str]
    witnesses: set[str]

    def tells(self, held: set[str]) -> bool:
        return self.marks <= held and held & NAMES <= self.marks


class Scorer:
    """Cosines with all templates, for word counts over ``n`` texts."""

    def __init__(self, n: int, texts_with: dict[str, int]):
        self.weight = {w: 1 - math.log(max(texts_with.get(w, 0) / max(n, 1), RARE)) for w in VOCABULARY}
        self.rare = 1 - math.log(RARE)
        self.templates = [self._template(name, words(line)) for name, lines in TEMPLATES.items() for line in lines]
        self.witnesses = set().union(*(t.witnesses for t in self.templates))
        self.whole = {name: self._unit(counts) for name, counts in WHOLE_TEXTS.items()}

    def _template(self, name: str, given: list[str]) -> Template:
        # By the Cauchy-Schwarz inequality a unit has cosine THRESHOLD with a template only if the words they share
        # hold THRESHOLD ** 2 of its squares, so it has one of the heaviest words that hold more than the rest.
        vector, held, witnesses = self._vector(given), 0.0, set()
        for w, v in sorted(vector.items(), key=lambda x: -x[1]):
            if held > 1 - THRESHOLD ** 2 + 1e-9:
                break
            witnesses.add(w)
            held += v * v
        return Template(name, vector, len(given), marks(given), witnesses)

    def _unit(self, counts: dict[str, int]) -> dict[str, float]:
        raw = {w: c * self.weight.get(w, self.rare) for w, c in counts.items()}
        size = math.sqrt(sum(v * v for v in raw.values()))
        return {w: v / size for w, v in raw.items()}

    def _vector(self, given: list[str]) -> dict[str, float]:
        return self._unit(Counter(given))

    def best(self, line: str) -> tuple[str | None, float]:
        """The template of largest cosine from THRESHOLD on with a line as one unit, and that cosine."""
        given = words(line)
        if self.witnesses.isdisjoint(given):
            return None, 0.0
        vector, held = self._vector(given), marks(given)
        found: tuple[str | None, float] = (None, 0.0)
        for t in self.templates:
            if t.tells(held):
                cosine = sum(v * vector[w] for w, v in t.vector.items() if w in vector)
                if cosine >= THRESHOLD - 1e-12 and cosine > found[1] + 1e-12:
                    found = (t.name, cosine)
        return found

    def _window(self, t: Template, given: list[str], weights: list[float]) -> tuple[float, int, int] | None:
        """Cosine and bounds of the best window; every step adds one word and takes one away."""
        lengths = sorted({math.ceil(t.size * x) for x in (0.75, 1, 1.25, 1.5)})
        reach = lengths[-1]
        regions: list[list[int]] = []
        for at, w in enumerate(given):
            if w in t.witnesses:
                a, b = max(0, at - reach + 1), min(len(given), at + reach)
                if regions and a <= regions[-1][1]:
                    regions[-1][1] = b
                else:
                    regions.append([a, b])
        best = None
        for a, b in regions:
            for length in lengths:
                counts: dict[str, int] = {}
                dot = squares = 0.0
                for i in range(a, b):
                    w, x = given[i], weights[i]
                    c = counts.get(w, 0)
                    counts[w] = c + 1
                    squares += x * x * (2 * c + 1)
                    dot += x * t.vector.get(w, 0.0)
                    if i - a >= length:
                        w, x = given[i - length], weights[i - length]
                        c = counts[w]
                        counts[w] = c - 1
                        squares -= x * x * (2 * c - 1)
                        dot -= x * t.vector.get(w, 0.0)
                    start = max(a, i - length + 1)
                    least = best[0] if best else THRESHOLD
                    later = best is not None and start >= best[1]  # on ties the first window stays
                    if dot > 0 and dot * dot >= (least * least + (1e-9 if later else -1e-9)) * squares:
                        if t.tells(marks(given[start:i + 1])):
                            vector = self._vector(given[start:i + 1])
                            cosine = sum(v * vector[w] for w, v in t.vector.items() if w in vector)
                            if cosine >= THRESHOLD - 1e-12 and (
                                    not best or cosine > best[0] + 1e-12 or cosine > best[0] - 1e-12 and start < best[1]):
                                best = (cosine, start, i + 1)
                    elif later and best[0] > 1 - 1e-12:
                        break
        return best

    def declares(self, text: str, licence_file: bool = False) -> tuple[str | None, float, int | None]:
        """A text's own licence, its score and its line."""
        given = words(text)
        found: dict[str, tuple[float, int]] = {}

        def take(name: str, score: float, number: int) -> None:
            had = found.get(name)
            if not had or score > had[0] + 1e-12 or score > had[0] - 1e-12 and number < had[1]:
                found[name] = (score, number)
        if not self.witnesses.isdisjoint(given):
            given, lines = [], []
            for number, line in enumerate(_BREAK.split(text), 1):
                name, score = self.best(line)
                if name:
                    take(name, score, number)
                held = words(line)
                given += held
                lines += [number] * len(held)
            distinct, held = set(given), marks(given)
            weights = [self.weight.get(w, self.rare) for w in given]
            for t in self.templates:
                if t.marks <= held and not t.witnesses.isdisjoint(distinct):
                    if window := self._window(t, given, weights):
                        first = next(i for i in range(window[1], window[2]) if given[i] in t.vector)
                        take(t.name, window[0], lines[first])
        for name, included in INCLUDES.items():
            if name in found:
                found.pop(included, None)
        best: tuple[str | None, float, int | None] = (None, 0.0, None)
        if licence_file and given:
            vector = self._vector(given)
            for name, whole in self.whole.items():
                cosine = sum(v * whole[w] for w, v in vector.items() if w in whole)
                if cosine >= WHOLE and cosine > best[1] + 1e-12:
                    best = (name, cosine, 1)
        for name in TEMPLATES:
            if name in found:
                score, number = found[name]
                if score > best[1] + 1e-12 or score > best[1] - 1e-12 and number < best[2]:
                    best = (name, score, number)
        return best


def _statistics(docs: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """Number of texts, and of texts with each word of the templates: a table as long as the templates."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, Counter()
        for batch in batches:
            for value in batch.column("text").to_pylist():
                n += 1
                seen.update(VOCABULARY.intersection(words(value or "")))
        yield pa.RecordBatch.from_pydict({"word": ["", *seen], "n": [n, *seen.values()]},
                                         schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))
    rows = docs.select(docs[text].cast("string").alias("text")).mapInArrow(count, "word string, n bigint").groupBy(
        "word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def declared(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), path: str = "path") -> DataFrame:
    """Columns ``keep``, then own_licence, own_score and own_line (its number from 1), null without a declaration.

    Without a column ``path`` no text counts as a licence file."""
    scorer = Scorer(*_statistics(docs, text))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scorer.declares(value or "", bool(at) and bool(re.match(_FILE, at.rsplit("/", 1)[-1])))
                     for value, at in zip(batch.column("text").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f"k{i}") for i in range(len(keep))), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] if f[0] else None for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.int64())],
                [*(f"k{i}" for i in range(len(keep))), "own_licence", "own_score", "own_line"])
    given = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)),
                        docs[text].cast("string").alias("text"),
                        (docs[path] if path in docs.columns else F.lit(None)).cast("string").alias("path"))
    kinds = "".join(f"k{i} {given.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    out = given.mapInArrow(scan, f"{kinds}own_licence string, own_score double, own_line bigint")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "own_licence", "own_score", "own_line")


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` (with own_licence) plus licence, and whence: ``own``, the directory it comes from, or null."""
    files = files.withColumn("_dir", parent(F.col(path)))
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    holders = written(files.filter(F.col("own_licence").isNotNull() & name.rlike(_FILE)).groupBy("_dir").agg(
        F.min(F.struct(name.alias("name"), F.col("own_licence").alias("licence")))["licence"].alias("licence")), "holders")
    parts = F.split("_dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    tree = files.filter(F.col("_dir").isNotNull()).select("_dir").distinct().select(
        F.col("_dir").alias("_leaf"), F.explode(F.array_distinct(above)).alias("_dir"))
    nearest = written(tree.join(holders, "_dir").groupBy("_leaf").agg(F.max(F.struct(
        F.length("_dir").alias("depth"), F.col("_dir").alias("from"), F.col("licence").alias("licence"))).alias("near"))
        .select(F.col("_leaf").alias("_dir"), F.col("near.from").alias("_from"), F.col("near.licence").alias("_licence")),
        "nearest")
    return files.join(nearest, "_dir", "left").withColumn(
        "licence", F.coalesce("own_licence", "_licence")).withColumn(
        "whence", F.when(F.col("own_licence").isNotNull(), "own").otherwise(
            F.concat(F.lit("/"), F.col("_from")))).drop("_dir", "_from", "_licence")
