"""Licence scans against a plain scorer over all lines and a walk up the tree; odd rows."""

import math
import re
from collections import Counter

from palimpsest.llm import licences as L
from palimpsest.llm import queries


def plain(docs):
    """doc -> (licence, line): TF-IDF cosine of every line with every template, without any shortcut."""
    n = len(docs)
    seen = Counter(w for text in docs.values() for w in set(L.words(text or "")) if w in L.VOCABULARY)
    weigh = lambda w: math.log((1 + n) / (1 + seen[w])) + 1

    def vector(line):
        return {w: c * weigh(w) for w, c in Counter(L.words(line)).items()}

    def cosine(a, b):
        size = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return sum(v * b.get(w, 0) for w, v in a.items()) / size if size else 0
    templates = [(name, vector(line)) for name, lines in L.TEMPLATES.items() for line in lines]
    out = {}
    for d, text in docs.items():
        best = (None, 0, None)
        for number, line in enumerate(re.split(r"\r\n|\r|\n", text or ""), 1):
            v = vector(line)
            for name, t in templates:
                c = cosine(v, t)
                if c >= L.THRESHOLD - 1e-12 and c > best[1] + 1e-9:
                    best = (name, c, number)
        out[d] = best
    return out


def test_declarations_and_inheritance_on_given_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op2_licences"](spark, "/root/testdata/sf0.001").collect()}
    want = plain(docs)
    assert len(got) == len(docs)
    assert {d: (r.own_licence, r.own_line) for d, r in got.items()} == {d: (w[0], w[2]) for d, w in want.items()}
    planted = {d for d, t in docs.items() if re.search("Licensed under|licensed under the GNU|Released under the MIT", t)}
    assert planted == {d for d, r in got.items() if r.own_licence}


def test_nearest_ancestor_and_odd_rows(spark):
    mit, gpl = "x\nReleased under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("LICENSE", mit), ("a/b/COPYING.txt", gpl), ("a/b/c/d.txt", "text"), ("a/x.txt", None), ("y.txt", ""),
            ("a/b/own.txt", "Released under the MIT License."), (None, "text"), ("a/b/c/d.txt", "text"), ("/abs/e", "t"),
            ("q/notes.md", gpl), ("q/other", "plain text"), ("bb/LICENCE", "no declaration here"), ("bb/z", "w " * 50000)]
    docs = spark.createDataFrame([(i, p, t, "clash") for i, (p, t) in enumerate(rows)],
                                 "id int, path string, text string, licence string")
    got = {r.id: (r.licence, r.whence) for r in L.inherit(L.declared(docs, keep=("id", "path"))).collect()}
    assert got == {0: ("MIT", "own"), 1: ("GPL-3.0", "own"), 2: ("GPL-3.0", "/a/b"), 3: ("MIT", "/"), 4: ("MIT", "/"),
                   5: ("MIT", "own"), 6: (None, None), 7: ("GPL-3.0", "/a/b"), 8: ("MIT", "/"), 9: ("GPL-3.0", "own"),
                   10: ("MIT", "/"), 11: ("MIT", "/"), 12: ("MIT", "/")}
    none = docs.filter("id < 0")
    assert L.inherit(L.declared(none, keep=("id", "path"))).collect() == []


def test_scores_do_not_depend_on_the_number_of_texts():
    share = {"licensed": 0.029, "under": 0.039, "the": 0.615, "mit": 0.107, "license": 0.035, "is": 0.509, "this": 0.423}
    header = "This file is licensed under the MIT License."
    found = [L.Scorer(n, {w: round(n * s) for w, s in share.items()}).best(header)
             for n in (1000, 250_000, 15_000_000)]
    assert {name for name, _ in found} == {"MIT"}
    assert max(score for _, score in found) - min(score for _, score in found) < 1e-9


SHARE = {"licensed": 0.029, "under": 0.039, "the": 0.615, "mit": 0.107, "license": 0.035, "is": 0.509, "this": 0.423,
         "of": 0.577, "gnu": 0.009, "general": 0.009, "public": 0.009, "version": 0.025, "3": 0.009, "2.0": 0.016}


def test_headers_across_lines_inside_lines_and_of_other_versions():
    filler = "words of a long document " * 40
    want = {
        "Copyright 2024 Acme. Licensed under the MIT License.": ("MIT", 1),
        f"{filler} Licensed under the Apache License, Version 2.0. {filler}": ("Apache-2.0", 1),
        "x\n# Licensed under the Apache\n# License, Version 2.0\ny": ("Apache-2.0", 2),
        "GNU GENERAL PUBLIC LICENSE": (None, None), "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": ("GPL-2.0", 1),
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": ("GPL-3.0", 1),
        "GNU Lesser General Public License\nVersion 2.1": ("LGPL-2.1", 1),
        "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3": ("AGPL-3.0", 1), "Licensed under CC BY 4.0.": ("CC-BY-4.0", 1),
        "Licensed under CC BY-NC-ND 4.0.": (None, None), "CC0 1.0 Universal": ("CC0-1.0", 1),
        "// SPDX-License-Identifier: ISC\nint x;": ("ISC", 1), "/* SPDX-License-Identifier: GPL-2.0-only */": ("GPL-2.0", 1),
        "Licensed under the BSD 2-Clause License.": ("BSD-2-Clause", 1),
        "Gesendet mit der Public Version und the License": (None, None)}
    for n in (1000, 15_000_000):
        scorer = L.Scorer(n, {w: round(n * s) for w, s in SHARE.items()})
        got = {text: scorer.declares(text) for text in want}
        assert {text: (f[0], f[2]) for text, f in got.items()} == want


def test_licence_files_as_whole_texts(spark):
    scorer = L.Scorer(1000, {w: round(1000 * s) for w, s in SHARE.items()})
    for name, counts in L.WHOLE_TEXTS.items():
        bag = " ".join(f"{w} " * c for w, c in counts.items())  # word order does not count
        assert scorer.declares(bag, True)[0] == name
    bag = " ".join(f"{w} " * c for w, c in L.WHOLE_TEXTS["BSD-2-Clause"].items()) + " Copyright 2024 Acme"
    docs = spark.createDataFrame([(1, "a/LICENSE.txt", bag), (2, "a/b.c", "int x;"), (3, "c/d.txt", bag)],
                                 "id int, path string, text string")
    got = {r.id: r.licence for r in L.inherit(L.declared(docs, keep=("id", "path"))).collect()}
    assert got == {1: "BSD-2-Clause", 2: "BSD-2-Clause", 3: None}
