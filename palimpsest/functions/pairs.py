"""Pairing of two bounded lists of texts, evaluated in Arrow batches.

One row holds the texts of one document, or of one pair of parents, on both sides. Spark spreads the rows; the helper sees
one at a time. Positions count from 0. A NULL list is one that was settled without pairing.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import sequence as SQ

_WORDS = re.compile("[^ \t\r\n]+").findall
BY = ("key", "names", "reading", "wording", "lone")


def words(texts):
    """The set of words of each text; None for one that is not there."""
    return [None if t is None else set(_WORDS(t)) for t in texts]


def kth_pairs(a, b):
    """The k-th of a value on one side with the k-th of it on the other; None meets nothing."""
    places = defaultdict(list)
    for y in range(len(b) - 1, -1, -1):
        if b[y] is not None:
            places[b[y]].append(y)
    return [(x, places[v].pop()) for x, v in enumerate(a) if v is not None and places.get(v)]


def alike_pairs(a, b, minimum, kinds_a=None, kinds_b=None):
    """(x, y, score) of the word sets of one kind that share words, from the minimum score on, by x and y.

    Sets meet over the rarest of their words, as many as a pair of the minimum score must share one of; with no minimum
    that is every word. Two texts without words are the same text.
    """
    often = Counter()
    for s in (*a, *b):
        often.update(s or ())
    # A word is its place from the rarest on, so sets are short lists of numbers.
    place = {w: k for k, w in enumerate(sorted(often, key=often.__getitem__))}
    ranked = [[None if s is None else sorted(map(place.__getitem__, s)) for s in side] for side in (a, b)]
    a, b = ([None if r is None else set(r) for r in side] for side in ranked)

    def opening(r):
        """The words a set must share one of; one without words has a word of its own."""
        return [] if r is None else r[:len(r) - math.ceil(len(r) * minimum - 1e-9) + 1] or [-1]
    kinds = defaultdict(lambda: defaultdict(list))
    for y, r in enumerate(ranked[1]):
        index = kinds[kinds_b and kinds_b[y]]
        for w in opening(r):
            index[w].append(y)
    found = []
    for x, s in enumerate(a):
        index = kinds.get(kinds_a and kinds_a[x], {})
        met = [index[w] for w in opening(ranked[0][x]) if w in index]
        for y in sorted(set().union(*met)):
            t = b[y]
            if len(s) < len(t) * minimum - 1e-9 or len(t) < len(s) * minimum - 1e-9:
                continue
            shared = len(s & t)
            score = shared / (len(s) + len(t) - shared) if s or t else 1.0
            if score >= minimum:
                found.append((x, y, score))
    return found


def walked(pairs):
    """The pairs, in the given order, that a walk takes which uses every x and every y once."""
    used_x, used_y, taken = set(), set(), []
    for pair in pairs:
        if pair[0] not in used_x and pair[1] not in used_y:
            used_x.add(pair[0])
            used_y.add(pair[1])
            taken.append(pair)
    return taken


def best_first(pairs):
    return walked(sorted(pairs, key=lambda p: (-p[2], p[0], p[1])))


def _without(values, taken):
    return [None if k in taken else v for k, v in enumerate(values)]


def node_pairs(a, b, minimum):
    """Equal texts k-th with k-th, then those that read alike, first come first served."""
    exact = kth_pairs([(t,) for t in a], [(t,) for t in b])
    rest_a, rest_b = _without(a, {x for x, _ in exact}), _without(b, {y for _, y in exact})
    return exact + [(x, y) for x, y, _ in walked(alike_pairs(words(rest_a), words(rest_b), minimum))]


def named_pairs(a, b, names_a, names_b):
    """(x, y, score) of texts of one name, those that read most alike first, while both sides have one left.

    Equal word sets are matched first, k-th with k-th, which is what best-first does with them. What shares no word is
    left to the end, where its order decides. A text that is not there meets nothing.
    """
    wa, wb = words(a), words(b)
    keyed = [[None if s is None else (name, frozenset(s)) for name, s in zip(names, sets)]
             for names, sets in ((names_a, wa), (names_b, wb))]
    found = [(x, y, 1.0) for x, y in kth_pairs(*keyed)]
    left = _without(wa, {p[0] for p in found}), _without(wb, {p[1] for p in found})
    found += best_first(alike_pairs(*left, 0.0, names_a, names_b))
    free = [[None if s is None or k in used else (name,) for k, (name, s) in enumerate(zip(names, sets))]
            for names, sets, used in ((names_a, wa, {p[0] for p in found}), (names_b, wb, {p[1] for p in found}))]
    return found + [(x, y, 0.0) for x, y in kth_pairs(*free)]


def sibling_pairs(old, new, minimum):
    """(x, y, by) of the children of paired parents; every pass takes what those before left.

    A side is four lists: type, exact (the key or None), names and said. Exact keys k-th with k-th; items of one set of
    names, best reading first; items one side of which gives no names, by how alike the declarations read; paragraphs
    and blocks that read alike, first come first served; a lone block with a lone block.
    """
    found = [(x, y, 0) for x, y in kth_pairs(old[1], new[1])]

    def left(test):
        """What is said by what ``test`` lets pass of both sides and is not paired yet; None in the place of the rest."""
        return [[n[3] if k not in used and test(*n) else None for k, n in enumerate(zip(*side))]
                for side, used in ((old, {p[0] for p in found}), (new, {p[1] for p in found}))]
    found += [(x, y, 1) for x, y, _ in named_pairs(*left(lambda kind, key, names, said: kind == "item" and names), old[2], new[2])]
    declared = left(lambda kind, key, names, said: kind == "item" and (said or "").strip(" "))
    reads = alike_pairs(*map(words, declared), minimum)
    found += [(x, y, 2) for x, y, _ in best_first([p for p in reads if not (old[2][p[0]] and new[2][p[1]])])]
    prose = left(lambda kind, key, names, said: key is None)
    found += [(x, y, 3) for x, y, _ in walked(alike_pairs(*map(words, prose), minimum, old[0], new[0]))]
    lone = [[k for k, kind in enumerate(side[0]) if kind == "block"] for side in (old, new)]
    if len(lone[0]) == len(lone[1]) == 1 and not any(p[0] == lone[0][0] or p[1] == lone[1][0] for p in found):
        found.append((lone[0][0], lone[1][0], 4))
    return found


def _columns(pairs, dtypes=(np.int32, np.int32, np.float64)):
    """Pairs as parallel arrays."""
    return [np.array([p[k] for p in pairs], kind) for k, kind in enumerate(dtypes)]


_SCORED = T.StructType([T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("y", T.ArrayType(T.IntegerType())),
                        T.StructField("score", T.ArrayType(T.DoubleType()))])


def scored_pairs(a: Column, b: Column, kinds_a: Column, kinds_b: Column, minimum: float) -> Column:
    """``alike_pairs`` of two columns of texts and their kinds: parallel arrays x, y and score."""
    @F.pandas_udf(_SCORED)
    def run(a: pd.Series, b: pd.Series, k: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_columns(alike_pairs(words(p), words(q), minimum, list(r), list(s)))
                             for p, q, r, s in zip(a, b, k, m)], columns=["x", "y", "score"], dtype=object)
    return run(a, b, kinds_a, kinds_b)


@F.pandas_udf(_SCORED)
def pairs_by_name(a: pd.Series, b: pd.Series, names_a: pd.Series, names_b: pd.Series) -> pd.DataFrame:
    """``named_pairs`` of two columns of texts and their names: parallel arrays x, y and score."""
    return pd.DataFrame([_columns(named_pairs(list(p), list(q), list(r), list(s))) for p, q, r, s in zip(a, b, names_a, names_b)],
                        columns=["x", "y", "score"], dtype=object)


def script_of_nodes(a: Column, b: Column, minimum: float) -> Column:
    """The script of two columns of texts whose matches are ``node_pairs``."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def packed(p, q):
            pairs = node_pairs(p, q, minimum)
            return SQ.packed(SQ.diff_matches(len(p), len(q), *_columns(pairs, (np.int64, np.int64))))
        return pd.Series([None if p is None else packed(list(p), list(q)) for p, q in zip(a, b)], dtype=object)
    return SQ.steps_of(run(a, b))


def script_of_alike(a: Column, b: Column, kinds_a: Column, kinds_b: Column, minimum: float) -> Column:
    """The script of two columns of texts that match where they are ``alike_pairs``."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(a: pd.Series, b: pd.Series, k: pd.Series, m: pd.Series) -> pd.Series:
        def packed(p, q, r, s):
            pairs = alike_pairs(words(p), words(q), minimum, r, s)
            return SQ.packed(SQ.diff_matches(len(p), len(q), *_columns(pairs, (np.int64, np.int64))))
        return pd.Series([None if p is None else packed(list(p), list(q), list(r), list(s))
                          for p, q, r, s in zip(a, b, k, m)], dtype=object)
    return SQ.steps_of(run(a, b, kinds_a, kinds_b))


_SETTLED = T.StructType([T.StructField(name, T.ArrayType(T.LongType() if name == "script" else T.IntegerType()))
                         for name in ("script", "to", "back", "by")])


def settled_siblings(old: list[Column], new: list[Column], minimum: float) -> Column:
    """The script of two sides of children whose matches are ``sibling_pairs``, packed; for each old child the place of
    its mate and what paired them, and for each new one the place of its mate, -1 for none."""
    @F.pandas_udf(_SETTLED)
    def run(ta: pd.Series, ea: pd.Series, na: pd.Series, sa: pd.Series,
            tb: pd.Series, eb: pd.Series, nb: pd.Series, sb: pd.Series) -> pd.DataFrame:
        def row(sides):
            old, new = sides[:4], sides[4:]
            n, m = len(old[0]), len(new[0])
            pairs = sibling_pairs(old, new, minimum)
            to, back, by = np.full(n, -1, np.int32), np.full(m, -1, np.int32), np.full(n, -1, np.int32)
            for x, y, why in pairs:
                to[x], back[y], by[x] = y, x, why
            return [SQ.packed(SQ.diff_matches(n, m, *_columns(pairs, (np.int64, np.int64)))), to, back, by]
        return pd.DataFrame([row([list(v) for v in sides]) for sides in zip(ta, ea, na, sa, tb, eb, nb, sb)],
                            columns=["script", "to", "back", "by"], dtype=object)
    return run(*old, *new)
