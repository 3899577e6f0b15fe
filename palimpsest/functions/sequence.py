"""The sequence-diff core: shortest edit scripts of two bounded sequences, evaluated in Arrow batches.

One row holds one pair of sequences. Spark spreads the pairs; the helper sees one pair at a time. A script of fewer than
``SHORT`` edits is stepped in plain numbers, a longer one all diagonals of a depth at once in numpy. Then only every ``BLOCK``-th frontier is kept, and the depths between are stepped
again on the way back, so a pair of n and m elements with d edits needs O((n+m)·(BLOCK + d/BLOCK)) memory and no
pair is too large to be diffed exactly.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 256
SHORT = 64  # edits below which numpy's calls cost more than the diagonals they step
OPS = ("keep", "delete", "insert")


def _step(frontier, d, n, m, same, origin):
    """One depth: every reachable diagonal extended by an edit, the deletion first on ties, then along its matches."""
    k = np.arange(-d, d + 1, 2)
    above, left = frontier[origin + k + 1], frontier[origin + k - 1]
    down = (left < above) & (k != d)
    down |= k == -d
    x = np.where(down, above, left + 1) if d else np.zeros(1, np.int64)
    y = x - k
    live = np.flatnonzero((x < n) & (y < m))
    while live.size:
        live = live[same(x[live], y[live])]
        x[live] += 1
        y[live] += 1
        live = live[(x[live] < n) & (y[live] < m)]
    frontier[origin + k] = x
    return bool(np.any((x >= n) & (y >= m)))


def short_steps(n, m, same):
    """The script that ``edit_steps`` gives if it has fewer than ``SHORT`` edits, else None. ``same`` takes two numbers."""
    if abs(n - m) >= SHORT:
        return None
    reached = []
    for d in range(SHORT):
        last, row = reached[-1] if reached else [0], []
        for i in range(d + 1):
            x = 0 if d == 0 else last[0] if i == 0 else last[i - 1] + 1 if i == d or last[i - 1] >= last[i] else last[i]
            y = x - 2 * i + d
            while x < n and y < m and same(x, y):
                x, y = x + 1, y + 1
            row.append(x)
            if x >= n and y >= m:
                return _back(n, m, d, reached)
        reached.append(row)
    return None


def _back(x, y, d, reached):
    """The steps to (x, y) at depth ``d``, from what every depth before it reached."""
    out = []
    while d > 0:
        prior, i = reached[d - 1], (x - y + d) // 2
        down = i == 0 or (i != d and prior[i - 1] < prior[i])
        px = prior[i] if down else prior[i - 1]
        py = px - (x - y + (1 if down else -1))
        while x > px and y > py:
            x, y = x - 1, y - 1
            out.append(("keep", x, y))
        out.append(("insert", x, py) if down else ("delete", px, y))
        x, y, d = px, py, d - 1
    while x > 0 and y > 0:
        x, y = x - 1, y - 1
        out.append(("keep", x, y))
    out.reverse()
    return out


def edit_steps(n, m, same):
    """The script from a sequence of n to one of m elements, as (op, a, b) in order."""
    if n == 0 and m == 0:
        return []
    origin = n + m + 1
    frontier = np.zeros(2 * origin + 1, np.int64)
    kept, depth = [], 0
    while True:
        if depth % BLOCK == 0:
            kept.append(frontier[origin - depth - 1: origin + depth + 2].copy())
        if _step(frontier, depth, n, m, same, origin):
            break
        depth += 1

    out, x, y, d = [], n, m, depth
    for block in reversed(range(len(kept))):
        first = block * BLOCK
        if d < max(first, 1):
            continue
        work = np.zeros_like(frontier)
        work[origin - first - 1: origin + first + 2] = kept[block]
        priors = {first: kept[block]}
        for e in range(first, d):
            _step(work, e, n, m, same, origin)
            priors[e + 1] = work[origin - e - 2: origin + e + 3].copy()
        while d >= max(first, 1):
            prior, mid, k = priors[d], d + 1, x - y
            down = k == -d or (k != d and prior[mid + k - 1] < prior[mid + k + 1])
            came = k + 1 if down else k - 1
            px = int(prior[mid + came])
            py = px - came
            while x > px and y > py:
                x, y = x - 1, y - 1
                out.append(("keep", x, y))
            out.append(("insert", x, py) if down else ("delete", px, y))
            x, y, d = px, py, d - 1
    while x > 0 and y > 0:
        x, y = x - 1, y - 1
        out.append(("keep", x, y))
    out.reverse()
    return out


def diff_values(a, b):
    """Script of two lists of values compared by equality."""
    found = short_steps(len(a), len(b), lambda x, y: a[x] == b[y])
    if found is not None:
        return found
    codes: dict = {}
    va = np.fromiter((codes.setdefault(v, len(codes)) for v in a), np.int64, len(a))
    vb = np.fromiter((codes.setdefault(v, len(codes)) for v in b), np.int64, len(b))
    return edit_steps(len(a), len(b), lambda x, y: va[x] == vb[y])


def diff_matches(n, m, i, j):
    """Script of two sequences whose matching elements are given as parallel positions, counted from 0."""
    codes = np.sort(np.ravel(np.asarray(i, np.int64) * m + np.asarray(j, np.int64)))
    known = set(codes.tolist())
    found = short_steps(n, m, lambda x, y: x * m + y in known)
    if found is not None:
        return found

    def same(x, y):
        if not codes.size:
            return np.zeros(x.shape, bool)
        wanted = x * m + y
        return codes[np.minimum(np.searchsorted(codes, wanted), codes.size - 1)] == wanted

    return edit_steps(n, m, same)


def word_runs(a, b, island):
    """Runs of two lists of words as (change, text): 0 same, 1 removed, 2 added. Words are compared without the blanks after them.

    Kept runs of at most ``island`` words between two changes are part of them, and a change's removed words come first.
    """
    steps = diff_values(*([w.rstrip(" \t\r\n") for w in side] for side in (a, b)))
    parts = [(kept, list(part)) for kept, part in groupby(steps, lambda s: s[0] == "keep")]
    runs = []
    for k, (kept, part) in enumerate(parts):
        kept = kept and not (0 < k < len(parts) - 1 and len(part) <= island)
        if runs and runs[-1][0] == kept:
            runs[-1][1].extend(part)
        else:
            runs.append((kept, part))
    out = []
    for kept, part in runs:
        removed, added = [a[s[1]] for s in part if s[0] != "insert"], [b[s[2]] for s in part if s[0] != "delete"]
        out += [(0, added)] if kept else [(1, removed), (2, added)]
    return [(change, "".join(words)) for change, words in out if words]


def packed(steps):
    """A step as one number: its operation, a and b."""
    return np.fromiter(((OPS.index(op) << 60) | (a << 30) | b for op, a, b in steps), np.int64, len(steps))


def steps_of(packed: Column) -> Column:
    low = F.lit((1 << 30) - 1)
    ops = F.array(*[F.lit(op) for op in OPS])
    return F.transform(packed, lambda c: F.struct(
        F.get(ops, F.shiftright(c, 60).cast("int")).alias("op"), F.shiftright(c, 30).bitwiseAND(low).cast("int").alias("a"),
        c.bitwiseAND(low).cast("int").alias("b")))


# A NULL sequence is one that was settled without a script.

@F.pandas_udf(T.ArrayType(T.LongType()))
def _packed_of_values(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else packed(diff_values(list(x), list(y))) for x, y in zip(a, b)], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _packed_of_matches(n: pd.Series, m: pd.Series, i: pd.Series, j: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else packed(diff_matches(int(x), int(y), p, q))
                      for x, y, p, q in zip(n, m, i, j)], dtype=object)


_RUNS = T.StructType([T.StructField("change", T.ArrayType(T.IntegerType())), T.StructField("text", T.ArrayType(T.StringType()))])


def runs_of_words(a: Column, b: Column, island: int) -> Column:
    """``word_runs`` of two columns of words: parallel arrays change and text."""
    @F.pandas_udf(_RUNS)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [[] if x is None or y is None else word_runs(list(x), list(y), island) for x, y in zip(a, b)]
        return pd.DataFrame([[np.array([c for c, _ in r], np.int32), [t for _, t in r]] for r in found],
                            columns=["change", "text"], dtype=object)
    return run(a, b)


def script_of_values(a: Column, b: Column) -> Column:
    return steps_of(_packed_of_values(a, b))


def script_of_matches(n: Column, m: Column, i: Column, j: Column) -> Column:
    return steps_of(_packed_of_matches(n, m, i, j))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def free_positions(i: pd.Series, j: pd.Series) -> pd.Series:
    """Which of a row's ordered pairs a walk takes that uses every i and every j once; positions from 0."""
    def walk(left, right):
        used_i, used_j, taken = set(), set(), []
        for position, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
            if a not in used_i and b not in used_j:
                used_i.add(a)
                used_j.add(b)
                taken.append(position)
        return taken
    return pd.Series([walk(a, b) for a, b in zip(i, j)], dtype=object)
