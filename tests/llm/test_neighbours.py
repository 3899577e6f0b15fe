"""Embedding near duplicates against brute force: clusters, chains across the threshold, copies, odd rows."""

import math
from collections import Counter

import numpy as np

from palimpsest.llm import neighbours as N
from tests.llm.test_jaccard import roots


def brute(rows, cosine=0.93):
    def sound(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    good = [(i, k, np.array(v, float)) for i, k, v in rows if k is not None and sound(v) and i is not None]
    links = []
    for n, (a, k, v) in enumerate(good):
        for b, j, w in good[n + 1:]:
            if k == j and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                links.append((a, b))
    degree = Counter(x for pair in links for x in pair)
    return degree, roots([i for i, _, _ in rows], links), links


def test_recall_and_counts_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label in range(3):
        for g in range(25):
            centre = rng.standard_normal(64)
            centre /= np.linalg.norm(centre)
            spread = rng.choice([0.02, 0.1, 0.18, 0.3, 0.42])
            for _ in range(rng.integers(1, 12)):
                v = (centre + spread * rng.standard_normal(64) / 8).astype(np.float32)
                rows += [(len(rows) + c, label, v.tolist()) for c in range(rng.choice([1, 1, 1, 3]))]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").repartition(3)
    degree, component, links = brute(rows)
    got = {r.vec_id: r for r in N.near_duplicates(table).collect()}
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and len(links) > 300
    assert all(r.n_links <= degree[i] for i, r in got.items())
    assert found >= 0.99 * 2 * len(links)
    assert np.mean([r.component_id == component[i] for i, r in got.items()]) > 0.98
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_odd_rows(spark):
    v, w = [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.01]
    rows = [(1, 0, v), (2, 0, w), (3, 1, v), (4, None, v), (5, 0, None), (6, 0, [0.0] * 4), (7, 0, [1.0, None, 3.0, 4.0]),
            (8, 0, [float("nan"), 1.0, 1.0, 1.0]), (9, 0, [float("inf"), 1.0, 1.0, 1.0]), (10, 0, v + [5.0]), (11, 0, []),
            (12, 0, v), (12, 0, v), (None, 0, v)]
    table = spark.createDataFrame([(*r, 3) for r in rows],
                                  "vec_id bigint, label int, embedding array<float>, n_links int")
    got = sorted((tuple(r) for r in N.near_duplicates(table).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (12, 3, 1, False), (12, 3, 1, False), (None, 0, None, False)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted(want, key=str)
    assert N.near_duplicates(table.filter("vec_id < 0")).collect() == []
