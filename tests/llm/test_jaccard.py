"""The n-gram Jaccard join against brute force; the pigeonhole law of its signatures; components; odd rows."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import jaccard as J
from palimpsest.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return roots(ids, pairs)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.randoms(use_true_random=False))
def test_alike_sets_share_a_signature(size, rng):
    base = [rng.getrandbits(64) for _ in range(size)]
    drop = rng.randint(0, size)
    other = base[drop:] + [rng.getrandbits(64) for _ in range(rng.randint(0, size // 4 + 1))]
    if not other or 100 * len(set(base) & set(other)) < 80 * len(set(base) | set(other)):
        drop = size // 9
        other = base[drop:] + [rng.getrandbits(64) for _ in range(size // 9 // 2)]
        if 100 * len(set(base) & set(other)) < 80 * len(set(base) | set(other)):
            return
    row, found = J.signatures([np.unique(np.array(s, np.uint64)) for s in (base, other)])
    assert set(found[row == 0].tolist()) & set(found[row == 1].tolist())


def test_groups_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(60):
        n = rng.choice([3, 7, 12, 30, 80, 200, 400])
        words = [rng.choice(vocabulary) for _ in range(n)]
        if i % 3 == 0:
            words[n // 2:n // 2] = passage
        for _ in range(rng.choice([1, 1, 3, 6])):
            changed = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary).upper()
            rows.append((len(rows), " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in J.jaccard_groups(docs).collect()}
    assert got == brute(rows)
    assert len(set(got.values())) < len(rows)


def test_near_misses_meet_once_and_few_are_verified(spark, monkeypatch):
    """Texts too far apart to link, which share hundreds of signatures: few bucket rows, nearly no pair left to verify."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(36):
        words = list(base)
        for k in rng.sample(range(400), 7):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    held, write = {}, J.written

    def counted(df, name):
        out = write(df, name)
        held[name] = max(held.get(name, 0), out.count())
        return out
    monkeypatch.setattr(J, "written", counted)
    got = {r.doc_id: r.component_id for r in J.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows) and len(set(got.values())) > 18
    assert held["buckets"] < 36 * 36 and held["crossing"] < 36


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\ntwo"), (6, "two one"), (7, "a b c d e f"),
            (7, "a b c d e f"), (None, "a b c d e f"), (8, "A B C D E F"), (9, "é " * 30000), (10, "é " * 29990)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, component int")
    got = sorted((tuple(r) for r in J.jaccard_groups(docs).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 2, 7), (7, 2, 7), (8, 2, 7),
            (9, 1, 9), (10, 1, 9), (None, 2, None)]
    assert got == sorted(want, key=str)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, 9, None], key=str)
    assert J.jaccard_groups(docs.filter("doc_id < 0")).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (None, 3), (7, 6)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}}


def test_a_repeated_id_keeps_its_own_text(spark):
    """The first copy stays, and a text stays under its own id only: (7, T) goes as a copy of (3, T), (7, U) stays."""
    t, u = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(3, t, 1), (7, t, 2), (7, u, 3), (3, t, 4), (None, t, 5), (9, None, 6), (9, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, set_key int")
    got = J.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, t), (7, u), (None, t), (9, None), (9, "")], key=str)
