"""Mixing against a plain bisection and the laws of block permutations; odd rows."""

import math
from collections import Counter, defaultdict

from palimpsest.llm import mixing


def plain_exponent(sizes, even, repeats, budget):
    total = sum(sizes)
    p = [s / total for s in sizes]

    def weigh(a):
        z = sum(x ** a for x in p)
        return [x ** a / z for x in p]

    def entropy(a):
        return -sum(w * math.log(w) for w in weigh(a))
    target = entropy(1) + even * (math.log(len(p)) - entropy(1))
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= target else (low, mid)
    a = low
    low, high = 0.0, 1.0
    over = lambda b: max(w * budget / s for w, s in zip(weigh(b), sizes)) > repeats
    if repeats and over(0.0):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if over(mid) else (low, mid)
        a = max(a, high)
    return a, weigh(a)


def test_weights_and_copies_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for even, repeats in ((0.5, None), (1.0, 1.3)):
        got = mixing.mixed(docs, even=even, repeats=repeats).collect()
        assert len(got) == docs.count()
        assert all(r.n_tokens == len(r.text.split()) for r in got if r.text.isascii())
        sizes, taken, most = Counter(), Counter(), Counter()
        for r in got:
            sizes[r.source] += r.n_tokens
            taken[r.source] += r.n_tokens * r.copies
            most[r.source] = max(most[r.source], r.n_tokens)
        names = sorted(sizes)
        total = sum(sizes.values())
        _, want = plain_exponent([sizes[s] for s in names], even, repeats, total)
        by = {r.source: r for r in got}
        for name, weight in zip(names, want):
            assert abs(by[name].weight - weight) < 1e-6
            assert abs(by[name].quota - weight * total) <= 1 + 1e-6 * total
            assert 0 <= taken[name] - by[name].quota <= most[name]
            copies = {r.copies for r in got if r.source == name}
            assert max(copies) - min(copies) <= 1


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    want = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in want.items() if v})


def test_odd_rows(spark):
    rows = [(1, None, "a", 5), (2, "", "a", 5), (None, "x y z", None, 5), (3, "w " * 50000, "b", 5), (3, "w", "b", 5),
            (3, "w", "b", 5), (4, "q r", "", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int")
    got = mixing.mixed(docs, even=1.0).collect()
    assert len(got) == 7 and [r.copies for r in got if r.source == "a"] == [1, 1]
    assert len(mixing.mix(docs).columns) == 4
    spent = defaultdict(int)
    for r in got:
        spent[r.source] += r.copies * r.n_tokens
    assert spent[None] <= 4 * 3 + 3
    assert mixing.mixed(docs.filter("doc_id < 0")).collect() == []
    assert [r.copies for r in mixing.mixed(docs.filter("doc_id < 3")).collect()] == [1, 1]
