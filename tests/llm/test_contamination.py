"""Containment search against brute force, for short items in long texts; odd rows."""

import random

from palimpsest.llm import contamination as C
from tests.llm.test_jaccard import shingles


def brute(docs, items):
    out = []
    for d, text in docs:
        have = shingles(text)
        for i, item in items:
            want = shingles(item)
            if want and 100 * len(want & have) >= 80 * len(want):
                out.append((d, i, len(want), len(want & have)))
    return sorted(out, key=str)


def test_found_items_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)  # several blocks
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 6, 9, 20, 33, 60, 130])))) for i in range(40)]
    docs = []
    for d in range(150):
        words = [word() for _ in range(rng.choice([5, 50, 400, 3000]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            part = rng.choice(items)[1].split()
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "changed"
            if rng.random() < 0.2:
                part = part[:int(len(part) * 0.7)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((d, " ".join(words).title()))
    docs.append((999, items[0][1]))
    got = C.contained_items(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
                            spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_short_items_are_never_missed(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(5 + i % 3))) for i in range(300)]
    docs = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(60)) + f" {text} " + "x y " * 20) for i, text in items]
    got = C.contained_items(spark.createDataFrame(docs, "doc_id bigint, text string"),
                            spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(300)]


def test_ids_of_any_type(spark):
    item = "one two three four five six"
    docs = spark.createDataFrame([(1, f"a {item} b")], "doc_id int, text string")
    for kind in ("tinyint", "smallint", "int", "bigint", "float", "string", "decimal(9, 2)", "date", "binary"):
        given = spark.sql(f"SELECT cast({'DATE' if kind == 'date' else ''}'{'2020-01-01' if kind == 'date' else 7}' AS {kind}) AS item_id, '{item}' AS text")
        (row,) = C.contained_items(docs, given).collect()
        assert row.item_id == given.first().item_id and row.doc_id == 1


def test_odd_rows_and_clean_copy(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, None, 1), (2, "", 1), (3, f"x y {item.upper()} z", 1), (3, f"x y {item} z", 1), (None, item, 1),
            (4, "alpha beta gamma delta", 1), (5, "far " * 100000 + item, None), (6, "One  two", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id int")
    items = spark.createDataFrame([(7, item, 0), (8, None, 0), (9, "", 0), (10, "one two", 0), (7, item, 0)],
                                  "item_id bigint, text string, n_found int")
    got = sorted(((r.doc_id, r.item_id) for r in C.contained_items(docs, items).collect()), key=str)
    want = [(3, 7)] * 4 + [(None, 7)] * 2 + [(5, 7)] * 2 + [(6, 10)]
    assert got == sorted(want, key=str)
    kept = C.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    none = items.filter("item_id < 0")
    assert C.contained_items(docs, none).collect() == [] and C.decontaminate(docs, none).count() == len(rows)
    assert C.contained_items(docs.filter("doc_id < 0"), items).collect() == []
