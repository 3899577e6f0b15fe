"""Language profiles: bundles against a plain sum over trigrams, held-out accuracy, odd rows."""

import numpy as np

from palimpsest.llm import language as L
from palimpsest.llm import queries


def plain_bundle(text):
    blanked = "".join(c if c.isalpha() else " " for c in text.lower())
    kept = [c for i, c in enumerate(blanked) if c != " " or (i and blanked[i - 1] != " ")]
    total = np.zeros(L.DIMENSIONS)
    for a, b, c in zip(kept, kept[1:], kept[2:]):
        total += np.roll(L.item(ord(a)), 2) * np.roll(L.item(ord(b)), 1) * L.item(ord(c))
    return total


def test_bundles_equal_plain_sums():
    given = ["The cat, sat!  On", "ÉÀ élan vital", "123 abc..", "x" * 5000, "日本語のテキスト"]
    got = L.bundles([*given, None, "", "12 34", "ab"])
    for row, text in zip(got, given):
        assert np.array_equal(row, plain_bundle(text)), text
    assert not got[5:8].any() and got[8].any()


def test_held_out_accuracy_and_contract(spark):
    got = queries.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark, tmp_path):
    rows = [(1, "the cat sat on the mat", "en", 1), (2, None, "en", 2), (3, "", None, 3), (None, "12 !", "de", 4),
            (5, "the cat", None, 5), (5, "the cat", None, 5), (6, "der Hund und die Katze", "de", 6)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op1_language_id"](spark, str(tmp_path)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[2].lang_pred == by[3].lang_pred == by[None].lang_pred == "und" and by[2].score == 0
    spark.createDataFrame([], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert queries.QUERIES["op1_language_id"](spark, f"{tmp_path}/e").collect() == []
    only = spark.createDataFrame([(1, "abc def")], "doc_id bigint, text string")
    assert L.identify(only, {}, ["doc_id"]).first().lang_pred == "und"


def test_noise_and_an_unlearned_language_go_and_short_clean_texts_stay(spark):
    learned = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    means = L.learn_means(learned)
    clean = [r.text for r in learned.filter("length(text) < 400").collect() if any(c.isalpha() for c in r.text)]
    letters = np.random.default_rng(5)
    noise = ["".join(letters.choice(list("abcdefghijklmnopqrstuvwxyz     "), n)) for n in (100, 400, 3000) for _ in range(40)]
    other = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem.",
             "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
             "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており"]
    rows = [(kind, t) for kind, given in (("clean", clean), ("noise", noise), ("other", other)) for t in given]
    docs = spark.createDataFrame(rows, "kind string, text string")
    kept = [r.kind for r in L.select_known(docs, means).collect()]
    assert len(clean) > 30 and min(map(len, clean)) < 10
    assert kept.count("clean") == len(clean) and kept.count("noise") <= 0.02 * len(noise) and kept.count("other") == 0
