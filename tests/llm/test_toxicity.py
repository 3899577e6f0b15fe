"""Toxicity: sentences against a plain split, held-out accuracy, the offending sentence, odd rows."""

import re

import numpy as np
import pyarrow as pa

from palimpsest.llm import queries
from palimpsest.llm import toxicity as T


def plain_sentences(text):
    """(start, end) of runs of words that no stop or line end parts."""
    out, start, last = [], None, None
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        if start is not None and (text[last - 1] in ".!?" or re.search(r"[\r\n]", text[last:m.start()])):
            out.append((start, last))
            start = None
        start = m.start() if start is None else start
        last = m.end()
    return out + ([(start, last)] if start is not None else [])


def test_sentences_equal_a_plain_split():
    given = ["One two. Three\nfour! Fïve", "no end", "", "...", "a.b c.\n\nd"]
    words, first, _, _ = T.featurize(pa.array([*given, None]))
    of = np.searchsorted(first, words.of)
    assert np.diff(of).tolist() == [*(len(plain_sentences(t)) for t in given), 0]


def test_held_out_ranking_and_worst_sentence(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(got) == 10000
    bad = [got[i].score for i, y in labels.items() if y == 1 and i in got and got[i].held_out]
    good = [got[i].score for i, y in labels.items() if y == 0 and i in got and got[i].held_out]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_odd_rows_and_location(spark, tmp_path):
    filler = "the quiet house stood near the river"
    rows = [(i, f"{filler} {i}. you awful moron here. {filler}." if i % 2 else f"{filler} {i}. {filler}.", 1)
            for i in range(200)]
    rows += [(900, None, 1), (901, "", 1), (902, "calm day. awful moron! calm day.", 1), (902, "calm day", 1), (None, "x", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 1), (901, 1), (None, 1), (5, None)],
                          "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op9_toxicity"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    scored = {(r.doc_id, r.worst_end): r for r in got}
    assert [r.score for r in got if r.doc_id in (900, 901)] == [0.0, 0.0]
    hit = scored[(902, 22)]
    assert hit.predicted == 1 and hit.worst_start == 10
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/e/labels.parquet")
    spark.createDataFrame(rows[:3], "doc_id bigint, text string, score int").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert {r.score for r in queries.QUERIES["op9_toxicity"](spark, f"{tmp_path}/e").collect()} == {0.0}
