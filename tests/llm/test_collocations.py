"""Collocations against a plain count, tries that burst and spill, windows of long texts, odd rows."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import collocations as C
from palimpsest.llm import queries


def plain(rows, least, top):
    """The contract, word for word, in plain Python."""
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i:i + m])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {p[i:i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
                   if 100 * a >= 80 * f[p[i:i + m]]}
        rows = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def spark_rows(spark, rows, **limits):
    docs = spark.createDataFrame([(t, g, i, 1) for i, (t, g) in enumerate(rows)], "text string, lang string, w1 int, f int")
    return sorted(tuple(r) for r in C.collocations(docs, **limits).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_count(spark, seed, monkeypatch):
    dice = random.Random(seed)
    words = ["the", "The", "a", "öl", "x.y", "New", "york", "--", "in"]
    rows = [("".join(dice.choice(words) + dice.choice([" ", " ", " ", " ", "\t", ", ", "\n", "!"])
                     for _ in range(dice.randrange(40))), dice.choice(["en", "de", None, "und"])) for _ in range(150)]
    rows += [(None, "en"), ("", None), (" \t.,", "fr"), ("new york " * 400, "en"), rows[0], rows[0]]
    monkeypatch.setattr(C, "WINDOW", 64)
    assert spark_rows(spark, rows, least=5, top=40) == plain(rows, 5, 40)
    assert spark_rows(spark, rows, least=2, top=7) == plain(rows, 2, 7)


def test_bursts_and_spills_lose_nothing(monkeypatch):
    monkeypatch.setattr(C, "BURST", 64)
    monkeypatch.setattr(C, "LIMIT", 500)
    random_words = np.random.Generator(np.random.Philox(3))
    trie, runs, want = C.Trie(2), [], collections.Counter()
    for _ in range(30):
        ids = (random_words.zipf(1.3, (400, 2)) % 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        want.update(map(tuple, ids.tolist()))
        trie.add(ids)
        runs += trie.spill()
        assert trie.size() <= 500
    assert isinstance(trie.root, list) and len(runs) > 16
    runs += trie.spill(everything=True)
    got = collections.Counter()
    for words, counts in runs:
        prefix = C.prefix_of(words)
        assert (np.diff(prefix) >= 0).all()
        for w, c in zip(words.tolist(), counts.tolist()):
            got[tuple(w)] += c
    assert got == want and trie.size() == 0


def test_windows_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(C, "WINDOW", 10)
    given = ["one two. three four, five", "", "x" * 35 + " y", None, "a,b,c,d,e,f,g,h,i"]
    found = []
    for data, bounds, first in C.windows(pa.array(given)):
        start, end, _, text, piece = C.cut_words(data, bounds)
        found += [(first + int(t), data[a:b].tobytes().decode()) for a, b, t in zip(start, end, text)]
    want = [(i, w) for i, t in enumerate(given) for w in re.findall("[^\x20\x09.,]+", t or "")]
    assert found == want


def test_odd_tables(spark, tmp_path):
    assert spark_rows(spark, []) == [] and spark_rows(spark, [(None, None)]) == []
    rows = [("No End here? no end HERE", "en", "x")] * 40
    spark.createDataFrame(rows, "text string, lang string, phrase string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES["op11_collocations"](spark, str(tmp_path)).collect()]
    assert got == [("en", 1, "no end here", 80, 80, 80, 240, 1000000)]


def test_scores_pass_64_bits(spark):
    """2000000 * a does not fit 64 bits for such counts; the quotient must be exact all the same."""
    a, left, right = 4 * 10 ** 17 + 1, 5 * 10 ** 17 + 3, 9 * 10 ** 17 + 7
    got = spark.sql(f"SELECT (cast(2000000 as decimal(20, 0)) * cast({a}L as decimal(18, 0))) "
                    f"div (cast({left}L as decimal(20, 0)) + {right}L) AS s").first().s
    assert got == 2000000 * a // (left + right)
    assert duckdb.sql(f"SELECT 2000000::HUGEINT * {a} // ({left} + {right})").fetchall()[0][0] == got
