"""Sharding: the differencing step against its definition, balance, groups together, gapless slots, odd rows."""

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import queries, sharding


def brute(sizes, shards):
    """Differencing with explicit lists of members: loads and members of each shard."""
    parts = [([s] + [0] * (shards - 1), [[i]] + [[] for _ in range(shards - 1)], i) for i, s in enumerate(sizes)]
    step = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[0][-1] - p[0][0], p[2]))
        (a, ma, _), (b, mb, _) = parts.pop(0), parts.pop(0)
        both = sorted(((a[j] + b[-1 - j], ma[j] + mb[-1 - j]) for j in range(shards)), key=lambda x: -x[0])
        parts.append(([x for x, _ in both], [m for _, m in both], step))
        step += 1
    return parts[0][0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=40), st.integers(2, 8))
def test_differencing_equals_its_definition(sizes, shards):
    loads = np.zeros((len(sizes), shards), np.int64)
    loads[:, 0] = sizes
    made, places = sharding.difference(loads)
    assert made.tolist() == brute(sizes, shards)
    again = np.zeros(shards, np.int64)
    for size, place in zip(sizes, places[:, 0]):
        again[place] += size
    assert again.tolist() == made.tolist() and all(sorted(p) == list(range(shards)) for p in places.tolist())


def test_contract_on_given_documents_with_several_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WIDTH", 100)
    monkeypatch.setattr(sharding, "CHUNK", 20)
    monkeypatch.setattr(sharding, "FAN", 4)
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.QUERIES["op6_sharding"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    loads, slots, together = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        together[data].add(r.shard)
    assert sorted(loads) == list(range(8)) and max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in together.values())


def test_a_group_larger_than_a_shard_is_levelled_by_the_rest(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WIDTH", 50)
    rows = [(str(i), 1000 + i) for i in range(400)] + [("giant", 250000)]
    groups = spark.createDataFrame(rows, "key string, size bigint")
    loads = defaultdict(int)
    sizes = dict(rows)
    for r in sharding.assign(groups, 8).collect():
        loads[r.shard] += sizes[r.key]
    rest = sorted(loads.values())
    assert rest[-1] == 250000 and rest[-2] - rest[0] < 3000


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a" * 100000, "x"), (4, "b", "x"), (4, "b", "x"), (None, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    got = sharding.shard(docs).collect()
    assert len(got) == 6 and [r.size for r in got if r.doc_id in (1, 2)] == [1, 1]
    assert len({r.shard for r in got if r.doc_id == 4}) == 1
    assert sharding.shard(docs.filter("doc_id < 0")).collect() == []


def test_balance_with_production_parameters(spark):
    loads = defaultdict(int)
    for r in queries.QUERIES["op6_sharding"](spark, "/root/testdata/sf0.01").collect():
        loads[r.shard] += r.size
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) < 100
