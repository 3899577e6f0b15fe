"""Sharding by Karmarkar-Karp differencing: equal bytes in every shard, equal texts together.

Rows with equal texts are one indivisible group. The differencing method keeps partial partitions, vectors of one
load per shard, and repeatedly combines the two of largest spread, the larger loads of one onto the smaller loads of
the other. Here it runs in tiers, the largest groups first: the groups of a tier are dealt to buckets, and each bucket
is differenced in its own task together with its even share of all loads placed by the tiers before, so that smaller
groups level what larger ones left. A tier takes groups above a falling share of all bytes and has ``FAN`` times the
buckets of the one before, so that no bucket holds more than a bounded number of items; the last takes the rest in
buckets of about ``WIDTH``. The driver sees one number per shard and tier. The law held is ``bytes``: sizes near equal,
as far as the largest group of equal texts allows.

Slots are the gapless places of a shard's rows, numbered through chunks so that no task orders a whole shard.

The size of a row is the UTF-8 length of its text plus 1; a null text has none, is stored as size 1 and grouped with
empty texts, its CRC being that of no bytes. Null ids are placed like others. Repeated rows are rows of one group. An
empty table gives an empty result. Ties are settled by the hash of the text, so the result does not depend on
partitions. Other columns of the input are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.jaccard import written

WIDTH = 20000  # groups of a bucket of the last tier, on average
LARGE = 256  # a bucket of an earlier tier takes groups above its bytes / (shards x LARGE)
FAN = 256
CHUNK = 50000  # rows of a shard that are numbered together on average


def difference(loads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions, the rows of ``loads``, into one.

    Returns the loads of the result and, per item, the place that each of its own loads has in the result. Items are
    taken in their order on ties.
    """
    n, k = loads.shape
    order = np.argsort(-loads, axis=1, kind="stable")
    heap, nodes = [], []
    for i in range(n):
        sorted_loads = loads[i][order[i]].tolist()
        nodes.append((sorted_loads, None))
        heap.append((sorted_loads[-1] - sorted_loads[0], i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        one, two = nodes[a][0], nodes[b][0]
        summed = [(one[j] + two[k - 1 - j], j) for j in range(k)]
        summed.sort(key=lambda s: -s[0])
        made = [s[0] for s in summed]
        place = [0] * k  # where load j of the first went
        for at, (_, j) in enumerate(summed):
            place[j] = at
        nodes.append((made, (a, b, place)))
        heapq.heappush(heap, (made[-1] - made[0], len(nodes) - 1))
    top = heap[0][1]
    where: dict[int, list[int]] = {top: list(range(k))}
    out = np.empty((n, k), np.int64)
    for i in range(len(nodes) - 1, -1, -1):
        final = where.pop(i)
        if nodes[i][1] is None:
            out[i][order[i]] = final
        else:
            a, b, place = nodes[i][1]
            where[a] = [final[place[j]] for j in range(k)]
            where[b] = [final[place[k - 1 - j]] for j in range(k)]
    return np.array(nodes[top][0], np.int64), out


def _tier(groups: DataFrame, placed: list[int], buckets: int) -> DataFrame:
    """``key``, ``shard`` and ``size`` of groups differenced in buckets, each against its share of ``placed``."""
    shards = len(placed)
    share = np.array([load // buckets for load in placed], np.int64)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        loads = np.zeros((len(group) + 1, shards), np.int64)
        loads[0] = share
        loads[1:, 0] = group["size"]
        _, places = difference(loads)
        if share.min() == share.max():  # no shard is behind: turn the places so that rests do not add up
            shard = (places[1:, 0] + int(group["bucket"].iloc[0])) % shards
        else:
            shard = np.argsort(places[0])[places[1:, 0]]
        return pd.DataFrame({"key": group["key"], "shard": shard.astype(np.int32), "size": group["size"]})
    dealt = groups.select("key", "size", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(run, "key string, shard int, size bigint")


def assign(groups: DataFrame, shards: int) -> DataFrame:
    """``key`` and ``shard`` of each row of ``groups``, which has a distinct string ``key`` and its ``size``."""
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    last = max(1, -(-n // WIDTH))
    placed, done, above, buckets = [0] * shards, None, None, 1
    while True:
        ends = buckets >= last and buckets > 1 or n <= WIDTH
        floor = -1 if ends else total // (shards * LARGE * buckets)
        tier = groups.filter(F.col("size") > floor)
        tier = tier if above is None else tier.filter(F.col("size") <= above)
        tier = written(_tier(tier, placed, last if ends else buckets), "tier")
        done = tier if done is None else done.union(tier)
        if ends:
            return done.select("key", "shard")
        for row in tier.groupBy("shard").agg(F.sum("size").alias("size")).collect():
            placed[row["shard"]] += row["size"]
        above, buckets = floor, buckets * FAN


def _numbered(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 within each ``shard``, in the order of the hash of ``key`` and the id."""
    chunks = max(1, -(-rows.count() // (shards * CHUNK)))
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64("key", "id"), F.lit(chunks)))
    before = dealt.groupBy("shard", "_chunk").count().withColumn(
        "_before", F.sum("count").over(Window.partitionBy("shard").orderBy("_chunk")) - F.col("count")).select(
        "shard", "_chunk", "_before")
    inside = Window.partitionBy("shard", "_chunk").orderBy("key", "id")
    return dealt.withColumn("_at", F.row_number().over(inside)).join(before, ["shard", "_chunk"]).withColumn(
        "slot", F.col("_before") + F.col("_at") - 1).drop("_chunk", "_at", "_before")


def shard(docs: DataFrame, shards: int = 8, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``ident``, size, text_crc32, law, shard, slot, grown_shard."""
    given = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = written(docs.select(
        docs[ident].alias("id"), (F.octet_length(given) + 1).cast("bigint").alias("size"),
        F.crc32(given).alias("text_crc32"), F.sha2(given, 256).alias("key")), "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    placed = written(assign(groups, shards), "placed")
    numbered = _numbered(rows.join(placed, "key"), shards)
    return numbered.select(
        F.col("id").alias(ident), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
