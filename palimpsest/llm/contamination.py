"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents long, so the Jaccard similarity of an item with a whole document is near nothing.
Items are partitioned by the size of their shingle set, in powers of two. For the items of a partition a document is
cut into windows of twice the partition's size, half overlapping: a passage that repeats an item lies in one of them,
where its Jaccard similarity is a quarter or more. An item is a candidate for a document when any of ``HASHES``
minimum hashes of a window equals the item's. That misses a whole passage with probability under 0.76 ^ HASHES, about
2e-8, and one of which only half is left in a window under 3e-4. An item of fewer than ``SHORT`` shingles must be there
whole; it is looked up by one of its shingles and never missed. Every candidate is then verified: the part of the
item's distinct shingles that occur anywhere in the whole document must reach the threshold.

Items are compared in blocks of ``BLOCK``: the signatures of one block, bounded by that parameter, go to every task, and
documents never leave their task. More items take more passes.

Null and blank texts and items match nothing. An item of fewer than five words is one shingle, as is a document of
fewer; they match only one another. Repeated items are found each for itself, repeated rows too. Rows with null ids
are searched as others. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palimpsest.llm import texts

HASHES = 64
BLOCK = 4096  # items whose signatures a task holds at once
PERCENT = 80
LEAST = 8  # shingles of the smallest partition of items
SHORT = 4  # items of fewer shingles must be there whole: they are looked up by one of their shingles
_FILTER = 16  # bits of the table that most window minima fail in

_FACTORS = texts.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Index:
    """The signatures of one block of items."""

    def __init__(self, ids: list, given: list[str | None]):
        sets = texts.Words(pa.array(given, pa.string())).shingles()
        held = [i for i, s in enumerate(sets) if len(s)]
        self.ids, self.sets = [ids[i] for i in held], [sets[i] for i in held]
        self.partitions = {}
        size = np.array([len(s) for s in self.sets], np.int64)
        width = np.maximum(LEAST, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        short = np.flatnonzero(size < SHORT)
        first = np.array([self.sets[i][0] for i in short], np.uint64)
        order = np.argsort(first, kind="stable")
        self.short = first[order], short[order]
        for w in sorted(set(width[size >= SHORT].tolist())):
            rows = np.flatnonzero((width == w) & (size >= SHORT))
            minima = np.stack([(self.sets[i][:, None] * _FACTORS).min(0) for i in rows])
            order = np.argsort(minima, axis=0, kind="stable")
            values = np.take_along_axis(minima, order, 0)
            tables = np.zeros((HASHES, 1 << _FILTER), bool)
            for k in range(HASHES):
                tables[k, self._slot(values[:, k])] = True
            self.partitions[w] = (values, rows[order], tables)

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(17)).astype(np.int64) & ((1 << _FILTER) - 1)

    def candidates(self, runs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) whose signatures meet in some window; ``runs`` are shingle hashes in order of position."""
        lengths = np.array([len(r) for r in runs], np.int64)
        if not lengths.sum():
            return set()
        hashes = np.concatenate(runs)
        of_run = np.concatenate([[0], np.cumsum(lengths)])
        found: set[tuple[int, int]] = set()
        values, items = self.short
        if len(values):
            for at in np.flatnonzero(values[np.minimum(np.searchsorted(values, hashes), len(values) - 1)] == hashes).tolist():
                low, high = np.searchsorted(values, hashes[at]), np.searchsorted(values, hashes[at], "right")
                doc = int(np.searchsorted(of_run, at, "right")) - 1
                found.update((doc, int(item)) for item in items[low:high])
        if not self.partitions:
            return found
        blocks = -(-lengths // LEAST)
        first = np.concatenate([[0], np.cumsum(blocks)])
        owner = np.repeat(np.arange(len(runs)), blocks)
        starts = of_run[owner] + (np.arange(first[-1]) - first[owner]) * LEAST
        layouts = {}
        for w in self.partitions:
            step = w // LEAST
            inside = np.arange(first[-1]) - first[owner]
            heads = np.flatnonzero(inside % step == 0)
            layouts[w] = (heads, owner[heads], owner[heads][1:] == owner[heads][:-1])
        for k in range(HASHES):
            least = np.minimum.reduceat(hashes * _FACTORS[k], starts)
            for w, (values, items, tables) in self.partitions.items():
                heads, doc, together = layouts[w]
                window = np.minimum.reduceat(least, heads)
                window[:-1] = np.where(together, np.minimum(window[:-1], window[1:]), window[:-1])
                for at in np.flatnonzero(tables[k][self._slot(window)]).tolist():
                    low, high = np.searchsorted(values[:, k], window[at]), np.searchsorted(
                        values[:, k], window[at], "right")
                    found.update((int(doc[at]), int(item)) for item in items[low:high, k])
        return found

    def matches(self, column: pa.Array, percent: int) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, shingles of the item, shingles of it found) of each document that holds an item."""
        runs = texts.Words(column).shingle_runs()
        sets: dict[int, np.ndarray] = {}
        for doc, item in sorted(self.candidates(runs)):
            if doc not in sets:
                sets[doc] = np.unique(runs[doc])
            want, have = self.sets[item], sets[doc]
            met = int((have[np.minimum(np.searchsorted(have, want), len(have) - 1)] == want).sum())
            if 100 * met >= percent * len(want):
                yield doc, item, len(want), met


def _blocks(items: DataFrame, ident: str, text: str) -> Iterator[Index]:
    """Indexes of the items, BLOCK at a time: each block is an equal share of the hashes of the items."""
    given = items.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text")).filter(
        F.col("text").isNotNull())
    share = max(1, -(-given.count() // (BLOCK // 2)))  # half, so that uneven shares stay under BLOCK
    for k in range(share):
        rows = given.filter(F.pmod(F.xxhash64("text", F.col("id").cast("string")), F.lit(share)) == k).collect()
        rows.sort(key=lambda r: (str(r["id"]), r["text"]))
        yield Index([r["id"] for r in rows], [r["text"] for r in rows])


def contained_items(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text",
                    item_ident: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document and item found in it: both ids, the item's shingles and how many of them are there."""
    given = docs.select(docs[ident].alias("id"), docs[text].cast("string").alias("text"))
    kinds = [given.schema["id"].dataType.simpleString(), items.schema[item_ident].dataType.simpleString()]
    item_type = to_arrow_type(items.schema[item_ident].dataType)

    def searched(index: Index) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in texts.slices(batch):
                    hits = list(index.matches(piece.column("text"), percent))
                    if hits:
                        yield pa.RecordBatch.from_arrays(
                            [piece.column("id").take(pa.array([h[0] for h in hits], pa.int64())),
                             pa.array([index.ids[h[1]] for h in hits], item_type),
                             pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int64())],
                            ["id", "item", "n_item_shingles", "n_found"])
        return run
    found = None
    for index in _blocks(items, item_ident, item_text):
        part = given.mapInArrow(searched(index), f"id {kinds[0]}, item {kinds[1]}, n_item_shingles bigint, n_found bigint")
        found = part if found is None else found.unionAll(part)
    return found.select(F.col("id").alias(ident), F.col("item").alias(item_ident), "n_item_shingles", "n_found")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_ident: str = "item_id",
                  item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` less every document that holds an item; columns stay, and no row leaves its task."""
    def cleaned(index: Index) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in texts.slices(batch, names[place]):
                    keep = np.ones(piece.num_rows, bool)
                    keep[[h[0] for h in index.matches(piece.column(names[place]), percent)]] = False
                    yield piece.filter(pa.array(keep))
        return run
    place = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))]
    out = docs.toDF(*names)
    schema = out.schema
    for index in _blocks(items, item_ident, item_text):
        out = out.mapInArrow(cleaned(index), schema)
    return out.toDF(*docs.columns)
