"""N-gram Jaccard join with PartEnum signatures: every pair of texts whose shingle sets are alike enough.

A text's set is its distinct word shingles (``texts.Words``). Sets are banded by size so that alike sets are in the
same or neighbouring bands. For two bands a bound k on the size of the symmetric difference of alike sets is known.
The feature domain is partitioned on two levels: into n first parts, and each of these into ``SECOND`` second parts. At most
k // 2 first parts hold two differences or more; in any other at most one second part differs, so alike sets agree on some
subset of all but one of its second parts. Each such subset, its content with its number, is a signature. (Sets too small
for that have one level: k parts may differ, and a part is a signature.) Empty subsets give no signature: a set whose
first parts with an empty subset could be all those that agree is signed again under the next partition of the domain,
until it has fewer. Of two alike sets the one that stops first is signed in full where the other is signed as well,
hence they share a signature that is not empty. The join is exact up to 64-bit hash collisions.

Equal sets are one class from the start. All signatures with the same least class are one bucket: two classes that share
a signature share its least class, so no pair is lost, and near copies that share hundreds of signatures meet in a few
buckets. A bucket is not expanded into pairs: each class is first compared with the least class of each of its buckets,
and of those that pass a bound on sizes and a bound from 1,024 parity bits of each set it is verified with the one it
shares most signatures with. In further rounds each component proposes its best untested pair with another component of
some bucket, until a round finds no link. That settles groups of near copies with about one comparison for each class.
Only buckets that still hold several components are then compared between components, all pairs that the bounds let
pass. Every link is verified by exact intersection. Sets are made again for the classes to verify, picked out by a bit
table of fixed size, and so neither texts nor the sets of all documents are shuffled.

Null and blank texts have the empty set, size 0, and link with nothing: their component is their own id. Rows with a
null id keep their size; their component is null and they link nothing. Repeated rows are members of one class. An
empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import texts
from palimpsest.llm.components import components
from palimpsest.session import shared_folder

PERCENT = 80
SKETCH = 16  # words of 64 parity bits
BITS = [f"bits{i}" for i in range(SKETCH)]
WANTED_BITS = 24
TURNS = 2  # rounds of proposals at most; what they leave is compared in full
SECOND = 3  # second parts of a first part; a signature is all but one of them
ROUNDS = 64  # partitions of the domain that a set may be signed under


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what follows does not depend on the executors that made it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@cache
def _cells(percent: int) -> np.ndarray:
    """Least size of each band: sets alike enough are in one band or in two neighbouring ones."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(100 * bounds[-1] // percent + 1)
    return np.array(bounds, np.int64)


@cache
def _parts(band: int, percent: int) -> tuple[int, int, int]:
    """(n, s, k) for the bands ``band`` and ``band`` + 1: n first parts of ``s`` second parts each. Of two alike sets at
    least n - k first parts differ in no second part (s = 1) or in one at most; n is the number for which the expected
    number of signatures is least. Sets too small for second parts have one level."""
    bounds = _cells(percent)
    low, high = int(bounds[band]), int(bounds[band + 1]) - 1
    differ = (100 - percent) * (high + 100 * high // percent) // (100 + percent)
    for s in (SECOND, 1):
        k = differ // 2 if s > 1 else differ
        size = low if s > 1 else (low + high) / 2
        best = None
        for n in range(k + 1, 2 * k + 4):
            share = size / n
            weak = math.exp(-share) if s == 1 else min(1.0, s * math.exp(-share * (s - 1) / s) - (s - 1) * math.exp(-share))
            fine = 0.5 * math.erfc((n * weak - (n - k - 0.5)) / math.sqrt(max(n * weak * (1 - weak), 1e-9)) / math.sqrt(2))
            cost = n / max(fine, 1e-6)
            if best is None or cost < best[0]:
                best = (cost, n, fine)
        if s == 1 or best[2] >= 0.5:
            return best[1], s, k


def set_key(shingles: np.ndarray) -> np.uint64:
    """One 64-bit value for a whole set."""
    total = texts.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return texts.mix(total.reshape(1) + np.uint64(len(shingles)))[0]


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Index of the set and signature, for all signatures of all sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    cell = np.searchsorted(_cells(percent), sizes, "right") - 1
    # A set stands in the band pair that it opens and in the one that it closes.
    owner = np.concatenate([np.flatnonzero(sizes > 0), np.flatnonzero(cell > 0)])
    band = np.concatenate([cell[sizes > 0], cell[cell > 0] - 1])
    rows, found = [], []
    for seed in range(ROUNDS):
        if not len(owner):
            break
        shape = {int(b): _parts(int(b), percent) for b in np.unique(band)}
        n, second, k = np.array([shape[b] for b in band.tolist()], np.int64).T
        cells = n * second
        base = np.concatenate([[0], np.cumsum(cells)])
        lengths = sizes[owner]
        elements = np.concatenate([sets[i] for i in owner.tolist()])
        spun = texts.mix(elements ^ np.uint64(0x9E37 + 0x1F123BB5 * (seed + 1)))
        part = ((spun >> np.uint64(32)) * np.repeat(n, lengths).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        within = ((spun & np.uint64(0xFFFFFFFF)) * np.repeat(second, lengths).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        place = np.repeat(base[:-1], lengths) + part * np.repeat(second, lengths) + within
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, place, texts.mix(elements + np.uint64(seed)))
        filled = np.zeros(base[-1], bool)
        filled[place] = True
        # A subset leaves out one second part; it takes that one's place. A first part is weak if some subset is empty.
        two = np.repeat(second > 1, cells)
        sums, there = total[two].reshape(-1, SECOND), filled[two].reshape(-1, SECOND)
        subset = np.stack([np.delete(there, j, 1).any(1) for j in range(SECOND)], 1)
        total[two] = (sums.sum(1, dtype=np.uint64)[:, None] - sums).ravel()
        filled[two] = subset.ravel()
        weak = (~filled).astype(np.int64)
        weak[two] = np.pad((~subset).any(1).astype(np.int64)[:, None], ((0, 0), (0, SECOND - 1))).ravel()
        label = (np.repeat(band * ROUNDS + seed, cells) << 36) + (np.arange(base[-1]) - np.repeat(base[:-1], cells))
        signature = texts.mix(total ^ texts.mix(label.astype(np.uint64)))
        rows.append(np.repeat(owner, cells)[filled])
        found.append(signature[filled])
        again = np.add.reduceat(weak, base[:-1]) >= n - k
        owner, band = owner[again], band[again]
    else:
        if len(owner):
            raise ValueError("a set has too many empty parts under every partition")
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(rows), np.concatenate(found)


def _shingled(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    for piece in texts.slices(batch):
        sets = texts.Words(piece.column("text")).shingles()
        yield piece, sets, np.array([set_key(s) for s in sets], np.uint64).view(np.int64)


def members(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text_hash, set_key, n_shingles and the parity bits of each row's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, sets, keys in _shingled(batch):
                bits = np.array([np.packbits((np.bincount((s >> np.uint64(17)).astype(np.int64) % (64 * SKETCH),
                                                          minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)
                                 for s in sets]).reshape(-1, SKETCH)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("text_hash"), pa.array(keys), pa.array([len(s) for s in sets], pa.int64()),
                     *(pa.array(bits[:, i].copy()) for i in range(SKETCH))],
                    ["id", "text_hash", "set_key", "n_shingles", *BITS])
    given = docs.select(docs[ident].alias("id"), F.xxhash64(docs[text].cast("string")).alias("text_hash"),
                        docs[text].cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, text_hash bigint, set_key bigint, n_shingles bigint, {', '.join(f'{b} bigint' for b in BITS)}")


def signed(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """signature and set_key; equal sets of one task are signed once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, sets, keys in _shingled(batch):
                fresh = [i for i, key in enumerate(keys.tolist()) if len(sets[i]) and key not in seen
                         and not seen.add(key)]
                row, signature = signatures([sets[i] for i in fresh], percent)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signature.view(np.int64)), pa.array(keys[np.array(fresh)][row])],
                        ["signature", "set_key"])
    return docs.select(docs[text].cast("string").alias("text")).mapInArrow(run, "signature bigint, set_key bigint")


def _wanted_bits(wanted: DataFrame) -> np.ndarray:
    """A table of 2 ** WANTED_BITS bits, those of the hashes of the keys in ``wanted`` set: 2 MB for any input."""
    slot = F.col("set_key").bitwiseAND(F.lit((1 << WANTED_BITS) - 1))
    words = wanted.select(F.shiftright(slot, 6).alias("word"), F.expr(
        f"shiftleft(1L, cast(set_key & {63} as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(1 << (WANTED_BITS - 6), np.int64)
    found = words.toArrow()
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.view(np.uint64)


def _sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """set_key and shingles of the sets whose key is in ``wanted``, and of few others; one row per set and task."""
    table = _wanted_bits(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, sets, keys in _shingled(batch):
                slot = keys.view(np.uint64) & np.uint64((1 << WANTED_BITS) - 1)
                hit = table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)
                chosen = [i for i in np.flatnonzero(hit).tolist() if len(sets[i]) and keys[i] not in seen
                          and not seen.add(keys[i])]
                if not chosen:
                    continue
                values = pa.array(np.concatenate([sets[i] for i in chosen]).view(np.int64))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(sets[i]) for i in chosen])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[np.array(chosen)]), pa.ListArray.from_arrays(offsets, values)],
                    ["set_key", "shingles"])
    return docs.select(docs[text].cast("string").alias("text")).mapInArrow(
        run, "set_key bigint, shingles array<bigint>").groupBy("set_key").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough, by exact intersection."""
    one = sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("two")).join(
        pairs.select("b").distinct(), "b", "left_semi")  # sets of no pair are not shuffled
    both = pairs.join(one, "a").join(two, "b")
    met = F.size(F.array_intersect("one", "two")).cast("bigint")
    whole = (F.size("one") + F.size("two")).cast("bigint")
    return both.filter(met * (100 + percent) >= whole * percent).select("a", "b")


def _keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")).distinct()


def _open_buckets(shared: DataFrame, component: DataFrame) -> DataFrame:
    """least, set_key, times and component of the buckets that hold several components."""
    bucket = Window.partitionBy("least")
    held = shared.select("least", "set_key", "times").join(
        component.withColumnRenamed("id", "set_key"), "set_key", "left").select(
        "least", "set_key", "times", F.coalesce("component", "set_key").alias("component"))
    return held.withColumn("low", F.min("component").over(bucket)).withColumn(
        "high", F.max("component").over(bucket)).filter(F.col("low") < F.col("high")).drop("low", "high")


def _plausible(pairs: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` whose classes a and b pass the bounds."""
    x, y = traits.alias("x"), traits.alias("y")
    return pairs.join(x, F.col("a") == F.col("x.set_key")).join(y, F.col("b") == F.col("y.set_key")).filter(
        _may_be_alike("x", "y", percent)).select(*pairs.columns)


def _proposals(open_buckets: DataFrame, traits: DataFrame, tested: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each component its best untested pair (a, b) with a delegate of another component of one of its buckets.

    A bucket has two delegates of different components, drawn by a hash that changes with ``turn``.
    """
    bucket = Window.partitionBy("least")
    drawn = F.struct(F.xxhash64(F.lit(turn), "set_key").alias("h"), "set_key", "component")
    first = open_buckets.withColumn("one", F.min(drawn).over(bucket))
    second = first.withColumn("two", F.min(F.when(F.col("component") != F.col("one.component"), drawn)).over(bucket))
    met = second.select(
        "component", "times", F.col("set_key").alias("a"),
        F.when(F.col("component") != F.col("one.component"), F.col("one.set_key")).otherwise(
            F.col("two.set_key")).alias("b")).groupBy("component", "a", "b").agg(F.sum("times").alias("times"))
    fresh = met.join(tested, ["a", "b"], "left_anti")
    return _plausible(fresh, traits, percent).groupBy("component").agg(
        F.max(F.struct("times", "a", "b")).alias("best")).select("best.a", "best.b").distinct()


def _may_be_alike(x: str, y: str, percent: int) -> Column:
    """The bounds that alike sets meet: on sizes, and on the parity bits that a difference can change."""
    size = F.col(f"{x}.size") + F.col(f"{y}.size")
    changed = sum((F.bit_count(F.col(f"{x}.bits{i}").bitwiseXOR(F.col(f"{y}.bits{i}"))) for i in range(SKETCH)),
                  F.lit(0))
    return ((F.col(f"{x}.size") * 100 >= F.col(f"{y}.size") * percent)
            & (F.col(f"{y}.size") * 100 >= F.col(f"{x}.size") * percent)
            & (changed * (100 + percent) <= size * (100 - percent)))


def links(docs: DataFrame, classes: DataFrame, text: str = "text",
          percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between set keys that join all that any links join, and the components (id, component).

    ``classes`` has set_key, size and parity bits of each set.
    """
    bucket = Window.partitionBy("signature")
    shared = written(signed(docs, text, percent).select(
        "set_key", F.min("set_key").over(bucket).alias("least"),
        F.max("set_key").over(bucket).alias("most")).filter(F.col("least") < F.col("most")).groupBy(
        "least", "set_key").agg(F.count("*").alias("times")), "buckets")

    traits = classes.select("set_key", "size", *BITS)
    met = written(_plausible(shared.filter(F.col("set_key") != F.col("least")).select(
        F.col("set_key").alias("a"), F.col("least").alias("b"), "times"), traits, percent), "met")
    known = _keys(met)
    sets = written(_sets(docs, known, text), "sets")
    tested = written(met.groupBy("a").agg(F.max(F.struct("times", "b"))["b"].alias("b")), "tested")
    found = written(_verified(tested, sets, percent), "links")
    component = components(found)
    inside = shared.join(known, "set_key", "left_semi")
    near = written(traits.join(known, "set_key", "left_semi"), "near")
    for turn in range(TURNS):
        inside = written(_open_buckets(inside, component), "open")  # a bucket that is settled stays so
        proposed = written(_proposals(inside, near, tested, turn, percent), "proposed")
        more = written(_verified(proposed, sets, percent), "links")
        if more.isEmpty():
            break
        tested, found = tested.union(proposed), found.union(more)
        component = components(found)

    held = _open_buckets(shared, component).join(traits, "set_key")
    x, y = held.alias("x"), held.alias("y")
    crossing = x.join(y, (F.col("x.least") == F.col("y.least")) & (F.col("x.set_key") < F.col("y.set_key"))
                      & (F.col("x.component") != F.col("y.component")) & _may_be_alike("x", "y", percent)).select(
        F.col("x.set_key").alias("a"), F.col("y.set_key").alias("b")).distinct()
    both = tested.union(tested.select("b", "a"))
    crossing = written(crossing.join(both, ["a", "b"], "left_anti"), "crossing")
    sets = written(_sets(docs, _keys(crossing), text), "sets")
    more = written(_verified(crossing, sets, percent), "links")
    found = found.union(more)
    return found, component if more.isEmpty() else components(found)


def jaccard_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``ident``, n_shingles and component_id, the least id reachable by links."""
    return _grouped(docs, ident, text, percent).select(F.col("id").alias(ident), "n_shingles", "component_id")


def _grouped(docs: DataFrame, ident: str, text: str, percent: int) -> DataFrame:
    rows = written(members(docs, ident, text), "members")
    known = rows.filter(F.col("id").isNotNull())
    classes = written(known.filter(F.col("n_shingles") > 0).groupBy("set_key").agg(
        F.min("id").alias("id"), F.first("n_shingles").alias("size"), *(F.first(b).alias(b) for b in BITS)), "classes")
    _, component = links(docs.filter(docs[ident].isNotNull()), classes, text, percent)
    labelled = classes.join(component.withColumnRenamed("id", "set_key"), "set_key", "left").select(
        "set_key", "id", F.coalesce("component", "set_key").alias("component"))
    least = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    named = written(labelled.join(least, "component").select("set_key", "component_id"), "named")
    return rows.join(named, "set_key", "left").select(
        "id", "text_hash", "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")),
                                                   F.col("id"))).alias("component_id"))


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` less every text that is not the first of its component; columns stay. Rows without id stay; of rows
    that repeat both id and text one stays."""
    groups = _grouped(docs, ident, text, percent)
    kept = written(groups.filter(F.col("id") == F.col("component_id")).groupBy(
        F.col("id").alias("_kept"), F.col("text_hash").alias("_hash")).agg((F.count("*") > 1).alias("_again")), "kept")
    named = docs.filter(docs[ident].isNotNull())

    def among(some: DataFrame) -> DataFrame:
        return named.join(some, (named[ident] == some["_kept"]) & (F.xxhash64(named[text].cast("string")) == some["_hash"]), "left_semi")
    # Only texts of rows that repeat are shuffled to be told apart.
    once, again = among(kept.filter("NOT _again")), among(kept.filter("_again"))
    return once.unionByName(again.dropDuplicates([ident, text])).unionByName(docs.filter(docs[ident].isNull()))
