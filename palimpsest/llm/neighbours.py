"""Near duplicates among embeddings: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation of the principal directions is learned so that signs of rotated coordinates lose least, on at most
``FIT_ROWS`` vectors, those with the smallest hash: a documented bound; every vector is indexed. The signs are a code of
up to 64 bits. The code is cut into ``TABLES`` pieces, each the key of a table; a vector is entered under its piece and
under all pieces one bit away, so vectors meet when some piece differs in at most two bits. Two vectors at the
threshold of 0.93 differ in each bit with probability about 0.12 and so meet with probability over 0.99; closer ones
meet more surely. What meets is compared by its original vectors in double precision.

Equal vectors are one class. A class within half the threshold's angle of a leader (the least class that shares a piece
with it, if not itself led) joins the leader's cluster, whose members are all linked with one another. Clusters, not
vectors, are entered in the tables. By the triangle inequality most pairs of clusters are linked throughout or nowhere;
only the others are compared member by member. So groups of near copies are counted without being expanded into pairs.

Vectors that are null or zero, or hold null or non-finite components, and vectors with a null label link with nothing:
0 links, their own component. Vectors of different length link with nothing either. Rows with a null id are left out of
all links; their component is null. Repeated rows are vectors of their own and count as links of one another. An empty
table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.jaccard import written

FIT_ROWS = 4000
ITERATIONS = 50
BITS = 64
TABLES = 4
SLACK = 1e-9  # radians by which rounding may move an angle


def fit_rotation(vectors: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits): sign((v - mean) @ projection) is the code of a unit vector v."""
    mean = vectors.mean(0)
    centred = vectors - mean
    bits = min(bits, vectors.shape[1])
    _, directions = np.linalg.eigh(centred.T @ centred)
    directions = directions[:, ::-1][:, :bits]
    flat = centred @ directions
    random = np.random.Generator(np.random.Philox(11))
    rotation, _ = np.linalg.qr(random.standard_normal((bits, bits)))
    for _ in range(ITERATIONS):
        left, _, right = np.linalg.svd(np.where(flat @ rotation >= 0, 1.0, -1.0).T @ flat)
        rotation = (left @ right).T
    return mean, directions @ rotation


def codes(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    signs = (vectors - mean) @ projection >= 0
    weights = np.uint64(1) << np.arange(signs.shape[1], dtype=np.uint64)
    return (signs * weights).sum(1, dtype=np.uint64).view(np.int64)


def _rows(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list array whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _angles(pairs: DataFrame, vectors: DataFrame, x: str, y: str) -> DataFrame:
    """``pairs`` with ``cosine`` and ``angle`` of the vectors of the classes in columns ``x`` and ``y``."""
    kept = pairs.columns
    one = vectors.select(F.col("class").alias(x), F.col("vector").alias("_one"))
    two = vectors.select(F.col("class").alias(y), F.col("vector").alias("_two"))
    both = pairs.join(one, x).join(two, y).select(*kept, "_one", "_two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("_one"), batch.column("_two")
            length = np.asarray(a.value_lengths())
            cosine = np.zeros(batch.num_rows)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                cosine[at] = (_rows(a.take(pa.array(at))) * _rows(b.take(pa.array(at)))).sum(1)
            angle = np.arccos(np.clip(cosine, -1, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(cosine), pa.array(angle)],
                                             [*kept, "cosine", "angle"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return both.mapInArrow(run, f"{schema}, cosine double, angle double")


def _coded(classes: DataFrame) -> DataFrame:
    """class, space (label and length), code and number of bits of each class; one rotation per vector length."""
    lengths = [r[0] for r in classes.select(F.size("vector").alias("n")).distinct().collect()]
    fitted = {}
    for n in sorted(lengths):
        sample = classes.filter(F.size("vector") == n).orderBy(F.xxhash64("class"), "class").limit(FIT_ROWS)
        given = np.array([r["vector"] for r in sample.select("vector").collect()], float)
        fitted[n] = fit_rotation(given / np.linalg.norm(given, axis=1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("vector").value_lengths())
            code = np.zeros(batch.num_rows, np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                code[at] = codes(_rows(batch.column("vector").take(pa.array(at))), *fitted[n])
            bits = np.minimum(length, BITS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("space"), pa.array(code),
                                              pa.array(bits)], ["class", "space", "code", "bits"])
    return classes.select("class", "space", "vector").mapInArrow(run, "class bigint, space bigint, code bigint, bits int")


def _keys(coded: DataFrame, near: bool) -> DataFrame:
    """class and key of each table entry: the piece of each table and, when ``near``, those one bit away."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("code").to_numpy().view(np.uint64)
            space = batch.column("space").to_numpy().view(np.uint64)
            bits = batch.column("bits").to_numpy()
            owner, keys = [], []
            for total in np.unique(bits).tolist():
                rows = np.flatnonzero(bits == total)
                cuts = np.linspace(0, total, min(TABLES, total) + 1).astype(int)
                for table, (low, high) in enumerate(zip(cuts, cuts[1:])):
                    piece = (code[rows] >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)
                    flips = [0, *(1 << i for i in range(high - low))] if near else [0]
                    for flip in flips:
                        owner.append(rows)
                        keys.append((space[rows] * np.uint64(0x9E3779B97F4A7C15)) ^ (
                            (piece ^ np.uint64(flip)) * np.uint64(TABLES) + np.uint64(table)) * np.uint64(
                            0xD6E8FEB86659FD93))
            owner, keys = np.concatenate(owner), np.concatenate(keys)
            yield pa.RecordBatch.from_arrays([batch.column("class").take(pa.array(owner)),
                                              pa.array(keys.view(np.int64))], ["class", "key"])
    return coded.mapInArrow(run, "class bigint, key bigint")


def _clusters(coded: DataFrame, vectors: DataFrame, half: float) -> DataFrame:
    """class, root and the angle between them: classes led by a root within ``half``, all others their own root."""
    bucket = Window.partitionBy("key")
    met = _keys(coded, near=False).withColumn("leader", F.min("class").over(bucket)).filter(
        F.col("leader") < F.col("class")).select("class", "leader").distinct()
    led = written(_angles(met, vectors, "class", "leader").filter(F.col("angle") <= half - SLACK), "led")
    free = led.join(led.select(F.col("class").alias("leader")).distinct(), "leader", "left_anti")
    chosen = free.groupBy("class").agg(F.min(F.struct("leader", "angle")).alias("best"))
    return coded.select("class").join(chosen, "class", "left").select(
        "class", F.coalesce("best.leader", "class").alias("root"), F.coalesce("best.angle", F.lit(0.0)).alias("angle"))


def near_duplicates(table: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = 0.93) -> DataFrame:
    """Per row of ``table``: ``ident``, n_links, component_id and kept (whether it is its component)."""
    limit = math.acos(cosine)
    given = table.select(F.col(ident).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"),
                         F.transform(vector, lambda v: v.cast("double")).alias("vector"))
    sound = (F.col("vector").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
             & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
             & F.exists("vector", lambda v: v != 0))
    sound = F.coalesce(sound, F.lit(False))
    space = F.xxhash64("label", F.size("vector"))
    keyed = given.withColumn("sound", sound).withColumn("space", space).withColumn(
        "content", F.when(F.col("sound"), F.concat_ws("/", F.xxhash64("space", "vector"),
                                                      F.xxhash64(F.lit(1), "vector", "label"))))
    classes = written(keyed.filter("sound").groupBy("content").agg(
        F.min("id").alias("class"), F.count("*").alias("copies"), F.first("space").alias("space"),
        F.first("vector").alias("vector")), "classes")
    # One id may stand for several vectors, so a class is named by its content.
    classes = classes.withColumn("id", F.col("class")).withColumn("class", F.xxhash64("content"))
    vectors = classes.select("class", "vector")
    coded = written(_coded(classes), "codes")
    member = written(_clusters(coded, vectors, limit / 2).join(classes.select("class", "copies", "id"), "class"), "members")
    cluster = written(member.groupBy("root").agg(
        F.sum("copies").alias("weight"), F.max("angle").alias("radius"), F.min("id").alias("id"),
        F.count("*").alias("size")).join(coded.select(F.col("class").alias("root"), "code", "bits"), "root"), "clusters")

    entries = _keys(coded, near=True).join(member.select("class", "root"), "class").select("key", "root").distinct()
    entries = entries.join(cluster.select("root", "code", "bits", "radius"), "root")
    x, y = entries.alias("x"), entries.alias("y")
    # Bits expected to differ over the widest angle at which members can be linked, and four deviations more.
    part = F.least(F.lit(1.0), (F.lit(limit) + F.col("x.radius") + F.col("y.radius")) / F.lit(math.pi))
    may = F.bit_count(F.col("x.code").bitwiseXOR(F.col("y.code"))) <= F.col("x.bits") * part + 4 * F.sqrt(
        F.col("x.bits") * part * (1 - part)) + 1
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root"))
                   & (F.col("x.bits") == F.col("y.bits")) & may).select(
        F.col("x.root").alias("a"), F.col("y.root").alias("b"),
        (F.col("x.radius") + F.col("y.radius")).alias("reach")).distinct()
    met = written(_angles(pairs, vectors, "a", "b"), "met")
    single = F.col("reach") == 0
    whole = met.filter(F.when(single, F.col("cosine") >= cosine).otherwise(
        F.col("angle") + F.col("reach") <= limit - SLACK)).select("a", "b")
    mixed = met.filter(~single & (F.col("angle") + F.col("reach") > limit - SLACK)
                       & (F.col("angle") - F.col("reach") <= limit + SLACK)).select("a", "b")
    of = member.select("root", "class", "copies")
    split = mixed.join(of.select(F.col("root").alias("a"), F.col("class").alias("one"),
                                 F.col("copies").alias("n_one")), "a").join(
        of.select(F.col("root").alias("b"), F.col("class").alias("two"), F.col("copies").alias("n_two")), "b")
    split = written(_angles(split, vectors, "one", "two").filter(F.col("cosine") >= cosine).drop("cosine", "angle"),
                    "split")

    beside = whole.union(whole.select("b", "a")).join(
        cluster.select(F.col("root").alias("b"), "weight"), "b").groupBy(F.col("a").alias("root")).agg(
        F.sum("weight").alias("beside"))
    apart = split.select(F.col("one").alias("class"), F.col("n_two").alias("n")).union(
        split.select("two", "n_one")).groupBy("class").agg(F.sum("n").alias("apart"))
    component = components(whole.union(split.select("a", "b"))).withColumnRenamed("id", "root")
    joined = cluster.join(component, "root", "left").withColumn("component", F.coalesce("component", "root"))
    least = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    roots = joined.join(least, "component").select("root", "weight", "component_id").join(beside, "root", "left")
    counted = member.select("class", "root").join(roots, "root").join(apart, "class", "left").select(
        "class", "component_id",
        (F.col("weight") - 1 + F.coalesce("beside", F.lit(0)) + F.coalesce("apart", F.lit(0))).alias("n_links"))
    named = written(counted.join(classes.select("class", "content"), "class").drop("class"), "named")
    out = keyed.select("id", "content").join(named, "content", "left")
    return out.select(
        F.col("id").alias(ident), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))
