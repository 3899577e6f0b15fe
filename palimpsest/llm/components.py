"""Connected components by alternating large and small stars; every round is a few joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component``, the least id that links reach, of every id in ``links``.

    Rounds halve the depth of the trees that the links form, so their number grows with the logarithm of the longest
    chain. Each round's edges are checkpointed in the shared folder. Loops and repeated links change nothing; nulls
    are not linked; no links give an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = checkpointed(edges)
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = Window.partitionBy("u")
        large = both.withColumn("m", F.least(F.min("v").over(around), F.col("u"))).filter(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.withColumn("m", F.min("v").over(around))
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).union(
            down.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return checkpointed(roots.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
