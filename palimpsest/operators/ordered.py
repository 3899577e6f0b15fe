"""Running values over ordered groups of any size.

A plain window puts a whole group in one task. Here a group is cut into chunks of its order column; each chunk is
windowed on its own, and what earlier or later chunks contribute is carried in from one aggregate row per chunk.
A key that holds a third of all rows is then many chunks, spread like any other rows.

``chunk`` must grow with the order and hold a bounded number of rows, as ``turn div 4096`` does for turns numbered
within a conversation. Windows inside one document need none of this: a document is one cell, split by one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """One running value. ``how``: sum, max, last, next or lag; ``before`` leaves the row itself out."""
    how: str
    value: Column
    before: bool = False


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, **wanted: Running) -> DataFrame:
    position = F.struct(*order)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    onward = local.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    after = local.rowsBetween(1, Window.unboundedFollowing)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across.rowsBetween(1, Window.unboundedFollowing)

    total = {
        "sum": lambda v: F.sum(v), "max": lambda v: F.max(v),
        "last": lambda v: F.max_by(v, F.when(v.isNotNull(), position)),
        "next": lambda v: F.min_by(v, F.when(v.isNotNull(), position)),
        "lag": lambda v: F.max_by(v, position),
    }
    carry = {
        "sum": lambda c: F.sum(c).over(earlier), "max": lambda c: F.max(c).over(earlier),
        "last": lambda c: F.last(c, ignorenulls=True).over(earlier),
        "next": lambda c: F.first(c, ignorenulls=True).over(later),
        "lag": lambda c: F.lag(c).over(across),
    }

    def combine(how, value, carried, exclusive):
        span = before if exclusive else upto
        if how == "sum":
            return F.coalesce(carried, F.lit(0)) + F.coalesce(F.sum(value).over(span), F.lit(0))
        if how == "max":
            return F.greatest(carried, F.max(value).over(span))
        if how == "last":
            return F.coalesce(F.last(value, ignorenulls=True).over(span), carried)
        if how == "next":
            return F.coalesce(F.first(value, ignorenulls=True).over(after if exclusive else onward), carried)
        return F.when(F.row_number().over(local) == 1, carried).otherwise(F.lag(value).over(local))

    # Clustered once: the chunk totals and the rows they come back to read the same exchange.
    chunked = df.withColumn("_chunk", chunk).repartition(*keys, "_chunk")
    totals = chunked.groupBy(*keys, "_chunk").agg(*[total[r.how](r.value).alias(f"_t_{n}") for n, r in wanted.items()])
    carried = totals.select(*keys, "_chunk", *[carry[r.how](F.col(f"_t_{n}")).alias(f"_c_{n}")
                                               for n, r in wanted.items()])
    joined = chunked.join(carried, [*keys, "_chunk"])
    out = joined.withColumns({n: combine(r.how, r.value, F.col(f"_c_{n}"), r.before) for n, r in wanted.items()})
    return out.drop("_chunk", *[f"_c_{n}" for n in wanted])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str = "n") -> DataFrame:
    """Row numbers from 1 within each key."""
    return running(df, keys, order, chunk, **{name: Running("sum", F.lit(1).cast("bigint"))})


def cohorts(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, key: str,
            name: str = "cohort") -> DataFrame:
    """Number the runs of neighbouring rows that share ``key``.

    Inside a chunk a run starts where the key is not that of the row before; whether a chunk's first row starts one is
    settled between the one row per chunk that holds its first and last key.
    """
    position = F.struct(*order)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    before = F.lag(F.struct(key)).over(local)
    chunked = df.withColumn("_chunk", chunk).repartition(*keys, "_chunk").withColumn(
        "_starts", F.when(before.isNotNull() & ~before[key].eqNullSafe(F.col(key)), 1).otherwise(0).cast("bigint"))
    totals = chunked.groupBy(*keys, "_chunk").agg(
        F.sum("_starts").alias("_n"), F.min_by(F.struct(key), position).alias("_first"), F.max_by(F.struct(key), position).alias("_last"))
    fresh = totals.withColumn("_fresh", F.when(F.lag("_last").over(across).eqNullSafe(F.col("_first")), 0).otherwise(1))
    carried = fresh.select(*keys, "_chunk", (F.coalesce(F.sum(F.col("_n") + F.col("_fresh")).over(
        across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_fresh")).alias("_base"))
    return chunked.join(carried, [*keys, "_chunk"]).withColumn(
        name, (F.col("_base") + F.sum("_starts").over(upto)).cast("bigint")).drop("_chunk", "_starts", "_base")
