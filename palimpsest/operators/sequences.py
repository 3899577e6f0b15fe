"""Ordered siblings inside a document: grouping, placement, look-ahead, elision, numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as X


def group_followers(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Join followers to their primary, and the findings on the way.

    ``rows``: keys, ord, is_item, group_id, also_target, wants_join. A row that names a target joins the first
    earlier row that carries the name; a bare follower joins the primary it stands next to. A row with both a
    group and a target joins nothing. ``primary`` is the row's own ord when it stays.
    """
    both = F.col("group_id").isNotNull() & F.col("also_target").isNotNull()
    named_row = F.col("group_id").isNotNull() & ~both & F.col("is_item") & ~F.col("wants_join")
    nth = F.row_number().over(Window.partitionBy(*keys, "group_id").orderBy("ord"))
    registered = rows.filter(named_row).withColumn("_nth", nth)
    primaries = registered.filter("_nth = 1").select(*keys, F.col("group_id").alias("also_target"),
                                                     F.col("ord").alias("_named"))
    resolved = rows.join(primaries, [*keys, "also_target"], "left").withColumn(
        "_target", F.when(F.col("is_item") & ~both & (F.col("_named") < F.col("ord")), F.col("_named")))
    bare = F.col("wants_join") & F.col("is_item") & F.col("also_target").isNull()
    order = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    event = F.when(~bare, F.coalesce(F.col("_target"), F.when(F.col("is_item"), F.col("ord")).otherwise(F.lit(-1))))
    staged = (resolved.withColumn("_event", event)
              .withColumn("_state", F.coalesce(F.last("_event", ignorenulls=True).over(order), F.lit(-1)))
              .withColumn("_segment", F.count("_event").over(order)).withColumn("_bare", bare))
    first_bare = F.min(F.when(F.col("_bare"), F.col("ord"))).over(Window.partitionBy(*keys, "_segment"))
    primary = (F.when(F.col("_bare") & (F.col("_state") != -1), F.col("_state"))
               .when(F.col("_bare"), first_bare).otherwise(F.coalesce("_target", "ord")))
    grouped = staged.withColumn("primary", primary).select(*rows.columns, "primary")
    unresolved = staged.filter(F.col("also_target").isNotNull() & F.col("group_id").isNull()
                               & F.col("_target").isNull()).select(
        *keys, "ord", F.lit("error").alias("severity"), X.template(V.ALSO_UNRESOLVED, F.col("also_target")).alias("message"))
    repeated = registered.filter("_nth > 1").select(
        *keys, "ord", F.lit("error").alias("severity"), X.template(V.GROUP_DUPLICATE, F.col("group_id")).alias("message"))
    return grouped, unresolved.unionByName(repeated)


def merge_entries(rows: DataFrame, keys: Sequence[str], entry: str = "entry", order: str = "ord") -> DataFrame:
    """Index entries of a group in order, exact repeats dropped at their first place."""
    seen = rows.groupBy(*keys, entry).agg(F.min(order).alias("_at"))
    return seen.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", entry))),
                                               lambda s: s[entry]).alias("entries"))


def place_prose(rows: DataFrame, keys: Sequence[str], key: str = "key", order: str = "ord") -> DataFrame:
    """Give prose the key of the next row that is not prose; prose ahead of every other row goes first.

    Prose behind the last such row keeps its own key. ``placed`` numbers the rows by key, ties by arrival.
    """
    after = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    solid = F.when(~F.col("prose"), F.col(key))
    leads = F.count(solid).over(upto) == 0
    placed = rows.withColumn("placement", F.when(leads, F.lit(0)).otherwise(
        F.coalesce(F.first(solid, ignorenulls=True).over(after), F.col(key))).cast("bigint"))
    return placed.withColumn("placed", F.row_number().over(
        Window.partitionBy(*keys).orderBy("placement", order)))


def look_ahead(pieces: DataFrame, keys: Sequence[str], subject: Column, literal: Column, order: str = "ord",
               reach: int = V.LOOKAHEAD) -> DataFrame:
    """Rows that are a subject, with the first literal among the ``reach`` pieces that follow."""
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, reach)
    return pieces.withColumn("reading", F.first(literal, ignorenulls=True).over(ahead)).filter(subject)


def elide_unchanged(rows: DataFrame, keys: Sequence[str], parent: str = "parent", order: str = "ord",
                    render: str = "ord") -> DataFrame:
    """Collapse each run of unchanged siblings to one elided row; unchanged headings stay.

    ``rows``: keys, parent, ord, render, is_heading, changed. Runs are cut among the children of one parent; an
    elision that would stand right behind another in render order is dropped.
    """
    siblings = Window.partitionBy(*keys, parent).orderBy(order)
    foldable = ~F.col("is_heading") & ~F.col("changed")
    starts = F.when(F.lag(foldable).over(siblings).eqNullSafe(foldable) & foldable, 0).otherwise(1)
    first = rows.withColumn("_fold", foldable).withColumn("_starts", starts).filter("NOT _fold OR _starts = 1")
    shown = first.withColumn("action", F.when(F.col("_fold"), "elided").when(F.col("changed"), "changed")
                             .otherwise("heading"))
    in_text = Window.partitionBy(*keys).orderBy(render)
    return (shown.withColumn("_meets", F.coalesce((F.lag("action").over(in_text) == "elided")
                                                  & (F.col("action") == "elided"), F.lit(False)))
            .filter("NOT _meets").drop("_fold", "_starts", "_meets"))


def number_added(rows: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """Paragraph numbers of added paragraphs: x, x+1, ... in one run; kept paragraphs keep ``#``.

    ``rows``: keys, ord, is_item, added. An added item goes under its last paragraph: beneath that paragraph's
    literal when it was added, beneath its kept number otherwise.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ~F.col("is_item") & F.col("added")
    nth = F.sum(F.when(counted, 1).otherwise(0)).over(upto)
    literal = F.when(F.col("_n") <= 1, F.lit("x")).otherwise(F.concat(F.lit("x+"), (F.col("_n") - 1).cast("string")))
    under_added = F.coalesce(F.last(F.when(~F.col("is_item"), F.col("added")), ignorenulls=True).over(upto), F.lit(False))
    number = (F.when(counted, literal).when(~F.col("is_item"), "#")
              .when(~F.col("added"), "#.#")
              .when(F.col("_under"), F.concat(literal, F.lit(".#"))).otherwise("#.x"))
    return rows.withColumn("_n", nth).withColumn("_under", under_added).withColumn("number", number).drop("_n", "_under")


def number_paragraphs(rows: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """Running paragraph number of the blocks of an item; the first block opens one whatever it says."""
    w = Window.partitionBy(*keys).orderBy(order)
    opens = F.when((F.row_number().over(w) == 1) | F.col("opens"), 1).otherwise(0)
    return rows.withColumn("_o", opens).withColumn("paragraph", F.sum("_o").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_o")
