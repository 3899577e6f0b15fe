"""Section trees: headings folded by depth, end fences, context paths, routing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as X

BLOCK = 64  # headings folded at once


def _in_order(heads: DataFrame, keys: Sequence[str], order: str = "line_no") -> DataFrame:
    """One row per document: its headings, a cell's worth, as one array in order."""
    rest = [c for c in heads.columns if c not in keys]
    ordered = F.struct(F.col(order).alias("_by"), F.struct(*rest).alias("h"))
    return heads.groupBy(*keys).agg(F.sort_array(F.collect_list(ordered)).alias("_heads"))


def _folded(items: Column, stack: str, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step`` gives for each item, as one array; ``step`` takes the stack and an item and gives a new stack too.

    An accumulator is copied at every step, so none holds the results of a whole document. One fold finds the stack
    that each block of items starts with; the blocks are then folded apart, each with only its own results in hand.
    """
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / BLOCK).cast("int")),
                         lambda k: F.slice(items, k * BLOCK + 1, BLOCK))
    empty = F.array().cast(f"array<{stack}>")

    def past(acc, xs):
        behind = F.aggregate(xs, acc["stack"], lambda now, x: step(now, x["h"])[0])
        return F.struct(behind.alias("stack"), F.concat(acc["starts"], F.array(acc["stack"])).alias("starts"))
    begin = F.struct(empty.alias("stack"), F.array().cast(f"array<array<{stack}>>").alias("starts"))
    starts = F.aggregate(blocks, begin, past)["starts"]

    def one(acc, x):
        now, made = step(acc["stack"], x["h"])
        return F.struct(now.alias("stack"), F.concat(acc["out"], F.array(made)).alias("out"))

    def block(xs, first):
        return F.aggregate(xs, F.struct(first.alias("stack"), F.array().cast(f"array<{out}>").alias("out")), one)["out"]
    return F.flatten(F.zip_with(blocks, starts, block))


def _unfolded(folded: DataFrame, heads: DataFrame, keys: Sequence[str], added: Sequence[str]) -> DataFrame:
    rest = [c for c in heads.columns if c not in keys]
    return folded.select(*keys, F.explode("_out").alias("_o")).select(
        *keys, *[F.col(f"_o.h.{c}").alias(c) for c in rest], *[F.col(f"_o.{c}").alias(c) for c in added])


def fold_headings(heads: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Parent, ancestors and their names of every heading; a heading closes each open one at its depth or deeper.

    One fold over a document's headings with the stack of open ones, of any depth. The parent is the innermost
    heading still open; ``ancestors`` are the lines of all open ones, outermost first, and ``names`` their stable names.
    """
    heads = heads.withColumn("depth", F.col("depth").cast("bigint"))
    heads = heads if "stable" in heads.columns else heads.withColumn("stable", F.lit(""))
    kinds = heads.schema
    opened = f"struct<depth:bigint,line_no:{kinds['line_no'].dataType.simpleString()},stable:string>"
    grouped = _in_order(heads, keys)
    row = grouped.schema["_heads"].dataType.elementType["h"].dataType.simpleString()

    def step(stack, h):
        still = F.filter(stack, lambda s: s["depth"] < h["depth"])
        own = F.struct(h["depth"].alias("depth"), h["line_no"].alias("line_no"), h["stable"].alias("stable"))
        return F.concat(still, F.array(own)), F.struct(h.alias("h"), still.alias("open"))
    folded = grouped.select(*keys, _folded(
        F.col("_heads"), opened, f"struct<h:{row},open:array<{opened}>>", step).alias("_out"))
    tree = _unfolded(folded, heads, keys, ["open"])
    return tree.withColumns({
        "parent": F.get(F.col("open")["line_no"], F.size("open") - 1), "ancestors": F.col("open")["line_no"],
        "names": F.filter(F.col("open")["stable"], lambda s: s != "")}).drop("open")


def next_at_or_above(heads: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For each heading, the line of the next one of the same or a smaller depth, by one fold from the end."""
    heads = heads.withColumn("depth", F.col("depth").cast("bigint"))
    line = heads.schema["line_no"].dataType.simpleString()
    grouped = _in_order(heads, keys)
    row = grouped.schema["_heads"].dataType.elementType["h"].dataType.simpleString()

    def step(stack, h):
        met = F.filter(stack, lambda s: s["depth"] <= h["depth"])
        left = F.filter(stack, lambda s: s["depth"] < h["depth"])
        own = F.struct(h["depth"].alias("depth"), h["line_no"].alias("line_no"))
        return F.concat(left, F.array(own)), F.struct(h.alias("h"), F.element_at(
            F.concat(F.array(F.lit(None).cast(line)), met["line_no"]), -1).alias("next_line"))
    folded = grouped.select(*keys, _folded(
        F.reverse("_heads"), f"struct<depth:bigint,line_no:{line}>", f"struct<h:{row},next_line:{line}>", step).alias("_out"))
    return _unfolded(folded, heads, keys, ["next_line"])


def context_paths(tree: DataFrame) -> DataFrame:
    """The stable names from the outermost section to each heading, joined with slashes; nameless levels are left out."""
    own = F.when(F.col("stable") != "", F.array("stable")).otherwise(F.array().cast("array<string>"))
    return tree.withColumn("context", F.array_join(F.concat("names", own), "/"))


def section_of_lines(lines: DataFrame, heads: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The heading each line stands under; NULL ahead of the first."""
    marked = lines.join(heads.select(*keys, "line_no", F.col("stable").alias("_s"), F.lit(True).alias("_h")),
                        [*keys, "line_no"], "left")
    window = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (marked.withColumn("section_line", F.last(F.when(F.col("_h"), F.col("line_no")), ignorenulls=True)
                              .over(window))
            .withColumn("section", F.last(F.when(F.col("_h"), F.col("_s")), ignorenulls=True).over(window))
            .drop("_s", "_h"))


def fold_fenced(events: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Sections of documents whose end fences close them.

    ``events`` has ``event`` 'open' or 'close', ``depth`` (NULL for a fence), ``stable``. A fence closes the
    innermost open section when the name is the same and is a finding otherwise; what is open then depends on
    every earlier event, so one document folds as one array with the stack of what is open.
    """
    events = events.select(*keys, F.col("line_no").cast("bigint").alias("line_no"), "event",
                           F.col("depth").cast("bigint").alias("depth"), "stable")
    grouped = _in_order(events, keys)
    row = grouped.schema["_heads"].dataType.elementType["h"].dataType.simpleString()
    mismatch = V.FENCE_MISMATCH.replace("%s", "%1$s", 1).replace("%s", "%2$s", 1)

    def step(stack, h):
        opens = h["event"] == "open"
        still = F.when(opens, F.filter(stack, lambda s: s["depth"] < h["depth"])).otherwise(stack)
        top = F.get(still, F.size(still) - 1)
        match = ~opens & top.isNotNull() & top["stable"].eqNullSafe(h["stable"])
        own = F.struct(h["depth"].alias("depth"), h["line_no"].alias("line_no"), h["stable"].alias("stable"))
        now = F.when(opens, F.concat(still, F.array(own))).when(
            match, F.slice(still, F.lit(1), F.greatest(F.size(still) - 1, F.lit(0)))).otherwise(still)
        warning = F.when(opens | match, None).when(top.isNull(), F.format_string(V.FENCE_NONE, h["stable"])).otherwise(
            F.format_string(mismatch, h["stable"], top["stable"]))
        made = F.struct(h.alias("h"), F.when(opens, top["line_no"]).alias("parent"),
                        F.when(match, top["line_no"]).alias("closes"), warning.alias("warning"))
        return now, made
    folded = grouped.select(*keys, _folded(
        F.col("_heads"), "struct<depth:bigint,line_no:bigint,stable:string>",
        f"struct<h:{row},parent:bigint,closes:bigint,warning:string>", step).alias("_out"))
    return _unfolded(folded, events, keys, ["parent", "closes", "warning"]).drop("depth")


def section_names(heads: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    return heads.filter("stable <> ''").select(*keys, "stable").distinct()


def route_first(rows: DataFrame, sections: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rows placed in the first section of their target name to close; rows whose target is no section leave."""
    first = sections.groupBy(*keys, F.col("stable").alias("target")).agg(
        F.min_by("line_no", F.struct("close_line", "line_no")).alias("section_line"))
    return rows.join(first, [*keys, "target"])


def under_roots(df: DataFrame, roots: DataFrame, name: str = "name", root: str = "root") -> DataFrame:
    """Rows whose dotted name is one of the roots or stands under one.

    Every dotted prefix of the name is looked up, so the roots are an equi-join side of any size.
    """
    parts = F.split(F.col(name), "\\.", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(
        F.slice(parts, F.lit(1), i), "."))
    keyed = df.select(name).distinct().select(name, F.explode(prefixes).alias("_prefix"))
    wanted = roots.select(F.col(root).alias("_prefix")).distinct()
    under = keyed.join(wanted, "_prefix", "left_semi").select(name).distinct()
    return df.join(under, name, "left_semi")
