"""Blocks inside descriptions: lists in lists, code in items, tables written as tags.

``lines`` has the keys, ``line_no`` and ``text``, a comment line without its leader but with its indentation. What is open on
a line is state: code and tables are the last delimiter before it, lists are a stack of items by indentation, which is
the fold of headings over items and code blocks. Every operator stays within a document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as X
from palimpsest.operators import sections as S

TABLES = {"lib2dtab2": ("endlib2dtab2", 2), "libtab2": ("endlibtab2", 1)}  # the end tag and the cells of a row


def _upto(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)


def _indent(text: Column | str) -> Column:
    return F.length(F.regexp_extract(text, "^( *)", 1))


def open_regions(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``tag`` (NULL inside code), ``code_line`` (where the code around a line opened), ``table_line`` and ``table``.

    Code is verbatim until its end tag. A table is open from its tag to its own end tag, an element tag or the end of a note
    or an example. Neither opens inside the other or itself, so what a tag does hangs on every tag before it: the tags of
    a document are folded with what is open.
    """
    keys = list(keys)
    tag = X.tag_of("text")
    closers = V.ELEMENT_KINDS + ["endnote", "endexample"]
    ends = {name: end for name, (end, _) in TABLES.items()}
    tagged = lines.withColumn("tag", tag)
    events = tagged.filter(F.col("tag").isin(["codeblock", "endcodeblock", *ends, *ends.values(), *closers])).select(*keys, "line_no", "tag")
    line = events.schema["line_no"].dataType.simpleString()
    own_end = F.lit(False)

    def step(stack, h):
        top = F.get(stack, F.lit(0))
        opens = top.isNull() & h["tag"].isin("codeblock", *ends)
        shut = (top["tag"] == "codeblock") & (h["tag"] == "endcodeblock")
        for name, end in ends.items():
            shut = shut | ((top["tag"] == name) & ((h["tag"] == end) | h["tag"].isin(closers)))
        shut = F.coalesce(shut, F.lit(False))
        here = F.struct(h["tag"].alias("tag"), h["line_no"].alias("line_no"))
        now = F.when(opens, F.array(here)).when(shut, F.filter(stack, lambda s: F.lit(False))).otherwise(stack)
        after = F.get(now, F.lit(0))
        return now, F.struct(h.alias("h"), opens.alias("_opens"), shut.alias("_shut"), after.alias("_after"))
    grouped = S._in_order(events, keys)
    row = grouped.schema["_heads"].dataType.elementType["h"].dataType.simpleString()
    kept = f"struct<tag:string,line_no:{line}>"
    folded = grouped.select(*keys, S._folded(F.col("_heads"), kept, f"struct<h:{row},_opens:boolean,_shut:boolean,_after:{kept}>", step).alias("_out"))
    state = S._unfolded(folded, events, keys, ["_opens", "_shut", "_after"]).drop("tag")
    joined = tagged.join(state.withColumn("_e", F.lit(True)), [*keys, "line_no"], "left")
    was = F.last(F.when(F.col("_e"), F.struct(F.col("_after").alias("s"))), ignorenulls=True).over(_before(keys))["s"]
    marked = joined.withColumn("_was", was)
    kind, opens, shut = F.col("_was.tag"), F.coalesce("_opens", F.lit(False)), F.coalesce("_shut", F.lit(False))
    for name, end in ends.items():
        own_end = own_end | ((kind == name) & (F.col("tag") == end))
    in_table = kind.isin(list(ends)) & (~shut | F.coalesce(own_end, F.lit(False)))
    opens_table = opens & F.col("tag").isin(list(ends))
    return marked.withColumns({
        "code_line": F.when(kind == "codeblock", F.col("_was.line_no")).when(opens & (F.col("tag") == "codeblock"), F.col("line_no")),
        "table_line": F.when(in_table, F.col("_was.line_no")).when(opens_table, F.col("line_no")),
        "table": F.when(in_table, kind).when(opens_table, F.col("tag")),
        "tag": F.when(~F.coalesce((kind == "codeblock") & ~shut, F.lit(False)), F.col("tag"))}).drop("_opens", "_shut", "_after", "_e", "_was")


def _placed(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items and code blocks with ``run`` (broken by what ends every list), ``owner`` (the item around) and ``level``."""
    regions = open_regions(lines, keys).filter("table_line IS NULL")
    in_code = F.col("code_line").isNotNull() & (F.col("code_line") != F.col("line_no"))
    blank = ~in_code & (F.trim("text") == "")
    outside = regions.filter(~in_code | (F.col("tag") == "endcodeblock")).withColumn("_blank", blank)
    twice = F.col("_blank") & F.coalesce(F.lag("_blank").over(Window.partitionBy(*keys).orderBy("line_no")), F.lit(False))
    breaks = twice | F.coalesce(F.col("tag").isin(V.ELEMENT_KINDS + ["note", "example", "endnote", "endexample"]), F.lit(False))
    run = F.sum(breaks.cast("int")).over(_upto(keys))
    events = outside.withColumn("run", run).filter("tag IN ('item', 'codeblock')").select(
        *keys, "run", "line_no", (_indent("text") + 1).alias("depth"), "tag",
        F.when(F.col("tag") == "item", F.col("line_no").cast("string")).otherwise("").alias("stable"))
    tree = S.fold_headings(events, [*keys, "run"])
    return tree.select(*keys, "run", "line_no", "tag", F.element_at(F.concat(F.array(F.lit(None).cast("string")), "names"), -1).cast(
        "bigint").alias("owner"), (F.size("names") + 1).cast("bigint").alias("level"))


def list_items(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, line_no, list_ord, owner, level, text) of every item.

    An item indented past the one before it opens a list inside it. A code block closes the items it is not indented past
    and, where it is in none, the list. An item's text runs to the next blank line or tag.
    """
    placed = _placed(lines, keys)
    ends = (F.col("tag") == "codeblock") & F.col("owner").isNull()
    parts = F.sum(ends.cast("int")).over(Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    items = placed.withColumn("_part", parts).filter("tag = 'item'")
    top = items.withColumn("list_ord", F.dense_rank().over(Window.partitionBy(*keys).orderBy("run", "_part")).cast("bigint"))
    apart = F.col("code_line").isNotNull() | F.col("table_line").isNotNull()
    stops = F.col("tag").isNotNull() | apart | (F.trim("text") == "")
    said = open_regions(lines, keys).withColumn("_run", F.sum(stops.cast("int")).over(_upto(keys))).filter(~apart)
    item = F.first(F.when(F.col("tag") == "item", F.col("line_no")), ignorenulls=True).over(Window.partitionBy(*keys, "_run"))
    spoken = F.when(F.col("tag").isNotNull(), X.after_tag("text")).otherwise(F.trim("text"))
    texts = said.withColumn("_item", item).filter("_item IS NOT NULL").withColumn("_t", spoken).groupBy(
        *keys, F.col("_item").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(F.col("_t") != "", F.struct("line_no", "_t")))), lambda s: s["_t"]), " ").alias("text"))
    return top.join(texts, [*keys, "line_no"]).select(*keys, "line_no", "list_ord", "owner", "level", "text")


def code_blocks(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, line_no, owner, closed, text) of every code block: the item it is in, and its lines less its own indentation."""
    regions = open_regions(lines, keys).filter("code_line IS NOT NULL AND table_line IS NULL")
    own = F.max(F.when(F.col("line_no") == F.col("code_line"), _indent("text"))).over(Window.partitionBy(*keys, "code_line"))
    inside = (F.col("line_no") != F.col("code_line")) & F.col("tag").isNull()
    cut = regions.withColumn("_own", own).withColumn("_t", F.expr(
        "substring(text, least(_own, length(regexp_extract(text, '^( *)', 1))) + 1)"))
    whole = cut.groupBy(*keys, "code_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("line_no", "_t")))), lambda s: s["_t"]), "\n").alias("text"),
        F.max(F.coalesce(F.col("tag") == "endcodeblock", F.lit(False))).alias("closed"))
    owners = _placed(lines, keys).filter("tag = 'codeblock'").select(*keys, F.col("line_no").alias("code_line"), "owner")
    return whole.join(owners, [*keys, "code_line"]).select(*keys, F.col("code_line").alias("line_no"), "owner", "closed", "text")


def tag_tables(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Tables written as tags: their parts, and what is wrong with them.

    Parts: (keys, table_line, part, row_no, part_no, text), ``part`` being caption, column, row or cell; the lines after
    a part's tag belong to it. Findings: (keys, line_no, severity, message).
    """
    inside = open_regions(lines, keys).filter("table_line IS NOT NULL")
    table = [*keys, "table_line"]
    is_part = F.col("tag").isin("column", "row", "cell") | (F.col("line_no") == F.col("table_line"))
    marked = inside.withColumn("_part", F.coalesce(is_part, F.lit(False))).withColumn(
        "_kind", F.when(F.col("line_no") == F.col("table_line"), "caption").when(F.col("_part"), F.col("tag")))

    def count(kind, over):
        return F.sum((F.coalesce(F.col("_kind") == kind, F.lit(False))).cast("bigint")).over(over)
    upto = _upto(table)
    numbered = marked.withColumns({"_nth": F.sum(F.col("_part").cast("bigint")).over(upto), "column_no": count("column", upto),
                                   "row_no": count("row", upto)})
    numbered = numbered.withColumn("cell_no", count("cell", _upto([*table, "row_no"])))
    ends = [end for end, _ in TABLES.values()]
    spoken = numbered.filter(~F.coalesce(F.col("tag").isin(ends), F.lit(False)) & (F.col("_part") | F.col("tag").isNull())).withColumn(
        "_t", F.when(F.col("_part"), X.after_tag("text")).otherwise(F.trim("text")))
    part_no = F.when(F.col("part") == "column", F.col("column_no")).when(F.col("part") == "cell", F.col("cell_no")).otherwise(F.lit(0))
    parts = spoken.groupBy(*table, "_nth").agg(
        F.max("_kind").alias("part"), F.max("row_no").alias("row_no"), F.max("column_no").alias("column_no"), F.max("cell_no").alias("cell_no"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_t") != "", F.struct("line_no", "_t")))), lambda s: s["_t"]), " ").alias("text"))
    parts = parts.select(*table, "part", "row_no", part_no.alias("part_no"), "text")

    arity = F.lit(None).cast("int")
    for name, (_, cells) in TABLES.items():
        arity = F.when(F.col("table") == name, cells).otherwise(arity)
    a = numbered.withColumn("arity", arity)
    want = lambda n: F.concat(F.when(n == 1, "one").otherwise("two"), F.lit(" \\cell "), F.when(n == 1, "entry").otherwise("entries"))
    open_tag = F.concat(F.lit("\\"), F.col("table"))
    by_row = a.groupBy(*table, "row_no").agg(F.max("cell_no").alias("n"), F.max("arity").alias("arity"))
    after_row = by_row.select(*table, (F.col("row_no") + 1).alias("row_no"), F.col("n").alias("_n"))
    met = a.join(after_row, [*table, "row_no"], "left")
    found = F.array_compact(F.array(
        F.when((F.col("_kind") == "column") & (F.col("row_no") > 0), F.lit(V.COLUMN_LATE)),
        F.when((F.col("_kind") == "column") & (F.col("column_no") > 2), X.template(V.COLUMNS_EXTRA, F.col("table"))),
        F.when((F.col("_kind") == "row") & (F.col("column_no") != 2), F.lit(V.ROW_EARLY)),
        F.when((F.col("_kind") == "row") & (F.col("row_no") > 1) & (F.col("_n") != F.col("arity")), X.template(
            V.ROW_ARITY, want(F.col("arity")), F.col("_n").cast("string"))),
        F.when((F.col("_kind") == "cell") & (F.col("row_no") == 0), F.lit(V.CELL_EARLY)),
        F.when((F.col("_kind") == "cell") & (F.col("row_no") > 0) & (F.col("cell_no") > F.col("arity")), X.template(
            V.CELL_EXTRA, want(F.col("arity")))),
        F.when(F.col("tag").isin(list(TABLES)) & (F.col("line_no") != F.col("table_line")), X.template(V.TABLE_NESTED, F.col("tag"))),
        F.when(F.col("tag").isNotNull() & ~F.col("_part") & ~F.col("tag").isin([*ends, *TABLES]), X.template(
            V.TAG_IN_TABLE, F.col("tag"), F.col("table")))))
    lined = met.select(*keys, "line_no", F.explode(found).alias("message"))
    whole = a.groupBy(*table, "table").agg(
        F.max("line_no").alias("line_no"), F.max("column_no").alias("columns"), F.max("row_no").alias("rows"), F.max("arity").alias("arity"),
        F.max_by("cell_no", "line_no").alias("cells"), F.max(F.coalesce(F.col("tag").isin(ends), F.lit(False))).alias("ended"))
    at_end = F.array_compact(F.array(
        F.when(~F.col("ended"), X.template(V.MISSING_END, F.col("table"))),
        F.when(F.col("columns") != 2, X.template(V.TABLE_COLUMNS, open_tag, F.col("columns").cast("string"))),
        F.when(F.col("rows") == 0, X.template(V.TABLE_ROWS, open_tag)),
        F.when((F.col("rows") > 0) & (F.col("cells") != F.col("arity")), X.template(
            V.LAST_ROW_ARITY, want(F.col("arity")), F.col("cells").cast("string")))))
    closing = whole.select(*keys, "line_no", F.explode(at_end).alias("message"))
    return parts, lined.unionByName(closing).select(*keys, "line_no", F.lit("error").alias("severity"), "message")
