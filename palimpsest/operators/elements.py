"""Descriptions: elements, paragraphs, blocks, tables, and the checks on how their tags stand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as X


def _running(keys):
    return Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rank_of(kind):
    """The canonical rank of an element kind column."""
    return F.array_position(F.array(*[F.lit(k) for k in V.ELEMENT_KINDS]), kind) - 1


def group_elements(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Tagged lines grouped into elements and blank-separated paragraphs.

    ``lines`` has ``text`` without decoration. An element tag opens an element and its line is the first of it;
    any other line is prose of the open element, or leading prose ahead of the first. An unknown tag is prose.
    """
    tag = X.tag_of("text")
    opens = tag.isin(V.ELEMENT_KINDS)
    marked = lines.withColumn("_opens", F.coalesce(opens, F.lit(False))).withColumn(
        "_kind", F.when(F.col("_opens"), tag)).withColumn(
        "_prose", F.when(F.col("_opens"), X.after_tag("text")).otherwise(F.trim("text")))
    w = _running(keys)
    numbered = (marked.withColumn("elem_ord", F.sum(F.when(F.col("_opens"), 1).otherwise(0)).over(w))
                .withColumn("_breaks", F.sum(F.when((F.col("_prose") == "") & ~F.col("_opens"), 1).otherwise(0)).over(w))
                .withColumn("kind", F.coalesce(F.last("_kind", ignorenulls=True).over(w), F.lit("leading"))))
    paragraphs = numbered.filter("_prose <> ''").groupBy(*keys, "elem_ord", "kind", "_breaks").agg(
        F.min("line_no").alias("line_no"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_prose"))), lambda s: s["_prose"]), " ")
        .alias("text"))
    para = F.row_number().over(Window.partitionBy(*keys, "elem_ord").orderBy("_breaks"))
    return paragraphs.withColumn("para_ord", para).drop("_breaks")


def group_blocks(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Lines that stand between an open and a close tag, numbered by block, their text verbatim.

    Blocks do not nest, so an open tag inside an open block and a close tag outside one are no delimiters here;
    ``delimiter_findings`` reports them.
    """
    state = delimiter_state(lines, keys)
    inside = state.filter((F.col("open_kind").isNotNull()) & ~F.col("closing"))
    return inside.select(*keys, "line_no", F.col("open_kind").alias("block"), F.col("block_ord"),
                         F.when(F.col("opening"), X.after_tag("text")).otherwise(F.col("text")).alias("text"))


def delimiter_state(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For each line: the block kind open on it, and whether it opens or closes it.

    An open tag inside a block changes nothing and a close tag ends the open block whatever it is called, so the
    state before a line is the last delimiter of any kind: opened after an open, closed after a close. The first
    open of a run of opens is the one that counts.
    """
    kinds = {o: o for o, _ in V.BLOCK_PAIRS}
    closes = {c: o for o, c in V.BLOCK_PAIRS}
    tag = X.tag_of("text")
    # A comment leader has been taken off, so a close tag is the tag of its line.
    is_open, is_close = tag.isin(list(kinds)), tag.isin(list(closes))
    marked = lines.withColumn("_tag", tag).withColumn(
        "_event", F.when(is_open, F.lit(1)).when(is_close, F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = _running(keys)
    was_open = F.coalesce(F.last("_event", ignorenulls=True).over(before), F.lit(0)) == 1
    staged = marked.withColumn("was_open", was_open).withColumn(
        "opening", F.coalesce((F.col("_event") == 1) & ~F.col("was_open"), F.lit(False))).withColumn(
        "closing", F.coalesce((F.col("_event") == 0), F.lit(False)))
    return (staged.withColumn("block_ord", F.sum(F.when(F.col("opening"), 1).otherwise(0)).over(upto))
            .withColumn("_last", F.last(F.when(F.col("opening"), F.col("_tag")), ignorenulls=True).over(upto))
            .withColumn("open_kind", F.when(F.col("was_open") | F.col("opening"), F.col("_last")))
            .drop("_last"))


def delimiter_findings(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Nested opens, closes outside a block, and blocks still open at the end of their document."""
    state = delimiter_state(lines, keys)
    nested = state.filter((F.col("_event") == 1) & F.col("was_open")).select(
        *keys, "line_no", F.lit("error").alias("severity"), F.lit(V.BLOCKS_NEST).alias("message"))
    outside = state.filter((F.col("_event") == 0) & ~F.col("was_open")).select(
        *keys, "line_no", F.lit("error").alias("severity"), X.template(V.OUTSIDE_BLOCK, F.col("_tag")).alias("message"))
    ended = state.groupBy(*keys).agg(
        F.max_by("_event", F.when(F.col("_event").isNotNull(), F.col("line_no"))).alias("_e"),
        F.max_by("_tag", F.when(F.col("opening"), F.col("line_no"))).alias("_t"),
        F.max(F.when(F.col("opening"), F.col("line_no"))).alias("line_no"))
    unclosed = ended.filter("_e = 1").select(
        *keys, "line_no", F.lit("error").alias("severity"), X.template(V.MISSING_END, F.col("_t")).alias("message"))
    return nested.unionByName(outside).unionByName(unclosed)


def table_cells(rows: DataFrame, keys: Sequence[str], separator: str = "&", text: str = "text") -> DataFrame:
    """One row per cell, with how many cells its row has."""
    cells = X.cells_of(text, separator)
    return rows.withColumn("_c", cells).select(
        *keys, F.size("_c").alias("n_cells"), F.posexplode("_c").alias("_p", "cell")).select(
        *keys, (F.col("_p") + 1).alias("cell_no"), "cell", "n_cells")


def arity_findings(rows: DataFrame, keys: Sequence[str], separator: str = "&", text: str = "text") -> DataFrame:
    """Rows whose cell count is not that of the first row of their table."""
    first = F.first("n_cells").over(_running(keys))
    counted = rows.select(*keys, "line_no", F.size(X.cells_of(text, separator)).alias("n_cells"))
    return counted.withColumn("expected", first).filter("n_cells <> expected")


def canonical_order(elements: DataFrame, keys: Sequence[str], authored: str = "elem_ord") -> DataFrame:
    """Elements in canonical order: by rank of kind, derived ones first, then as authored."""
    order = Window.partitionBy(*keys).orderBy("rank", ~F.col("derived"), authored)
    return elements.withColumn("rank", rank_of(F.col("kind"))).withColumn(
        "canonical_ord", F.row_number().over(order))


def order_findings(tags: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Element tags that repeat a kind of their description, or rank below one that came before."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(Window.partitionBy(*keys, "tag").orderBy("line_no"))
    ranked = (tags.filter(F.col("tag").isin(V.ELEMENT_KINDS)).withColumn("rank", rank_of(F.col("tag")))
              .withColumn("_top", F.max("rank").over(before)).withColumn("_last", F.lag("tag").over(w))
              .withColumn("_nth", nth))
    kinds = F.array(*[F.lit(k) for k in V.ELEMENT_KINDS])
    repeat = ranked.filter("_nth > 1").select(
        *keys, "line_no", F.lit("warning").alias("severity"),
        X.template(V.DUPLICATE_ELEMENT, F.col("tag")).alias("message"))
    late = ranked.filter("rank < _top").select(
        *keys, "line_no", F.lit("note").alias("severity"),
        X.template(V.OUT_OF_ORDER, F.col("tag"), F.try_element_at(kinds, (F.col("_top") + 1).cast("int"))).alias("message"))
    return repeat.unionByName(late)


def exclusive_findings(tags: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]] = V.EXCLUSIVE_TAGS,
                       taken: Sequence[tuple[str, list[str], str]] = V.TAKEN_TAGS) -> DataFrame:
    """Descriptions whose tags exclude one another, and ``\\also`` beside a description.

    One aggregate holds the few tags of each description that any rule names.
    """
    watched = {t for pair in pairs for t in pair} | {t for tag, others, _ in taken for t in (tag, *others)}
    watched |= {"also", *V.ELEMENT_KINDS}
    held = tags.filter(F.col("tag").isin(sorted(watched))).groupBy(*keys).agg(F.collect_set("tag").alias("_tags"))
    has = lambda tag: F.array_contains("_tags", tag)
    any_of = lambda names: F.arrays_overlap("_tags", F.array(*map(F.lit, names)))

    def finding(when, severity, message):
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message")))
    found = [finding(has(a) & has(b), "error", V.EXCLUSIVE % (a, b)) for a, b in pairs]
    found += [finding(has(tag) & any_of(others), "error", message) for tag, others, message in taken]
    found.append(finding(has("also") & any_of(V.ELEMENT_KINDS), "warning", V.ALSO_DESCRIBED))
    return held.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("_f")).select(*keys, "_f.*")


def merge_same_kind(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elements of one kind merged: their blocks one after the other, adjacent lists one list.

    ``blocks`` has kind, elem_ord, block_ord, type. ``merged_ord`` numbers the blocks that result.
    """
    order = Window.partitionBy(*keys, "kind").orderBy("elem_ord", "block_ord")
    joins = (F.col("type") == "list") & (F.lag("type").over(order) == "list")
    return blocks.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn(
        "merged_ord", F.sum("_new").over(order)).drop("_new")


def table_findings(tables: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tables with an empty name, caption or column, with no row, or with an empty cell.

    ``tables``: keys, name, caption, column1, column2. ``rows``: keys, row_ord, header, cell1, cell2.
    """
    def empty(col):
        return F.trim(F.coalesce(col, F.lit(""))) == ""

    parts = [("name", "table stable name is empty"), ("caption", "table caption is empty"),
             ("column1", "table first column header is empty"), ("column2", "table second column header is empty")]
    heads = tables.select(*keys, F.explode(F.array_compact(F.array(*[
        F.when(empty(F.col(c)), F.lit(m)) for c, m in parts]))).alias("message"))
    bare = tables.join(rows.select(*keys).distinct(), list(keys), "left_anti").select(
        *keys, F.lit("table requires at least one row").alias("message"))
    cells = [("header", "table row %s header is empty"), ("cell1", "table row %s first cell is empty"),
             ("cell2", "table row %s second cell is empty")]
    holes = rows.select(*keys, F.explode(F.array_compact(F.array(*[
        F.when(empty(F.col(c)), X.template(m, F.col("row_ord"))) for c, m in cells]))).alias("message"))
    return heads.unionByName(bare).unionByName(holes).withColumn("severity", F.lit("error"))
