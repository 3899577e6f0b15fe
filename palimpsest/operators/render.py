"""Rows to text: pieces, tables, items, headings and whole documents, in one of three formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V


def _ordered(order, value, separator=""):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))),
                                    lambda s: s["_v"]), separator)


def _between(table: dict, kind: Column, text: Column) -> Column:
    """``text`` between what the table puts before and after its kind; a kind it lacks has nothing around it."""
    opens = F.create_map(*[F.lit(x) for k, (o, _) in table.items() for x in (k, o)])
    closes = F.create_map(*[F.lit(x) for k, (_, c) in table.items() for x in (k, c)])
    none = F.lit("")
    return F.concat(F.coalesce(F.try_element_at(opens, kind), none), text, F.coalesce(F.try_element_at(closes, kind), none))


def inline_text(kind: Column, text: Column, form: str) -> Column:
    escape = V.TEXT_ESCAPES[form]
    plain = F.when(kind == "text", F.regexp_replace(text, *escape)).otherwise(text) if escape else text
    return _between(V.INLINE_FORMS[form], kind, plain)


def render_pieces(pieces: DataFrame, keys: Sequence[str], form: str) -> DataFrame:
    """Inline pieces of each paragraph as text. ``pieces``: keys, ord, kind, text."""
    said = pieces.withColumn("_t", inline_text(F.col("kind"), F.col("text"), form))
    return said.groupBy(*keys).agg(_ordered(["ord"], "_t").alias("text"))


def flatten_pieces(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The words of each paragraph without any mark-up."""
    return pieces.groupBy(*keys).agg(_ordered(["ord"], "text").alias("text"))


def wrap_runs(text: Column, change: Column, form: str) -> Column:
    """A changed run between its marks, line by line; an empty line stays empty."""
    marked = F.transform(F.split(text, "\n", -1), lambda line: F.when(line == "", line).otherwise(
        _between(V.RUN_MARKS[form], change, line)))
    return F.array_join(marked, "\n")


def wrap_block(text: Column, change: Column, form: str) -> Column:
    return _between(V.BLOCK_MARKS[form], change, text)


def render_marked(runs: DataFrame, keys: Sequence[str], form: str) -> DataFrame:
    """Word runs of a diff as one text with marks. ``runs``: keys, run, change, lead, text, trail."""
    said = runs.withColumn("_t", F.concat("lead", F.when(F.col("text") == "", "").otherwise(
        wrap_runs(F.col("text"), F.col("change"), form)), "trail"))
    return said.groupBy(*keys).agg(_ordered(["run"], "_t").alias("text"))


def _cell(column: str) -> Column:
    return F.replace(F.col(column), F.lit("|"), F.lit("\\|"))


def render_tables(tables: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tables with a heading column as pipe tables.

    ``tables``: keys, name, caption, column1, column2; ``rows``: keys, row_ord, header, cell1, cell2.
    """
    line = rows.withColumn("_t", F.concat(
        F.lit("| **"), _cell("header"), F.lit("** | "), _cell("cell1"), F.lit(" | "), _cell("cell2"), F.lit(" |\n")))
    body = line.groupBy(*keys).agg(_ordered(["row_ord"], "_t").alias("_body"))
    head = F.concat(F.lit("| | "), _cell("column1"), F.lit(" | "), _cell("column2"), F.lit(" |\n|---|---|---|\n"))
    foot = F.concat(F.lit(": ["), F.col("caption"), F.lit("]{#"), F.col("name"), F.lit("}\n"))
    return tables.join(body, list(keys), "left").select(
        *keys, F.concat(head, F.coalesce("_body", F.lit("")), foot).alias("text"))


def heading(depth: Column, title: Column, stable: Column, base_level: int = 1) -> Column:
    """A heading line: levels go on from the base and stop at the deepest there is."""
    hashes = F.repeat(F.lit("#"), F.least(depth + (base_level - 1), F.lit(V.HEADING_LIMIT)).cast("int"))
    return F.concat(hashes, F.when(title == "", "").otherwise(F.concat(F.lit(" "), title)), F.lit(" ["), stable, F.lit("]"))


def render_items(signatures: DataFrame, leading: DataFrame, elements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items as text: the signatures in one code block, leading prose, then elements, each kind labelled once.

    ``signatures``: keys, ord, text; ``leading``: keys, ord, text; ``elements``: keys, rank, ord, text.
    """
    code = signatures.groupBy(*keys).agg(F.concat(F.lit("```cpp\n"), _ordered(["ord"], "text", "\n"), F.lit("\n```\n")).alias("text"))
    labels = F.array(*[F.lit(x) for x in V.ELEMENT_LABELS])
    first = F.row_number().over(Window.partitionBy(*keys, "rank").orderBy("ord")) == 1
    named = elements.withColumn("text", F.when(first, F.concat(
        F.lit("*"), F.try_element_at(labels, (F.col("rank") + 1).cast("int")), F.lit("*: "), F.col("text"))).otherwise(F.col("text")))
    rows = (code.select(*keys, F.lit(0).alias("part"), F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("ord"), "text")
            .unionByName(leading.select(*keys, F.lit(1).alias("part"), F.lit(0).alias("rank"), F.col("ord").cast("bigint").alias("ord"), "text"))
            .unionByName(named.select(*keys, F.lit(2).alias("part"), "rank", F.col("ord").cast("bigint").alias("ord"), "text")))
    return rows.groupBy(*keys).agg(_ordered(["part", "rank", "ord"], "text", "\n").alias("text"))


def render_documents(blocks: DataFrame, keys: Sequence[str], form: str) -> DataFrame:
    """Whole documents: blocks in order, neighbours with the same mark inside one wrapper.

    ``blocks``: keys, ord, change, text. A document is one cell again at the end, as it was at the start.
    """
    w = Window.partitionBy(*keys).orderBy("ord")
    starts = F.when(F.lag("change").over(w).eqNullSafe(F.col("change")), 0).otherwise(1)
    grouped = blocks.withColumn("_s", starts).withColumn("_g", F.sum("_s").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    pieces = grouped.groupBy(*keys, "_g", "change").agg(_ordered(["ord"], "text", "\n").alias("_t")).withColumn(
        "_t", wrap_block(F.col("_t"), F.col("change"), form))
    return pieces.groupBy(*keys).agg(_ordered(["_g"], "_t", "\n").alias("text"))


def with_section_numbers(sections: DataFrame, numbers: DataFrame) -> DataFrame:
    """The number an option gives a section name. ``numbers``: stable, number; one row per name."""
    return sections.join(numbers, "stable", "left")


def unmatched_options(options: DataFrame, sections: DataFrame) -> DataFrame:
    """Options whose name is no top-level section of the corpus."""
    return options.join(sections.filter("parent IS NULL").select("stable").distinct(), "stable", "left_anti")
