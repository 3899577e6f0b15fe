"""Line tables: split, classify, recognize. One row in, rows of the same document out; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as X


def split_lines(df: DataFrame, keys: Sequence[str] = ("doc_id",), keep: Sequence[str] = (),
                text: str = "text") -> DataFrame:
    """One row per line, numbered from 1. A document is one cell, so its lines are bounded by what one task held."""
    return df.select(*keys, *keep, F.posexplode(X.lines_of(text)).alias("_p", "_line")).select(
        *keys, *keep, (F.col("_p") + 1).cast("bigint").alias("line_no"), F.col("_line").alias("text"))


def line_offsets(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Character offset of each line in its document: every earlier line and its newline come before it."""
    before = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))


def words(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    return df.select(*keys, F.posexplode(X.words_of(text)).alias("_p", "word")).select(
        *keys, (F.col("_p") + 1).cast("bigint").alias("pos"), "word")


def classify(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """The comment vocabulary of each line and its text without decoration."""
    return lines.withColumn("vocab", X.vocabulary_of(raw)).withColumn("text", X.strip_decoration(raw))


def headings(lines: DataFrame, raw: str = "raw", bare: bool = False) -> DataFrame:
    """Heading lines with depth, stable name and title; a tagged line that does not parse is kept as malformed."""
    return (lines.filter(X.heading_tagged(raw, bare)).withColumn("_h", X.heading_of(raw, bare))
            .withColumn("malformed", F.col("_h").isNull())
            .withColumns({"depth": F.col("_h.depth"), "stable": F.col("_h.stable"), "title": F.col("_h.title")})
            .drop("_h", raw))


def wrapped_headings(lines: DataFrame, keys: Sequence[str] = ("doc_id",), raw: str = "raw",
                     bare: bool = False) -> DataFrame:
    """Lines with each heading whose title is left open joined to the lines that close it.

    A title goes on over the comment lines after its own (with ``bare`` over any lines) until its group is balanced;
    another heading, or a line that is no comment, ends the attempt.
    """
    order = Window.partitionBy(*keys).orderBy("line_no")
    tagged = X.heading_tagged(raw, bare)
    goes_on = F.lit(True) if bare else X.vocabulary_of(raw).isNotNull()
    opens = F.regexp_count(raw, F.lit("\\{")) - F.regexp_count(raw, F.lit("\\}"))
    run = F.sum((tagged | ~goes_on).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = lines.withColumns({"_run": run, "_tagged": tagged})
    inside = Window.partitionBy(*keys, "_run").orderBy("line_no")
    before = F.sum(opens).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumns({"_left": F.coalesce(before, F.lit(0)), "_headed": F.first("_tagged").over(inside)})
    # A line belongs to the heading of its run while the group has stayed open on every line before it.
    still = F.min(F.when(~F.col("_tagged"), F.col("_left"))).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = marked.withColumn("_part", F.col("_headed") & ~F.col("_tagged") & (still > 0))
    head = F.min("line_no").over(inside)
    marked = marked.withColumn("_head", F.when(F.col("_part"), head).otherwise(F.col("line_no")))
    return marked.groupBy(*keys, F.col("_head").alias("line_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", raw))), lambda s: s[raw]), "\n")
        .alias(raw))


def all_headings(lines: DataFrame, keys: Sequence[str] = ("doc_id",), raw: str = "raw", bare: bool = False) -> DataFrame:
    """Well-formed headings, those with a title over several lines too: keys, line_no, depth, stable, title.

    Only documents with a heading line that leaves a group open are read for wrapped titles.
    """
    columns = [*keys, "line_no", "depth", "stable", "title"]
    own = headings(lines, raw, bare).filter("NOT malformed").select(*columns)
    open_group = F.regexp_count(raw, F.lit("\\{")) > F.regexp_count(raw, F.lit("\\}"))
    broken = lines.filter(X.heading_tagged(raw, bare) & open_group & X.heading_of(raw, bare).isNull())
    among = lines.join(broken.select(*keys).distinct(), list(keys), "left_semi")
    wrapped = headings(wrapped_headings(among, keys, raw, bare), raw, bare).filter("NOT malformed").select(*columns)
    return own.unionByName(wrapped.join(broken.select(*keys, "line_no"), [*keys, "line_no"], "left_semi"))


def fences(lines: DataFrame, raw: str = "raw") -> DataFrame:
    return lines.withColumn("stable", X.fence_of(raw)).filter("stable IS NOT NULL").drop(raw)


def references(lines: DataFrame, raw: str = "raw") -> DataFrame:
    return lines.withColumn("target", X.ref_of(raw)).filter("target IS NOT NULL").drop(raw)


def tags(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Tag lines of the markup vocabulary: the tag, what follows it, and what the tag is."""
    tag = X.tag_of("text")
    return (classify(lines, raw).filter("vocab = 'markup'").withColumn("tag", tag).filter("tag IS NOT NULL")
            .withColumn("rest", X.after_tag("text"))
            .withColumn("role", F.when(F.col("tag").isin(V.ELEMENT_KINDS), "element")
                        .when(F.col("tag").isin(V.BLOCK_TAGS), "block")
                        .when(F.col("tag").isin(V.MARKER_TAGS), "marker").otherwise("unknown"))
            .drop(raw, "text", "vocab"))


def wording(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """What each markup line says: its text, without the tag it may open with."""
    text = F.when(X.tag_of("text").isNotNull(), X.after_tag("text")).otherwise(F.col("text"))
    return classify(lines, raw).filter("vocab = 'markup'").withColumn("text", text)


def join_prose(lines: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Prose lines without their trailing comments, joined in order.

    A line end is a space, but for a comment written flush against the text before it. Lines that say nothing
    change nothing, so the joiner of a line is decided by the last line before it that says something.
    """
    kept = (lines.withColumn("_t", X.strip_comment(text)).withColumn("_apart", X.space_after(text))
            .filter(F.col("_t") != ""))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "_t", "_apart")))
    joined = kept.groupBy(*keys).agg(parts.alias("_parts"))
    text_of = F.transform("_parts", lambda s: F.concat(s["_t"], F.when(s["_apart"], " ").otherwise("")))
    return joined.select(*keys, F.rtrim(F.array_join(text_of, "")).alias("text"))


def pieces(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Prose pieces in order; an ``open_code`` piece is an unterminated span whose text is kept."""
    return df.select(*keys, F.posexplode(X.pieces_of(text)).alias("_p", "_s")).select(
        *keys, (F.col("_p") + 1).cast("bigint").alias("ord"), "_s.kind", "_s.text")


def index_entries(lines: DataFrame, raw: str = "raw") -> DataFrame:
    return (lines.withColumn("_e", X.index_entry(raw)).filter("_e IS NOT NULL")
            .withColumns({"kind": F.col("_e.kind"), "name": F.col("_e.name"), "parent": F.col("_e.parent")})
            .drop("_e", raw))


def names_used(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Identifier runs with their qualifier context: ``qualifier`` stands before ``::``, ``standard`` is in a std chain."""
    # Only text with a qualifier in it has any context to look at; the rest is cut up without leaving its row.
    qualified = F.col(text).contains("::")
    plain = df.filter(~qualified).select(*keys, F.posexplode(X.name_runs(text)).alias("pos", "_r")).select(
        *keys, (F.col("pos") + 1).cast("bigint").alias("pos"), "_r.name", F.lit(False).alias("qualifier"),
        F.lit(False).alias("standard"))
    runs = df.filter(qualified).select(*keys, F.posexplode(X.name_runs(text)).alias("pos", "_r")).select(
        *keys, "pos", "_r.gap", "_r.name")
    order = Window.partitionBy(*keys).orderBy("pos")
    connected = (F.col("pos") > 0) & F.col("gap").rlike("^[ \\t\\r\\n]*::[ \\t\\r\\n]*$")
    chain = F.last(F.when(~F.col("_c"), F.col("name")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    contextual = (runs.withColumn("_c", connected)
                  .withColumn("qualifier", F.coalesce(F.lead("gap").over(order).rlike("^[ \\t\\n]*::"), F.lit(False)))
                  .withColumn("standard", F.col("_c") & (chain == "std"))
                  .select(*keys, (F.col("pos") + 1).cast("bigint").alias("pos"), "name", "qualifier", "standard"))
    return plain.unionByName(contextual).filter("name <> ''")


def first_uses(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Each name of a text once, with the place of its first use; settled inside the row."""
    names = F.regexp_extract_all(F.col(text), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return df.select(*keys, names.alias("_n")).select(*keys, F.explode(F.transform(
        F.array_distinct("_n"), lambda n: F.struct(F.array_position("_n", n).alias("pos"), n.alias("name")))).alias("_u")).select(
        *keys, "_u.pos", "_u.name")


def slice_sections(lines: DataFrame, keys: Sequence[str] = ("doc_id",), raw: str = "raw",
                   bare: bool = False) -> DataFrame:
    """Each heading with its last line: the line before the next heading of the same or a higher level. Titles may be
    wrapped over lines."""
    from palimpsest.operators import sections as S
    heads = all_headings(lines, keys, raw, bare).select(*keys, "line_no", "depth", "stable")
    last = lines.groupBy(*keys).agg(F.max("line_no").alias("_end"))
    nested = S.next_at_or_above(heads, keys)
    return nested.join(last, list(keys)).select(
        *keys, "stable", "depth", F.col("line_no").alias("first_line"),
        F.coalesce(F.col("next_line") - 1, F.col("_end")).alias("last_line"))


def lines_in_slices(lines: DataFrame, slices: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The lines of each slice. A slice lists its line numbers, so the join is on equal keys and makes no other pair."""
    listed = slices.withColumn("line_no", F.explode(F.sequence("first_line", "last_line")))
    return listed.join(lines, [*keys, "line_no"])
