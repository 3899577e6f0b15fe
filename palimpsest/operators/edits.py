"""Text edits planned from pairings: changed wording put back into its source, attribute words reconciled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.operators import lines as L


def plan_edits(nodes: DataFrame, old_lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edits that turn the old source into the new one, line by line: (keys, begin, end, replacement).

    ``nodes`` is a revision diff in reading order. The source is its lines with a newline after each. An edited line
    is replaced, a removed one taken out with its newline; added lines go in one piece behind the line of the last
    pair before them, and ahead of everything when there is none.
    """
    at = L.line_offsets(old_lines, keys).select(
        *keys, F.col("line_no").alias("i"), F.col("offset").cast("bigint").alias("begin"),
        (F.col("offset") + F.length("text") + 1).cast("bigint").alias("stop"))
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paired = F.col("change").isin("same", "edited")
    anchored = nodes.withColumn("anchor", F.last(F.when(paired, F.col("i")), ignorenulls=True).over(upto))
    changed = anchored.filter(F.col("change").isin("edited", "removed")).join(at, [*keys, "i"]).select(
        *keys, "begin", F.col("stop").alias("end"),
        F.when(F.col("change") == "removed", "").otherwise(F.concat("new_text", F.lit("\n"))).alias("replacement"))
    added = anchored.filter("change = 'added'").groupBy(*keys, "anchor").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("j", "new_text"))), lambda s: F.concat(s["new_text"], F.lit("\n"))), "")
        .alias("replacement"))
    place = at.select(*keys, F.col("i").alias("anchor"), "stop")
    inserted = added.join(place, [*keys, "anchor"], "left").select(
        *keys, F.coalesce("stop", F.lit(0)).cast("bigint").alias("begin"),
        F.coalesce("stop", F.lit(0)).cast("bigint").alias("end"), "replacement")
    return changed.unionByName(inserted)


def reconcile(listed: DataFrame, declared: DataFrame, keys: Sequence[str], flags: dict[str, str]
              ) -> tuple[DataFrame, DataFrame]:
    """Edits that give each listed line the attribute words its declaration has, and the differences left.

    ``listed``: keys, i, begin, text; ``declared``: keys, i and a boolean per attribute. ``constexpr`` and ``explicit``
    stand at the head of a line, in that order, and ``noexcept`` at its end; other attributes are reported, not written.
    """
    wanted = declared.select(*keys, "i", *[F.col(c).alias(f"_w{n}") for n, c in enumerate(flags.values())])
    # A line meets its declaration once, the pattern only reads lines that hold the word's letters, and only what differs is a row.
    asked = F.array(*[F.struct(
        F.lit(word).alias("attribute"), (F.contains("text", F.lit(word)) & F.rlike(
            "text", F.lit(f"{word}(?<![A-Za-z0-9_]{word})(?![A-Za-z0-9_])"))).alias("_has"),
        F.col(f"_w{n}").alias("_want")) for n, word in enumerate(flags)])
    found = listed.join(wanted, [*keys, "i"]).select(*listed.columns, F.explode(asked).alias("_f"))
    differ = found.select(*listed.columns, "_f.*").filter("_has <> _want")
    word = F.col("attribute")
    tail = word == "noexcept"
    spelled = F.when(tail, F.concat(F.lit(" "), word)).otherwise(F.concat(word, F.lit(" ")))
    at = F.instr("text", spelled).cast("bigint") - 1
    behind = (word == "explicit") & F.col("text").startswith("constexpr ")
    head = F.when(tail, F.length("text")).when(behind, F.length(F.lit("constexpr "))).otherwise(F.lit(0)).cast("bigint")
    patchable = word.isin([w for w, can in V.ATTRIBUTES if can])
    begin = F.col("begin") + F.when(F.col("_has"), at).otherwise(head)
    edits = differ.filter(patchable & (~F.col("_has") | (at >= 0))).select(
        *keys, begin.alias("begin"), (begin + F.when(F.col("_has"), F.length(spelled)).otherwise(0)).alias("end"),
        F.when(F.col("_has"), "").otherwise(spelled).alias("replacement"))
    # Words that go in at one place go in as one edit, in the order the attributes have.
    order = F.array_position(F.array(*[F.lit(w) for w, _ in V.ATTRIBUTES]), F.trim("replacement"))
    merged = edits.groupBy(*keys, "begin", "end").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), "replacement"))), lambda s: s["replacement"]), "").alias("replacement"))
    rest = differ.filter(~(patchable & (~F.col("_has") | (at >= 0)))).select(
        *keys, "i", "attribute", F.lit("warning").alias("severity"),
        F.format_string(V.DISAGREES, F.when(F.col("_has"), "has").otherwise("does not have"), word,
                        F.when(F.col("_want"), "does").otherwise("does not")).alias("message"))
    return merged, rest
