"""Documents cut into fragments, papers put together, and what was made of what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as X
from palimpsest.operators import ordered as O


def derive_roots(names: DataFrame, keys: Sequence[str] = ("doc_id",), name: str = "stable") -> DataFrame:
    """The longest dotted prefix all names of a document share, one part shorter where a name is the prefix itself.

    What the least and the greatest name share, all names between them share, so two aggregates and no list of names
    settle it. NULL when nothing is shared.
    """
    parts = F.split(F.col(name), "\\.", -1)
    ends = names.groupBy(*keys).agg(F.min(parts).alias("_a"), F.max(parts).alias("_b"))
    upto = F.least(F.size("_a"), F.size("_b"))
    same = F.filter(F.sequence(F.lit(1), upto), lambda i: F.slice("_a", F.lit(1), i) == F.slice("_b", F.lit(1), i))
    n = F.coalesce(F.array_max(same), F.lit(0))
    shared = ends.withColumn("_p", F.slice("_a", F.lit(1), n))
    # The prefix is itself a name exactly when it is the least one: nothing sorts before its own extensions.
    kept = F.when(F.size("_p") == F.size("_a"), F.slice("_p", F.lit(1), F.greatest(F.size("_p") - 1, F.lit(0)))).otherwise(F.col("_p"))
    return shared.withColumn("_k", kept).select(*keys, F.when(F.size("_k") > 0, F.array_join("_k", ".")).alias("root"))


def split_documents(nodes: DataFrame, roots: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Each node with the fragment it goes to: its top-level section, or the root fragment for a loose node.

    ``nodes``: keys, ord, top (the top-level section's name, NULL when loose), top_ord. A section is a fragment of its
    own even when another has its name; the loose nodes of a document are one, at the place of the first.
    """
    placed = nodes.join(roots, list(keys), "left").withColumn("fragment", F.coalesce("top", "root"))
    return placed.withColumn("piece", F.coalesce("top_ord", F.lit(0)))


def fragments_of(placed: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per fragment in document order: fragment, pos, text. A fragment is part of one document's cell."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(text).alias("t")))), lambda s: s["t"]), "\n")
    return placed.groupBy(*keys, "piece", "fragment").agg(F.min("ord").alias("pos"), F.count("*").alias("n_nodes"), body.alias("text"))


def fragment_findings(fragments: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Fragments with no name, a name no file can have, or a name another fragment of the paper has.

    Names are counted before any list of labels is made, and only the two ends of a collision are reported.
    """
    nameless = fragments.filter("fragment IS NULL OR fragment = ''").groupBy(paper, "doc_id").agg(F.sum("n_nodes").alias("_n")).select(
        paper, "doc_id", F.lit("error").alias("severity"), X.template(V.FRAGMENT_NO_PREFIX, F.col("_n")).alias("message"))
    named = fragments.filter("fragment IS NOT NULL AND fragment <> ''")
    unusable = named.filter(~X.usable_as_file_name("fragment")).select(
        paper, "doc_id", F.lit("error").alias("severity"), X.template(V.FRAGMENT_UNUSABLE, F.col("fragment")).alias("message"))
    clash = collisions(named, paper).select(
        paper, F.col("last_doc").alias("doc_id"), F.lit("error").alias("severity"),
        X.template(V.FRAGMENT_COLLISION, F.col("fragment")).alias("message"))
    return nameless.unionByName(unusable).unionByName(clash)


def collisions(fragments: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Fragment names that several fragments of a paper would be written under."""
    return fragments.groupBy(paper, "fragment").agg(
        F.count("*").alias("n_writers"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("n_writers > 1")


def positions(pieces: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, length: str = "length") -> DataFrame:
    """Where each piece of an ordered whole stands: its number and the offset of its first character.

    Pieces are joined by one newline. The whole may be any size: it is never one value.
    """
    size = (F.col(length) + 1).cast("bigint")
    return O.running(pieces, keys, order, chunk, pos=O.Running("sum", F.lit(1).cast("bigint")),
                     offset=O.Running("sum", size, before=True))


def named(fragments: DataFrame, document: str = "doc_id") -> DataFrame:
    """Fragments that have no name to be written under take their document's; ``fragment_findings`` reports them."""
    return fragments.withColumn("fragment", F.coalesce(F.when(F.col("fragment") != "", F.col("fragment")), F.concat(
        F.lit("document-"), F.col(document).cast("string"))))


def manifest(fragments: DataFrame, order: Sequence[str], chunk: Column, form: str, paper: str = "paper_id") -> DataFrame:
    """(paper, pos, path): what a paper's fragments are written as, in document order."""
    path = F.concat_ws("/", F.col(paper), F.concat("fragment", F.lit(V.EXTENSIONS[form])))
    return O.numbered(fragments, [paper], order, chunk, "pos").select(paper, "pos", path.alias("path"))


def lineage(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(output, input): every output with each distinct input its documents came from; standard input is none.

    ``outputs``: doc_id, output; ``inputs``: doc_id, input.
    """
    read = inputs.filter(~F.col("input").isin("-", "")).distinct()
    return outputs.select("doc_id", "output").distinct().join(read, "doc_id").select("output", "input").distinct()
