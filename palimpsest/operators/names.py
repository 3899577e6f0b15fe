"""Who may see which name: rosters, visibility, leaks, uses nothing prints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as X

_VISIBLE = [d for d, visible, _ in V.DISPOSITIONS if visible]


def disposition_of(facts: dict[str, Column]) -> Column:
    """What became of a declared row, the first rule that holds winning.

    ``facts`` gives a boolean column for merge, omit, elsewhere, routed, described, expos, private, data and
    defaulted; a fact that is not given does not hold.
    """
    rules = [("merged", ["merge"]), ("omitted", ["omit", "elsewhere"]), ("routed", ["routed"]),
             ("described", ["described"]), ("expos", ["expos"]), ("private", ["private"]), ("declared", ["data"]),
             ("defaulted", ["defaulted"])]
    out = F.lit("undocumented")
    for name, causes in reversed(rules):
        holds = F.lit(False)
        for cause in causes:
            holds = holds | F.coalesce(facts.get(cause, F.lit(False)), F.lit(False))
        out = F.when(holds, name).otherwise(out)
    return out


def visible(disposition: Column) -> Column:
    return disposition.isin(_VISIBLE)


def reason(disposition: Column) -> Column:
    table = F.create_map(*[F.lit(x) for d, _, why in V.DISPOSITIONS for x in (d, why)])
    return F.try_element_at(table, disposition)


def visibility(roster: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per name: whether any declaration of it is visible, and the first hidden one in document order."""
    hidden_at = F.when(~visible(F.col("disposition")), F.col("ord"))
    return roster.groupBy(*keys, "name").agg(
        F.bool_or(visible(F.col("disposition"))).alias("visible"),
        F.min_by("disposition", hidden_at).alias("disposition"), F.min_by("kind", hidden_at).alias("kind"))


def documented_names(roster: DataFrame, owners: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Names a reader of each document can look up: visible rows and the owners themselves."""
    rows = roster.filter(visible(F.col("disposition"))).select(*keys, "name")
    return rows.unionByName(owners.select(*keys, F.col("owner").alias("name"))).filter("name <> ''").distinct()


def hidden_names(roster: DataFrame, documented: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Names of each document that nothing in its paper documents, with what hides them.

    A visible declaration anywhere in the paper wins over a hidden one, so the two small name tables meet before
    any use of a name does.
    """
    mine = visibility(roster, [paper, "doc_id"]).filter("NOT visible").select(paper, "doc_id", "name", "disposition", "kind")
    return mine.join(documented.select(paper, "name").distinct(), [paper, "name"], "left_anti")


def leaks(fragments: DataFrame, hidden: DataFrame, fragment: Sequence[str], text: str = "text") -> DataFrame:
    """Hidden names that wording uses: one finding per name and fragment, at its first use.

    ``fragments``: the fragment's keys, ``doc_id`` among them, and its text. The hidden names of a document, a few of
    its own declarations, meet its fragments as one map, so the uses are looked up in the row and never shuffled.
    """
    known = hidden.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "disposition"))).alias("_h"))
    names = F.regexp_extract_all(F.col(text), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    met = fragments.join(known, "doc_id").select(*fragment, names.alias("_n"), "_h")
    leaked = F.transform(F.array_intersect("_n", F.map_keys("_h")), lambda n: F.struct(
        F.array_position("_n", n).alias("pos"), n.alias("name"), F.try_element_at("_h", n).alias("disposition")))
    return met.select(*fragment, F.explode(leaked).alias("_l")).select(
        *fragment, "_l.pos", "_l.name", F.lit("error").alias("severity"),
        X.template(V.LEAKED, F.col("_l.name"), reason(F.col("_l.disposition"))).alias("message"))


def foreign_leaks(uses: DataFrame, foreign: DataFrame, documented: DataFrame, fragment: Sequence[str],
                  paper: str = "paper_id") -> DataFrame:
    """Qualifiers that resolve outside the corpus and that no document of the paper documents."""
    wanted = foreign.join(documented.select(paper, "name").distinct(), [paper, "name"], "left_anti")
    first = uses.filter("qualifier").groupBy(*fragment, "name").agg(F.min("pos").alias("pos"))
    return first.join(wanted.select("doc_id", "name", "target"), ["doc_id", "name"]).select(
        *fragment, "pos", "name", F.lit("error").alias("severity"),
        X.template(V.FOREIGN_QUALIFIER, F.col("name"), F.col("target")).alias("message"))


def synopsis_leaks(uses: DataFrame, roster: DataFrame) -> DataFrame:
    """Private names of a class that its own listing uses. ``uses``: doc_id, owner, name, pos."""
    own = roster.filter((F.col("parent") == "") | (F.col("parent") == F.col("owner")))
    seen = visibility(own, ["doc_id", "owner"]).filter("NOT visible AND disposition = 'private' AND name <> owner")
    first = uses.groupBy("doc_id", "owner", "name").agg(F.min("pos").alias("pos"))
    return first.join(seen.select("doc_id", "owner", "name", "disposition"), ["doc_id", "owner", "name"]).select(
        "doc_id", "owner", "pos", "name", F.lit("error").alias("severity"),
        X.template(V.LEAKED_SYNOPSIS, F.col("name"), reason(F.col("disposition"))).alias("message"))


def unextracted_uses(uses: DataFrame, hidden: DataFrame, wording: DataFrame) -> DataFrame:
    """Hidden functions that only a body nothing prints uses. ``uses``: doc_id, user, name."""
    functions = hidden.filter("kind = 'function'").join(
        wording.select("doc_id", "name").distinct(), ["doc_id", "name"], "left_anti")
    return uses.join(functions.select("doc_id", "name", "disposition"), ["doc_id", "name"]).select(
        "doc_id", F.concat("user", F.lit("/body")).alias("context"), F.lit("note").alias("severity"),
        X.template(V.UNEXTRACTED, F.col("name"), reason(F.col("disposition"))).alias("message"))


# --- coverage -----------------------------------------------------------------------------------------------------

def _context():
    owner = F.when(F.col("owner") != "", F.col("owner")).otherwise(F.col("parent"))
    return F.when(owner == "", "synopsis").otherwise(F.concat(owner, F.lit("/synopsis")))


def undocumented(roster: DataFrame) -> DataFrame:
    return roster.filter("disposition = 'undocumented'").select(
        "doc_id", F.lit("undocumented").alias("rule"), F.lit("error").alias("severity"),
        _context().alias("context"), X.template(V.UNDOCUMENTED, F.col("name")).alias("message"))


def misrouted(roster: DataFrame, sections: DataFrame) -> DataFrame:
    """Rows routed to nothing, or to a name that no section of their document has."""
    routed = roster.filter("disposition = 'routed'")
    lost = routed.join(sections.select("doc_id", F.col("stable").alias("section")).distinct(),
                       ["doc_id", "section"], "left_anti")
    message = F.when(F.col("section") == "", X.template(V.ROUTED_NOWHERE, F.col("name"))).otherwise(
        X.template(V.ROUTED_MISSING, F.col("name"), F.col("section")))
    return lost.select("doc_id", F.lit("misrouted").alias("rule"), F.lit("error").alias("severity"),
                       _context().alias("context"), message.alias("message"))


def private_data(roster: DataFrame) -> DataFrame:
    """Unmarked private data of a class that marks other members."""
    exposes = F.bool_or(F.col("disposition") == "expos").over(Window.partitionBy("doc_id", "parent"))
    return roster.withColumn("_e", exposes).filter("_e AND disposition = 'private' AND kind = 'data'").select(
        "doc_id", F.lit("private_data").alias("rule"), F.lit("note").alias("severity"),
        _context().alias("context"), X.template(V.PRIVATE_DATA, F.col("name")).alias("message"))


def dangling_refs(spans: DataFrame, sections: DataFrame) -> DataFrame:
    """Reference spans that point at no section of their document. ``spans``: doc_id, context, target."""
    names = sections.select("doc_id", F.col("stable").alias("target")).distinct()
    return spans.join(names, ["doc_id", "target"], "left_anti").select(
        "doc_id", F.lit("dangling_ref").alias("rule"), F.lit("error").alias("severity"), "context",
        X.template(V.DANGLING_REF, F.col("target")).alias("message"))


def empty_nodes(nodes: DataFrame, signatures: DataFrame, elements: DataFrame) -> DataFrame:
    """Listings with no code, and items with neither a signature nor a description."""
    blank = nodes.filter("type = 'synopsis' AND code = ''").select(
        "doc_id", "node_id", F.lit("error").alias("severity"), F.lit(V.EMPTY_SYNOPSIS).alias("message"))
    key = ["doc_id", "node_id"]
    bare = (nodes.filter("type = 'item'").join(signatures.select(*key).distinct(), key, "left_anti")
            .join(elements.select(*key).distinct(), key, "left_anti"))
    return blank.unionByName(bare.select(*key, F.lit("error").alias("severity"), F.lit(V.EMPTY_ITEM).alias("message")))


def noexcept_throws(signatures: DataFrame, throws: DataFrame) -> DataFrame:
    """Items whose every signature never throws, against an element that says it does, or says nothing.

    ``signatures``: doc_id, node_id, ord, text, is_noexcept. ``throws``: doc_id, node_id, text.
    """
    key = ["doc_id", "node_id"]
    never = signatures.groupBy(*key).agg(F.every("is_noexcept").alias("_e"), F.min_by("text", "ord").alias("_s")).filter("_e")
    said = F.lower(F.trim(F.regexp_replace("text", "[ \\t\\n.]+$", "")))
    message = F.when(F.col("_said") == "nothing", X.template(V.NOEXCEPT_NOTHING, F.col("_s"))).otherwise(
        X.template(V.NOEXCEPT_THROWS, F.col("_s")))
    return throws.filter("trim(text) <> ''").withColumn("_said", said).join(never, key).select(
        *key, F.lit("warning").alias("severity"), F.lit("throws").alias("context"), message.alias("message"))
