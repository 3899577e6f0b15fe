"""Diff of document trees: content hashes bottom-up, then pairing top-down, one level at a time.

A tree is a table of nodes: the keys of its document, ``node_id``, ``parent_id`` (NULL at the top), ``ancestors``
(outermost first), ``ord`` (reading order in the document), ``type``, ``name``, ``entities``, ``signatures``, ``text``.
Types are ``section``, ``synopsis``, ``item``, ``element``, ``paragraph`` and ``block``. A document's nodes are bounded by
what one cell held, as its lines are; documents are spread over the cluster, and every level of all of them is one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import pairs as PP
from palimpsest.functions import sequence as SQ
from palimpsest.operators import diff as R
from palimpsest.operators import pairing as PR
from palimpsest.session import checkpointed

KEYED = ("section", "synopsis", "item", "element")
SIDES = ("old", "new")
CHILD = ("node_id", "type", "exact", "names", "said", "content", "inner")


def exact_key() -> Column:
    """What identifies a node among its siblings, NULL for what is known by its wording alone.

    A section is known by its stable name, a synopsis by its class, an item by the names and signatures it declares, an
    element by its kind.
    """
    named = F.concat_ws("|", F.array_join(F.array_sort(F.array_distinct("entities")), ","), F.array_join("signatures", "|"))
    return F.when(F.col("type").isin(*KEYED), F.concat(
        F.col("type"), F.lit(":"), F.when(F.col("type") == "item", named).otherwise(F.col("name"))))


def content_hashes(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``content``, equal for subtrees that are equal node for node, ``place`` in reading order and subtree ``size``.

    Every node hands its own digest to each node above it, with its place and level below that node, so every level is
    grouped at once, inside the clustering by document that ``place`` needs.
    """
    own = F.md5(F.to_json(F.struct("type", "name", "entities", "signatures", "text")))
    order = Window.partitionBy(*keys).orderBy("ord")
    placed = nodes.withColumns({"place": F.row_number().over(order).cast("bigint"), "_own": own, "_level": F.size("ancestors")})
    rest = [c for c in placed.columns if c not in (*keys, "node_id", "_own", "_level")]
    above = placed.select(*keys, "place", "_own", "_level", F.col("node_id").alias("_from"), F.struct(*rest).alias("_rest"), F.explode(
        F.concat("ancestors", F.array("node_id"))).alias("node_id"))
    whole = above.groupBy(*keys, "node_id").agg(
        F.first(F.when(F.col("_from") == F.col("node_id"), F.col("_rest")), ignorenulls=True).alias("_rest"),
        F.array_sort(F.collect_list(F.struct("place", "_level", "_own"))).alias("_s"))
    digest = F.md5(F.array_join(F.transform("_s", lambda s: F.concat(
        (s["_level"] - F.col("_s")[0]["_level"]).cast("string"), s["_own"])), ","))
    return whole.filter("_rest IS NOT NULL").select(
        *keys, "node_id", "_rest.*", digest.alias("content"), F.size("_s").alias("size"))


def diff_trees(old: DataFrame, new: DataFrame, keys: Sequence[str], threshold: float = V.PAIRING_THRESHOLD) -> DataFrame:
    """(keys, level, a_id, b_id, change, by, moved): what became of each node.

    ``change`` is ``same`` (equal with all beneath), ``edited`` (paired, something differs on it or beneath), ``removed`` or
    ``added``. A removed or added node stands for its whole subtree, and what is beneath a node that is the same has no row;
    ``beneath`` spells both out. Pairs whose order both revisions cannot keep are a removal and an addition with the other's
    id in ``moved``.
    """
    keys = list(keys)
    block = [*keys, "a_parent", "b_parent"]
    top = F.lit(-1).cast("bigint")
    said = F.when(F.col("type") == "item", F.array_join("signatures", " ")).otherwise(F.col("text"))
    names = F.when(F.col("type") == "item", F.array_join(F.array_sort(F.array_distinct("entities")), ",")).otherwise("")
    exact = exact_key()
    sides = {}
    for side, df in zip(SIDES, (old, new)):
        # Keys are only compared, and only what has none, or is an item, is read.
        read = exact.isNull() | (F.col("type") == "item")
        sides[side] = checkpointed(content_hashes(df, keys).select(
            *keys, F.coalesce(F.col("parent_id").cast("bigint"), top).alias("parent_id"), (F.size("ancestors") + 1).alias("depth"),
            F.col("place").alias("ord"), F.col("node_id").cast("bigint").alias("node_id"), "type", F.md5(exact.cast("binary")).alias("exact"),
            F.coalesce(names, F.lit("")).alias("names"), F.when(read, said).alias("said"), "content", (F.col("size") > 1).alias("inner")))
    results, opened, level = [], None, 1
    while True:
        children = []
        for side, parent in zip(SIDES, ("a_parent", "b_parent")):
            # A parent of this level was paired on the one before, so a node is read on the level of its own depth only.
            own = sides[side].filter(F.col("depth") == level).withColumnRenamed("parent_id", parent)
            other = "b_parent" if parent == "a_parent" else "a_parent"
            met = own.withColumn(other, top) if opened is None else own.join(opened, [*keys, parent])
            children.append(met.select(*block, F.lit(side).alias("side"), "ord", *CHILD))
        done = checkpointed(_settled(children[0].unionByName(children[1]), block, threshold))
        results.append(done.withColumn("level", F.lit(level).cast("bigint")))
        opened = done.filter("change = 'edited' AND inner").select(
            *keys, F.col("a_id").alias("a_parent"), F.col("b_id").alias("b_parent"))
        if opened.isEmpty():
            break
        level += 1
    return reduce(DataFrame.unionByName, results).select(*keys, "level", "a_id", "b_id", "change", "by", "moved")


def _settled(rows: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """The children of paired parents in order: pairs that a shortest script keeps, the rest removed and added.

    The children of a pair of parents are one row, paired and scripted there.
    """
    whole = PR.listed(rows, block, CHILD)
    lists = [[F.col(side)[c] for c in ("type", "exact", "names", "said")] for side in ("_old", "_new")]
    scripted = whole.withColumn("_f", PP.settled_siblings(*lists, threshold)).withColumn("script", SQ.steps_of(F.col("_f.script")))
    # Places of -1 are nowhere: no element, hence NULL.
    at = lambda values, k: F.get(values, F.when(k >= 0, k))
    reasons = F.array(*[F.lit(name) for name in PP.BY])

    def step(s):
        a, b = F.when(s["op"] != R.INSERT, F.get("_old", s["a"])), F.when(s["op"] != R.DELETE, F.get("_new", s["b"]))
        moved = (F.when(s["op"] == R.DELETE, at(F.col("_new"), F.get("_f.to", s["a"]))["node_id"])
                 .when(s["op"] == R.INSERT, at(F.col("_old"), F.get("_f.back", s["b"]))["node_id"]))
        change = (F.when(s["op"] == R.DELETE, "removed").when(s["op"] == R.INSERT, "added")
                  .when(a["content"] == b["content"], "same").otherwise("edited"))
        return F.struct(
            a["node_id"].alias("a_id"), b["node_id"].alias("b_id"), change.alias("change"),
            F.when(s["op"] == R.KEEP, at(reasons, F.get("_f.by", s["a"]))).alias("by"), moved.alias("moved"),
            (a["inner"] | b["inner"]).alias("inner"))
    return scripted.select(*block[:-2], F.explode(F.transform("script", step)).alias("_s")).select(*block[:-2], "_s.*")


def beneath(nodes: DataFrame, decided: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Every node with what was decided of it, or of the nearest node above that stands for it.

    ``ident`` is ``a_id`` for the old revision and ``b_id`` for the new one.
    """
    keys = list(keys)
    said = decided.filter(F.col(ident).isNotNull()).select(*keys, F.col(ident).alias("_over"), "change")
    above = nodes.withColumn("_level", F.size("ancestors")).select(*keys, "node_id", F.posexplode(
        F.concat("ancestors", F.array("node_id"))).alias("_at", "_over")).withColumn("_over", F.col("_over").cast("bigint"))
    nearest = above.join(said, [*keys, "_over"]).groupBy(*keys, "node_id").agg(F.max_by("change", "_at").alias("change"))
    return nodes.join(nearest, [*keys, "node_id"])
