"""One-to-one pairing: greedy best first, by rounds of mutual best."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import pairs as PP
from palimpsest.functions import sequence as SQ
from palimpsest.functions import text as X
from palimpsest.session import checkpointed


WALKED = 100_000  # candidates that are few enough for one walk


def greedy_pairs(candidates: DataFrame, keys: Sequence[str] = (), walked: int = WALKED) -> DataFrame:
    """The pairs a best-first walk takes: order (score descending, i, j), each side used once.

    A pair that is the best left for both of its sides is taken whatever the others are, so every round takes all
    such pairs at once and drops what they used. Where all of some i score best, and the same, with all of some j and
    these with them, the k-th i takes the k-th j: a block of ties is one round. Rounds go on until
    at most ``walked`` candidates are left, which are walked in order; each is cut off in the checkpoint folder.
    """
    keys = list(keys)

    def tied(of: str, other: str) -> DataFrame:
        """Each ``of`` with the score it has at best, and the fingerprint of all ``other`` that give it."""
        top = left.groupBy(*keys, of).agg(F.max("score").alias("_s"))
        ones = left.join(top, [*keys, of]).filter(F.col("score") == F.col("_s"))
        return ones.groupBy(*keys, of, "_s").agg(*_fingerprint(other, "_theirs"))

    def blocks() -> DataFrame:
        """Pairs of the blocks of ties: sets of i and of j of which each is all that the other likes best."""
        sides = {}
        for of, other in (("i", "j"), ("j", "i")):
            own = tied(of, other)
            group = own.groupBy(*keys, "_s", "_theirs").agg(*_fingerprint(of, "_ours"))
            nth = F.row_number().over(Window.partitionBy(*keys, "_s", "_theirs").orderBy(of))
            sides[of] = own.join(group, [*keys, "_s", "_theirs"]).withColumn("_k", nth)
        a = sides["i"].select(*keys, "_s", F.col("_ours").alias("_is"), F.col("_theirs").alias("_js"), "_k", "i")
        b = sides["j"].select(*keys, "_s", F.col("_theirs").alias("_is"), F.col("_ours").alias("_js"), "_k", "j")
        return a.join(b, [*keys, "_s", "_is", "_js", "_k"]).select(*keys, "i", "j")
    rank = F.struct((-F.col("score")).alias("s"), "i", "j")
    left = checkpointed(candidates.select(*keys, "i", "j", "score"))
    taken = [left.filter("false")]
    while left.count() > walked:
        best_i = left.groupBy(*keys, "i").agg(F.min(rank).alias("_b")).select(*keys, "i", F.col("_b.j").alias("j"))
        best_j = left.groupBy(*keys, "j").agg(F.min(rank).alias("_b")).select(*keys, F.col("_b.i").alias("i"), "j")
        hit = best_i.join(best_j, [*keys, "i", "j"]).unionByName(blocks()).distinct()
        marked = checkpointed(
            left.join(hit.withColumnRenamed("j", "_hj"), [*keys, "i"], "left")
            .join(hit.withColumnRenamed("i", "_hi"), [*keys, "j"], "left"))
        taken.append(marked.filter("_hj = j").select(*keys, "i", "j", "score"))
        left = marked.filter("_hj IS NULL AND _hi IS NULL").select(*keys, "i", "j", "score")
    taken.append(fit_in_group(left, keys).select(*keys, "i", "j", "score"))
    return reduce(DataFrame.unionByName, taken)


def _fingerprint(column: str, name: str) -> list:
    """A set of values as its size and two 64-bit sums of hashes."""
    return [F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64(column)).alias("x"),
                     F.bit_xor(F.xxhash64(column, F.lit(1))).alias("y")).alias(name)]


def fit_in_group(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same walk inside documents, without rounds: every i and j of a document is used once, best first.

    With no score, each i in order takes the first j still free.
    """
    scored = "score" in pairs.columns
    rest = [c for c in pairs.columns if c not in (*keys, "i", "j", "score")]
    rank = [(-F.col("score")).alias("s")] if scored else []
    listed = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rank, "i", "j", *rest))).alias("_p"))
    walked = listed.withColumn("_k", SQ.free_positions(F.transform("_p", lambda p: p["i"]), F.transform("_p", lambda p: p["j"])))
    taken = walked.select(*keys, F.explode(F.transform("_k", lambda k: F.get("_p", k))).alias("_t"))
    score = [(-F.col("_t.s")).alias("score")] if scored else []
    return taken.select(*keys, "_t.i", "_t.j", *score, *[f"_t.{c}" for c in rest])


def two_sides(a: DataFrame, b: DataFrame, keys: Sequence[str], order: tuple[str, str] | str, extra: Sequence[str] = ()) -> DataFrame:
    """Both sides as one table."""
    orders = (order, order) if isinstance(order, str) else order
    sides = [d.select(*keys, F.lit(side).alias("side"), F.col(o).alias("ord"), "text", *extra)
             for side, o, d in (("old", orders[0], a), ("new", orders[1], b))]
    return sides[0].unionByName(sides[1])


def mated(rows: DataFrame, block: Sequence[str]) -> DataFrame:
    """Each row with the place of its mate: the k-th of a block on one side and the k-th of it on the other."""
    nth = F.row_number().over(Window.partitionBy(*block, "side").orderBy("ord"))
    same = Window.partitionBy(*block, "nth")
    at = {side: F.max(F.when(F.col("side") == side, F.col("ord"))).over(same) for side in ("old", "new")}
    return rows.withColumn("nth", nth).withColumn(
        "mate", F.when(F.col("side") == "old", at["new"]).otherwise(at["old"]))


def listed(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per document: ``_old`` and ``_new``, its rows of either side in order as structs of ord and ``columns``."""
    at = {side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("ord", *columns)))) for side in ("old", "new")}
    return rows.groupBy(*keys).agg(at["old"].alias("_old"), at["new"].alias("_new"))


def kinds_of(side: str, agree: Sequence[str]) -> Column:
    """What must be equal for two rows to meet, as one text for each row of a side."""
    return F.transform(side, lambda s: F.to_json(F.struct(*[s[c].alias(c) for c in agree])) if agree else F.lit(""))


def texts_of(side: str) -> Column:
    return F.transform(side, lambda s: s["text"])


def alike_in_document(rows: DataFrame, keys: Sequence[str], minimum: float, agree: Sequence[str] = ()) -> DataFrame:
    """Old and new rows of a document that share words, with their word-set score: keys, agree, i, j, score.

    A document's texts of both sides are one row, where those meet that share one of their rarest words.
    """
    whole = listed(rows, keys, [*agree, "text"]).filter((F.size("_old") > 0) & (F.size("_new") > 0))
    found = whole.withColumn("_f", PP.scored_pairs(
        texts_of("_old"), texts_of("_new"), kinds_of("_old", agree), kinds_of("_new", agree), minimum))
    return found.select(*keys, F.explode(_placed(agree)).alias("_s")).select(*keys, "_s.*")


def _placed(agree: Sequence[str]) -> Column:
    """The pairs of ``_f`` with the places and the ``agree`` columns of what they pair."""
    return F.transform(F.arrays_zip("_f.x", "_f.y", "_f.score"), lambda p: F.struct(
        *[F.get("_old", p["x"])[c].alias(c) for c in agree], F.get("_old", p["x"])["ord"].alias("i"),
        F.get("_new", p["y"])["ord"].alias("j"), p["score"].alias("score")))


def pair_by_name(a: DataFrame, b: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """Pair rows of one name in a document, those that read most alike first, while both sides have one left.

    ``a``: keys, name, i, text; ``b``: keys, name, j, text. A document's rows of both sides are one row. Those with the
    same set of words are matched first, k-th with k-th, which is what best-first does with them. Rows that share words
    follow best first, and what is left of a name shares nothing, so its order decides.
    """
    whole = listed(two_sides(a, b, keys, ("i", "j"), [name]), keys, [name, "text"]).filter(
        (F.size("_old") > 0) & (F.size("_new") > 0))
    names = lambda side: F.transform(side, lambda s: s[name])
    found = whole.withColumn("_f", PP.pairs_by_name(texts_of("_old"), texts_of("_new"), names("_old"), names("_new")))
    return found.select(*keys, F.explode(_placed([name])).alias("_s")).select(*keys, "_s.*")


def pair_asking(asking: DataFrame, base: DataFrame, threshold: float = V.PAIRING_THRESHOLD
                ) -> tuple[DataFrame, DataFrame]:
    """Items that ask for a description, each with the baseline item of its section it takes it from.

    ``asking``: doc_id, section, i, entities, text; ``base``: doc_id, section, j, entities, text. Items are served in
    order, and what one has claimed is gone for the next. An item with names, or without a declaration, takes the best
    reading of the unclaimed items of the same names, however little it reads alike. Failing that, one with a declaration
    takes the best reading, from the threshold on, of the unclaimed items with a declaration where one side gives no
    names. Unpaired asking items are returned as the second table.
    """
    keys, block = ["doc_id"], ["doc_id", "section"]
    blank = F.trim("text") == ""
    words = X.token_set("text").alias("_w")
    own = asking.filter((F.col("entities") != "") | blank).select(*block, "entities", "i", words)
    theirs = base.select(*block, "entities", "j", words.alias("_v"))
    # Items of one set of names in a section: an overload set, a part of one document.
    named = own.join(theirs, [*block, "entities"]).select(
        *block, "i", F.lit(1).alias("tier"), X.jaccard(F.col("_w"), F.col("_v")).alias("score"), "j")
    rows = two_sides(asking, base, keys, ("i", "j"), ["section", "entities"]).filter(F.trim("text") != "").withColumn(
        "ord", F.struct("ord", (F.col("entities") == "").alias("_u")))
    alike = alike_in_document(rows, keys, threshold, ["section"]).filter(F.col("i._u") | F.col("j._u")).select(
        *block, F.col("i.ord").alias("i"), F.lit(2).alias("tier"), "score", F.col("j.ord").alias("j"))
    listed = named.unionByName(alike).groupBy(*block).agg(F.array_sort(F.collect_list(F.struct(
        "i", "tier", (-F.col("score")).alias("s"), "j"))).alias("_p"))
    walked = listed.withColumn("_k", SQ.free_positions(F.transform("_p", lambda p: p["i"]), F.transform("_p", lambda p: p["j"])))
    pairs = walked.select(*block, F.explode(F.transform("_k", lambda k: F.get("_p", k))).alias("_t")).select(
        *block, "_t.i", "_t.j", (-F.col("_t.s")).alias("score"))
    return pairs, asking.join(pairs.select("doc_id", "i"), ["doc_id", "i"], "left_anti")


def best_match(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each i the best j; the first of equals."""
    return candidates.groupBy(*keys, "i").agg(F.min(F.struct((-F.col("score")).alias("s"), "j")).alias("_b")).select(
        *keys, "i", F.col("_b.j").alias("j"), (-F.col("_b.s")).alias("score"))
