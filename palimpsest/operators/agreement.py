"""Two listings of the same declarations: paired by name, attribute by attribute."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as X

FLAGS = [name for name, _ in V.ATTRIBUTES]


def flag_rows(rows: DataFrame, keys: Sequence[str], flags: dict[str, str]) -> DataFrame:
    """One row per declaration and attribute. ``flags`` maps an attribute word to its boolean column."""
    return rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(word).alias("attribute"), F.col(column).alias("held")) for word, column in flags.items()
    ])).alias("_f")).select(*keys, "_f.attribute", "_f.held")


def disagreements(pairs: DataFrame, listed: DataFrame, declared: DataFrame, flags: dict[str, str],
                  side: str = "declaration") -> DataFrame:
    """Attributes on which the two rows of a pair differ.

    ``pairs``: doc_id, i, j. ``listed``/``declared``: doc_id, i/j, name and a boolean per attribute. The pair is
    joined once to each side and its attributes are compared in the row, so no unpivoted table is shuffled.
    """
    s = listed.select("doc_id", "i", "name", *[F.col(c).alias(f"_s_{c}") for c in flags.values()])
    d = declared.select("doc_id", "j", *[F.col(c).alias(f"_d_{c}") for c in flags.values()])
    found = F.array_compact(F.array(*[
        F.when(F.col(f"_s_{c}") != F.col(f"_d_{c}"), F.struct(
            F.lit(word).alias("attribute"),
            F.concat(F.lit("the synopsis "), F.when(F.col(f"_s_{c}"), "has").otherwise("does not have"),
                     F.lit(f" `{word}` and the {side} "),
                     F.when(F.col(f"_d_{c}"), "does").otherwise("does not")).alias("message")))
        for word, c in flags.items()]))
    return pairs.select("doc_id", "i", "j").join(s, ["doc_id", "i"]).join(d, ["doc_id", "j"]).select(
        "doc_id", "i", "j", "name", F.explode(found).alias("_f")).select(
        "doc_id", "i", "j", "name", "_f.attribute", "_f.message")


def one_sided(pairs: DataFrame, listed: DataFrame, declared: DataFrame) -> DataFrame:
    """Rows without a partner: a note for a listed one, a warning for a declared one."""
    left = listed.join(pairs.select("doc_id", "i"), ["doc_id", "i"], "left_anti").select(
        "doc_id", "name", F.lit("note").alias("severity"), F.lit(V.ONLY_SYNOPSIS).alias("message"))
    right = declared.join(pairs.select("doc_id", "j"), ["doc_id", "j"], "left_anti").select(
        "doc_id", "name", F.lit("warning").alias("severity"), F.lit(V.ONLY_DECLARED).alias("message"))
    return left.unionByName(right)


def against_parents(unpaired: DataFrame, parents: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Rows the class does not declare, against every parent that declares the name; equal findings once.

    ``unpaired``: doc_id, i, name and flags. ``parents``: doc_id, parent, j, name and flags, one row per name and
    parent. Rows no parent declares are notes.
    """
    base = parents.select("doc_id", "name", *[F.col(c).alias(f"_d_{c}") for c in flags.values()])
    differs = F.array_compact(F.array(*[
        F.when(F.col(f"_d_{c}").isNotNull() & (F.col(c) != F.col(f"_d_{c}")), F.concat(
            F.lit("the synopsis "), F.when(F.col(c), "has").otherwise("does not have"),
            F.lit(f" `{word}` and the base class's declaration "),
            F.when(F.col(f"_d_{c}"), "does").otherwise("does not"))) for word, c in flags.items()]))
    met = unpaired.join(base, ["doc_id", "name"])
    found = met.select("doc_id", "i", "name", F.explode(differs).alias("message")).distinct().select(
        "doc_id", "i", "name", F.lit("warning").alias("severity"), "message")
    alone = unpaired.join(base.select("doc_id", "name").distinct(), ["doc_id", "name"], "left_anti").select(
        "doc_id", "i", "name", F.lit("note").alias("severity"), F.lit(V.ONLY_SYNOPSIS).alias("message"))
    return found.unionByName(alone)


def _matched(asks: list, offers: list) -> list[tuple]:
    """(ask_id, distance, scope, offer_id) of one name: the rounds of ``nearest_scope``."""
    order = lambda v: (v is not None, v)
    free: dict = {}
    for scope, offer in sorted(((o["scope"], o["offer_id"]) for o in offers if o["scope"] is not None),
                               key=lambda o: order(o[1]), reverse=True):
        free.setdefault(scope, []).append(offer)
    left = sorted(((a["ask_id"], a["scopes"]) for a in asks), key=lambda a: order(a[0]))
    found, distance = [], 0
    while left:
        done = set()
        for ask, scopes in left:
            if distance < len(scopes) and free.get(scopes[distance]):
                found.append((ask, distance, scopes[distance], free[scopes[distance]].pop()))
                done.add(ask)
        distance += 1
        left = [a for a in left if a[0] not in done and distance < len(a[1])]
    return found


def nearest_scope(asked: DataFrame, offered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each asking row with an offer of its name in the innermost enclosing scope that still has one.

    ``asked``: keys, ask_id, name, scopes (innermost first). ``offered``: keys, scope, name, offer_id. An offer is used
    once. Rounds go outwards: at each distance the k-th row that still asks meets the k-th offer still free in its scope,
    and what is left over looks one scope further out. Names do not meet, so the rows of one name, a document's worth,
    are one row and its rounds are walked there: each side is shuffled once, whatever the depth.
    """
    types = {f.name: f.dataType.simpleString() for f in [*asked.schema, *offered.schema]}
    block = [*keys, "name"]
    asks = asked.filter(F.size("scopes") > 0).groupBy(*block).agg(F.collect_list(F.struct("ask_id", "scopes")).alias("_a"))
    offers = offered.groupBy(*block).agg(F.collect_set(F.struct("scope", "offer_id")).alias("_o"))

    def run(batches):
        for batch in batches:
            own = [batch.column(c) for c in block]
            met = [_matched(a, o) for a, o in zip(batch.column("_a").to_pylist(), batch.column("_o").to_pylist(), strict=True)]
            row = pa.array([i for i, rows in enumerate(met) for _ in rows], pa.int32())
            flat = [r for rows in met for r in rows]
            side = batch.schema.field("_a").type.value_type, batch.schema.field("_o").type.value_type
            kinds = [side[0].field("ask_id").type, pa.int32(), side[1].field("scope").type, side[1].field("offer_id").type]
            yield pa.RecordBatch.from_arrays(
                [c.take(row) for c in own] + [pa.array([r[i] for r in flat], kind) for i, kind in enumerate(kinds)],
                [*block, "ask_id", "distance", "scope", "offer_id"])
    shape = [*[(c, types[c]) for c in block], ("ask_id", types["ask_id"]), ("distance", "int"), ("scope", types["scope"]),
             ("offer_id", types["offer_id"])]
    return asks.join(offers, block).mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in shape)).select(
        *keys, "ask_id", "name", "distance", "scope", "offer_id")


def nth_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], key: str) -> DataFrame:
    """The n-th row of a key on one side with the n-th of the same key on the other. Rows: keys, key, ord."""
    def numbered(df, name):
        nth = F.row_number().over(Window.partitionBy(*keys, key).orderBy("ord"))
        return df.select(*keys, key, F.col("ord").alias(name), nth.alias("_nth"))
    return numbered(a, "i").join(numbered(b, "j"), [*keys, key, "_nth"]).select(*keys, key, "i", "j")
