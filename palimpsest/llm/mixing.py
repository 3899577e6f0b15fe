"""Mixing sources to target weights by temperature, with DataFrame functions alone.

A source's share p of all tokens becomes the weight p^a / sum(p^a). The exponent a is the largest in [0, 1] at which
the weights are as even as asked for: their entropy is at least ``even`` of the way from that of the shares to that of
equal weights. Of the exponents that also keep every source's repetition, weight x budget / tokens, at most
``repeats``, the nearest is taken; both conditions are monotone in a, so both are bisected, sixteen ways at a time.

The weights are realised as block permutations under a token budget. A source's quota is weight x budget. Its rows are
dealt to blocks of about ``BLOCK`` rows; in each pass over the source its blocks, and the rows within each, come in an
order that depends on the pass. Whole passes are taken while the quota lasts; the last, partial one takes rows in that
order while the tokens before a row are under the rest of the quota. So a row is taken once for each whole pass, and
at most once more. A hot source is many blocks: no task orders a whole source.

Tokens are words, runs of anything but white space. Null and blank texts have no tokens and are taken once, so that
mixing never loses them. A null source is a source of its own. Where no row has tokens every row is taken once.
Repeated rows are rows of their own; where the last pass ends among rows that are equal in every column, it takes all
of them. Ids may be null or repeat: decisions are taken per row, never joined by id.
An empty table gives an empty result. ``mixed`` leaves out input columns called like those it adds; ``mix`` keeps all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import checkpointed

BLOCK = 500  # rows of a block on average
BROADCAST_SOURCES = 100_000  # plans of so many sources, a few MB, go to every task; more are joined by shuffle
WAYS = 16
ROUNDS = 6  # sixteen-way sections: the exponent is known to 16^-6
ADDED = ("n_tokens", "weight", "quota", "copies")


def tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"\S+")), F.lit(0)).cast("bigint")


def _key(source: str) -> Column:
    """Sources as strings that tell null from all others."""
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))


def source_totals(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: its key, rows and tokens; checkpointed, since every round of the bisection reads it."""
    return checkpointed(docs.select(_key(source).alias("_source"), tokens(text).alias("n")).groupBy("_source").agg(
        F.count("*").alias("_rows"), F.sum("n").alias("_tokens")))


def _section(totals: DataFrame, ok: Column, total: int) -> tuple[float, float]:
    """Bisect [0, 1] for the largest exponent at which ``ok`` holds, over per-exponent sums of all sources."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / WAYS
        exponents = F.transform(F.sequence(F.lit(0), F.lit(WAYS)), lambda i: F.lit(low) + i * F.lit(step))
        share = F.col("_tokens") / F.lit(float(total))
        power = F.pow(share, F.col("a"))
        found = totals.filter(F.col("_tokens") > 0).select("*", F.explode(exponents).alias("a")).groupBy("a").agg(
            F.sum(power).alias("z"), F.sum(power * F.log(share)).alias("zl"),
            F.max(power / share).alias("most")).filter(ok).agg(F.max("a")).first()[0]
        if found is None:
            return low, low
        low, high = found, min(1.0, found + step)
    return low, high


def exponent(totals: DataFrame, even: float = 0.5, repeats: float | None = None, budget: int | None = None) -> float:
    """The exponent of the weights of ``totals``."""
    n, total = totals.filter(F.col("_tokens") > 0).agg(F.count("*"), F.coalesce(F.sum("_tokens"), F.lit(0))).first()
    if n < 2:
        return 1.0
    share = F.col("_tokens") / F.lit(float(total))
    given = totals.filter(F.col("_tokens") > 0).agg(F.sum(-share * F.log(share))).first()[0]
    target = given + even * (math.log(n) - given)
    entropy = F.log("z") - F.col("a") * F.col("zl") / F.col("z")
    a = _section(totals, entropy >= F.lit(target) - 1e-12, total)[0]
    if repeats is not None:
        # Small sources repeat most when weights are even: the least exponent within the limit lies above a.
        times = F.col("most") / F.col("z") * F.lit((budget or total) / total)
        a = max(a, _section(totals, times > F.lit(repeats), total)[1])
    return a


def weights(totals: DataFrame, even: float = 0.5, repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """``totals`` with each source's ``weight`` and its ``quota`` of tokens."""
    total = totals.agg(F.coalesce(F.sum("_tokens"), F.lit(0))).first()[0]
    a = exponent(totals, even, repeats, budget)
    power = F.when(F.col("_tokens") > 0, F.pow(F.col("_tokens") / F.lit(float(max(total, 1))), F.lit(a))).otherwise(0.0)
    z = totals.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(z)
    return totals.withColumn("weight", weight).withColumn(
        "quota", F.floor(weight * F.lit(float(total if budget is None else budget))).cast("bigint"))


def _decided(docs: DataFrame, source: str, text: str, even: float, repeats: float | None, budget: int | None,
             seed: int) -> DataFrame:
    """``docs`` with the columns ``__mix_`` + n_tokens, weight, quota and copies."""
    salt = F.xxhash64(F.lit(seed), *(F.to_json(F.struct(c)) if "map" in t or "variant" in t else F.col(c)
                                     for c, t in docs.dtypes))
    thin = checkpointed(docs.select(_key(source).alias("__mix_source"), tokens(text).alias("__mix_n_tokens"), salt.alias("__mix_salt")))
    sizes = checkpointed(thin.groupBy(F.col("__mix_source").alias("_source")).agg(
        F.count("*").alias("_rows"), F.sum("__mix_n_tokens").alias("_tokens")))
    totals = checkpointed(weights(sizes, even, repeats, budget))
    has = F.col("_tokens") > 0
    plan = totals.select(
        F.col("_source").alias("__mix_source"), F.col("weight").alias("__mix_weight"),
        F.col("quota").alias("__mix_quota"),
        F.greatest(F.lit(1), F.ceil(F.col("_rows") / F.lit(BLOCK))).cast("bigint").alias("__mix_blocks"),
        F.when(has, F.floor(F.col("quota") / F.col("_tokens"))).otherwise(1).cast("bigint").alias("__mix_passes"),
        F.when(has, F.col("quota") % F.col("_tokens")).otherwise(0).cast("bigint").alias("__mix_rest"))
    few = totals.count() <= BROADCAST_SOURCES

    def planned(rows: DataFrame, by: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(by) if few else by, "__mix_source").withColumns({
            "__mix_turn": F.struct(F.xxhash64(F.pmod("__mix_salt", F.col("__mix_blocks")), "__mix_passes").alias("h"),
                                   F.pmod("__mix_salt", F.col("__mix_blocks")).alias("block")),
            "__mix_place": F.struct(F.xxhash64("__mix_salt", "__mix_passes").alias("h"), F.col("__mix_salt").alias("salt"))})
    # The last pass takes whole blocks in turn and a part of one: where it ends is a block and a place in it, per source.
    # Rows then decide for themselves, and no text is shuffled.
    dealt = planned(thin.filter("__mix_n_tokens > 0"), plan)
    order = Window.partitionBy("__mix_source").orderBy("__mix_turn")
    sums = dealt.groupBy("__mix_source", "__mix_turn", "__mix_rest").agg(F.sum("__mix_n_tokens").alias("n"))
    last = checkpointed(sums.withColumn("before", F.sum("n").over(order) - F.col("n")).filter(
        F.col("before") < F.col("__mix_rest")).groupBy("__mix_source").agg(
        F.max(F.struct("__mix_turn", "before")).alias("_last")).select(
        "__mix_source", F.col("_last.__mix_turn").alias("__mix_end"), F.col("_last.before").alias("__mix_before")))
    cut = dealt.join(F.broadcast(last) if few else last, "__mix_source").filter(F.col("__mix_turn") == F.col("__mix_end")).groupBy(
        "__mix_source", "__mix_place", "__mix_rest", "__mix_before").agg(F.sum("__mix_n_tokens").alias("n"))
    inside = Window.partitionBy("__mix_source").orderBy("__mix_place")
    ends = cut.withColumn("_within", F.sum("n").over(inside) - F.col("n")).filter(
        F.col("__mix_before") + F.col("_within") < F.col("__mix_rest")).groupBy("__mix_source").agg(
        F.max("__mix_place").alias("__mix_cut"))
    known = checkpointed(plan.join(last.drop("__mix_before"), "__mix_source", "left").join(ends, "__mix_source", "left"))
    placed = planned(docs.select("*", _key(source).alias("__mix_source"), tokens(text).alias("__mix_n_tokens"),
                                 salt.alias("__mix_salt")), known)
    partial = F.coalesce((F.col("__mix_turn") < F.col("__mix_end")) | (
        (F.col("__mix_turn") == F.col("__mix_end")) & (F.col("__mix_place") <= F.col("__mix_cut"))), F.lit(False))
    taken = F.when(F.col("__mix_n_tokens") == 0, 1).otherwise(F.col("__mix_passes") + F.when(partial, 1).otherwise(0))
    return placed.select(*docs.columns, "__mix_n_tokens", "__mix_weight", "__mix_quota",
                         taken.cast("bigint").alias("__mix_copies"))


def mixed(docs: DataFrame, source: str = "source", text: str = "text", even: float = 0.5,
          repeats: float | None = 4.0, budget: int | None = None, seed: int = 0) -> DataFrame:
    """``docs`` with n_tokens, weight, quota and ``copies``, how often the row is taken (0: not at all)."""
    found = _decided(docs, source, text, even, repeats, budget, seed)
    return found.select(*(c for c in docs.columns if c not in ADDED),
                        *(F.col(f"__mix_{c}").alias(c) for c in ADDED))


def mix(docs: DataFrame, source: str = "source", text: str = "text", even: float = 0.5, repeats: float | None = 4.0,
        budget: int | None = None, seed: int = 0) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    found = _decided(docs, source, text, even, repeats, budget, seed).filter(F.col("__mix_copies") > 0)
    return found.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)
