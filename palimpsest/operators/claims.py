"""Authored claims against derived evidence, alias substitution, complementary conjuncts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as X
from palimpsest.session import checkpointed

ITEM = ("doc_id", "node_id")


def _truth(column):
    return F.when(column, "true").otherwise("false")


def audit_claims(claims: DataFrame, evidence: DataFrame, keys: Sequence[str] = ITEM) -> DataFrame:
    """Each claim with the evidence of its item, kind and subject: one match of the same polarity, or a finding.

    ``claims``: keys, kind, subject, polarity (NULL when unreadable), ord. ``evidence``: keys, kind, subject,
    polarity. Only the first claim for a subject counts. ``verdict`` is covered or says what is wrong.
    """
    on = [*keys, "kind", "subject"]
    bad = (F.col("polarity").isNull() | ~F.col("kind").isin("constraints", "mandates"))
    nth = F.row_number().over(Window.partitionBy(*on, "_bad").orderBy("ord"))
    matched = evidence.groupBy(*on).agg(F.count("*").alias("matches"), F.bool_or("polarity").alias("_truth"))
    judged = (claims.withColumn("_bad", bad).withColumn("_nth", nth).join(matched, on, "left")
              .withColumn("matches", F.coalesce("matches", F.lit(0))))
    verdict = (F.when(F.col("_bad"), "invalid").when(F.col("_nth") > 1, "duplicate")
               .when(F.col("matches") != 1, "unmatched").when(F.col("_truth") != F.col("polarity"), "wrong_polarity")
               .otherwise("covered"))
    message = (F.when(F.col("verdict") == "invalid", V.CLAIM_INVALID)
               .when(F.col("verdict") == "duplicate", X.template(V.CLAIM_DUPLICATE, F.col("subject")))
               .when(F.col("verdict") == "unmatched", X.template(V.CLAIM_MATCHES, F.col("subject"), F.col("matches")))
               .when(F.col("verdict") == "wrong_polarity", X.template(V.CLAIM_POLARITY, F.col("subject"))))
    return judged.withColumn("verdict", verdict).withColumn("message", message).drop("_bad", "_nth", "_truth", "matches")


def drift(evidence: DataFrame, readings: DataFrame, keys: Sequence[str] = ITEM) -> DataFrame:
    """Authored readings that repeat or contradict the evidence of their kind; a contradiction is preferred.

    ``evidence``: keys, kind, subject, polarity, derived. ``readings``: keys, kind, subject, polarity.
    """
    on = [*keys, "kind", "subject"]
    read = readings.filter("polarity IS NOT NULL").groupBy(*on).agg(
        F.bool_or("polarity").alias("_says_true"), F.bool_or(~F.col("polarity")).alias("_says_false"))
    both = evidence.filter("polarity IS NOT NULL").join(read, on)
    against = F.when(F.col("polarity"), F.col("_says_false")).otherwise(F.col("_says_true"))
    message = F.when(against, X.template(V.CONTRADICTS_EVIDENCE, F.col("kind"), F.col("subject"), _truth(F.col("polarity")),
                                         _truth(~F.col("polarity")))).otherwise(
        X.template(V.DUPLICATES_EVIDENCE, F.col("kind"), F.col("subject")))
    return both.filter(against | F.col("derived")).select(
        *keys, F.lit("warning").alias("severity"), F.col("kind").alias("context"), message.alias("message"))


def missing_counterparts(evidence: DataFrame, readings: DataFrame, covered: DataFrame,
                         keys: Sequence[str] = ITEM) -> DataFrame:
    """Evidence that no reading anywhere in its item and no valid claim of its kind speaks to."""
    read = readings.filter("polarity IS NOT NULL").select(*keys, "subject").distinct()
    claimed = covered.filter("verdict = 'covered'").select(*keys, "kind", "subject", "polarity").distinct()
    return (evidence.filter("polarity IS NOT NULL").join(read, [*keys, "subject"], "left_anti")
            .join(claimed, [*keys, "kind", "subject", "polarity"], "left_anti")
            .select(*keys, F.lit("note").alias("severity"), F.col("kind").alias("context"),
                    X.template(V.NO_COUNTERPART, F.col("subject"), F.col("kind")).alias("message")))


def resolve_aliases(aliases: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """What each alias stands for in the end. An alias introduced twice is none; one on a cycle yields nothing.

    ``aliases``: keys, alias, value. Each round every alias takes over its target's target, so a chain of n links
    takes log2(n) rounds. The number of rounds comes from the largest alias count of a document, and each round is
    cut off in the checkpoint folder so that the plan does not double.
    """
    once = aliases.groupBy(*keys, "alias").agg(F.count("*").alias("_n"), F.first("value").alias("value")).filter("_n = 1")
    current = checkpointed(once.select(*keys, "alias", "value"))
    longest = current.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    for _ in range(max(longest, 1).bit_length()):
        ahead = current.select(*keys, F.col("alias").alias("value"), F.col("value").alias("_next"))
        current = checkpointed(current.join(ahead, [*keys, "value"], "left").select(
            *keys, "alias", F.coalesce("_next", "value").alias("value")))
    names = current.select(*keys, F.col("alias").alias("value"))
    return current.join(names, [*keys, "value"], "left_anti").select(*keys, "alias", "value")


_TOKEN = r'"(?:[^"\\\\]|\\\\.)*"|[A-Za-z0-9_]+|::|[^A-Za-z0-9_ \t\r\n]'


def expression_tokens(text: Column | str) -> Column:
    """Tokens of an expression as (t, name), without white space and without the ``std::`` a name may open with.

    ``name`` marks what an alias may stand for: an identifier that no ``::`` is beside.
    """
    raw = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(_TOKEN), F.lit(0))

    def at(tokens, i):
        return F.when(i >= 0, F.get(tokens, i))

    def opens(tokens, i):
        """A standard qualifier stands at i: at the head of a chain, or behind a leading ``::``."""
        return F.coalesce((at(tokens, i) == "std") & (at(tokens, i + 1) == "::"), F.lit(False)) & (
            F.coalesce(at(tokens, i - 1) != "::", F.lit(True)) | (i == 1))
    def kept(tokens):
        return F.filter(tokens, lambda t, i: ~opens(tokens, i) & ~opens(tokens, i - 1) & ~((i == 0) & (t == "::") & opens(tokens, i + 1)))

    def named(tokens):
        return F.transform(tokens, lambda t, i: F.struct(t.alias("t"), (
            t.rlike("^[A-Za-z0-9_]+$") & F.coalesce(at(tokens, i - 1) != "::", F.lit(True))
            & F.coalesce(at(tokens, i + 1) != "::", F.lit(True))).alias("name")))
    # A list of one binds the tokens to a variable: they are cut once, not again for every neighbour that is looked at.
    return F.get(F.transform(F.transform(F.array(raw), kept), named), 0)


def _spelled(tokens: Column, known: Column) -> Column:
    """Tokens as text, names that ``known`` has replaced; a blank parts what would run together."""
    def step(out, x):
        said = F.when(x["name"], F.coalesce(F.try_element_at(known, x["t"]), x["t"])).otherwise(x["t"])
        apart = out.rlike("[A-Za-z0-9_]$") & x["t"].rlike("^[A-Za-z0-9_]")
        return F.concat(out, F.when(apart, " ").otherwise(""), said)
    return F.aggregate(tokens, F.lit(""), step)


def expand_expressions(expressions: DataFrame, aliases: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``expressions`` (keys, expr_id, text) with ``expanded``: all aliases in it replaced, to the end, all at once.

    ``aliases``: keys, alias, value. An alias introduced twice is none. One that hangs on a cycle has no expansion, and an
    expression that names it stays as written. Rows whose key is NULL introduce none. Each round settles the aliases whose own names are all settled, so there are
    as many rounds as aliases stand on one another.
    """
    keys = list(keys)
    once = aliases.dropna(subset=keys).groupBy(*keys, "alias").agg(
        F.count("*").alias("_n"), F.first("value").alias("value")).filter("_n = 1")
    given = checkpointed(once.select(*keys, "alias", expression_tokens("value").alias("_t")))
    names = given.select(*keys, F.col("alias").alias("ref"))

    def refs(df: DataFrame, own: str) -> DataFrame:
        """The aliases that each row names."""
        used = F.array_distinct(F.transform(F.filter("_t", lambda x: x["name"]), lambda x: x["t"]))
        return df.select(*keys, own, F.explode(used).alias("ref")).join(names, [*keys, "ref"], "left_semi")

    def replaced(df: DataFrame, own: str, wanted: DataFrame, settled: DataFrame) -> DataFrame:
        """Rows all of whose names are settled, with their text."""
        met = wanted.join(settled.select(*keys, F.col("alias").alias("ref"), "text"), [*keys, "ref"], "left").groupBy(*keys, own).agg(
            F.map_from_entries(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ref", "text")))).alias("_m"),
            F.bool_and(F.col("text").isNotNull()).alias("_all"))
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        joined = df.join(met, [*keys, own], "left").filter(F.coalesce("_all", F.lit(True)))
        return joined.select(*keys, own, _spelled(F.col("_t"), F.coalesce("_m", none)).alias("text"))
    wanted = checkpointed(refs(given, "alias"))
    settled = checkpointed(given.limit(0).select(*keys, "alias", F.lit("").alias("text")))
    while True:
        pending = given.join(settled, [*keys, "alias"], "left_anti")
        more = checkpointed(replaced(pending, "alias", wanted.join(settled.select(*keys, "alias"), [*keys, "alias"], "left_anti"), settled))
        if more.isEmpty():
            break
        settled = checkpointed(settled.unionByName(more))
    cut = expressions.select(*keys, "expr_id", expression_tokens("text").alias("_t"))
    out = replaced(cut, "expr_id", refs(cut, "expr_id"), settled).withColumnRenamed("text", "expanded")
    return expressions.join(out, [*keys, "expr_id"], "left").withColumn("expanded", F.coalesce("expanded", "text"))


def drop_complementary(conjuncts: DataFrame, twins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Conjuncts whose merged twin does not hold their negation. Both: keys, subject, polarity."""
    negated = twins.select(*keys, "subject", (~F.col("polarity")).alias("polarity")).distinct()
    return conjuncts.join(negated, [*keys, "subject", "polarity"], "left_anti")
