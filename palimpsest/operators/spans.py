"""Annotated text: span tables, substitution, edits, masks. Offsets are characters, 0-based, end exclusive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import vocabulary as V
from palimpsest.functions import text as X

# Runs of one mark that set text apart and are not wording (fixed value).
TYPESETTING = "\\*\\*\\*|%%%|###|\\$\\$\\$|&&&"


def without_typesetting(text: Column | str) -> Column:
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, TYPESETTING, "")


def content_groups(df: DataFrame, text: str, owner: str) -> DataFrame:
    """Texts equal but for their typesetting, under one key; spellings are deduplicated before they meet."""
    spelled = df.groupBy(text).agg(F.count("*").alias("_n"), F.min(owner).alias("_o"))
    return spelled.groupBy(F.md5(without_typesetting(text).cast("binary")).alias("content_key")).agg(
        F.sum("_n").alias("n_lines"), F.count("*").alias("n_spellings"), F.min("_o").alias("first_doc"))


def span_findings(spans: DataFrame, keys: Sequence[str], length: str = "length") -> DataFrame:
    """Inverted spans, spans past the end of their text, and spans that begin before their neighbour ends."""
    order = Window.partitionBy(*keys).orderBy("span_ord")
    s = (spans.withColumn("_i", F.row_number().over(order) - 1)
         .withColumn("_prev", F.lag("end").over(order)))
    found = F.array_compact(F.array(
        F.when(F.col("begin") > F.col("end"), F.struct(
            F.lit("inverted").alias("defect"), X.template(V.SPAN_INVERTED, F.col("_i"), F.col("begin"), F.col("end"))
            .alias("message"))),
        F.when(F.col("end") > F.col(length), F.struct(
            F.lit("past_end").alias("defect"), X.template(V.SPAN_PAST_END, F.col("_i"), F.col("end"), F.col(length))
            .alias("message"))),
        F.when(F.col("begin") < F.col("_prev"), F.struct(
            F.lit("overlap").alias("defect"),
            X.template(V.SPAN_OVERLAP, F.col("_i"), F.col("begin"), F.col("_i") - 1, F.col("_prev")).alias("message")))))
    return s.select(*keys, "span_ord", F.explode(found).alias("_f")).select(*keys, "span_ord", "_f.defect", "_f.message")


def valid_spans(spans: DataFrame, keys: Sequence[str], length: str = "length") -> DataFrame:
    """The spans a left-to-right walk takes: whole, inside the text, and not before the end of one already taken.

    A span that begins at or after the end of every earlier one is always taken, so the walk starts afresh there
    and only the few spans that overlap one another are folded together.
    """
    sound = spans.filter((F.col("begin") <= F.col("end")) & (F.col("end") <= F.col(length)) & (F.col("begin") >= 0))
    order = Window.partitionBy(*keys).orderBy("begin", "span_ord")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cluster = F.sum(F.when(F.col("begin") >= F.coalesce(reach, F.lit(0)), 1).otherwise(0)).over(order)
    rest = [c for c in spans.columns if c not in (*keys, "begin", "end", "span_ord")]
    listed = sound.withColumn("_k", cluster).groupBy(*keys, "_k").agg(F.array_sort(F.collect_list(
        F.struct("begin", "span_ord", "end", *rest))).alias("_s"))
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.filter("_s", lambda s: F.lit(False)).alias("out"))
    taken = F.aggregate("_s", start, lambda acc, s: F.when(
        s["begin"] >= acc["pos"],
        F.struct(s["end"].cast("bigint").alias("pos"), F.concat(acc["out"], F.array(s)).alias("out"))
    ).otherwise(acc), lambda acc: acc["out"])
    chosen = F.when(F.size("_s") == 1, F.col("_s")).otherwise(taken)
    return listed.select(*keys, F.explode(chosen).alias("_t")).select(*keys, "_t.*")


def splice(text: Column, spans: Column, replace: Callable[[Column, Column], Column]) -> Column:
    """A text with ordered, disjoint spans of its row replaced. ``replace`` gets a span and the text it covers."""
    def stop(i):
        return F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)).cast("int")

    def piece(span, i):
        begin, end = span["begin"].cast("int"), span["end"].cast("int")
        return F.concat(F.substring(text, stop(i) + 1, begin - stop(i)), replace(span, F.substring(text, begin + 1, end - begin)))

    tail = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)).cast("int") + 1
    return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, tail, F.length(text)))


@F.pandas_udf(T.StringType())
def spliced(text: pd.Series, begin: pd.Series, end: pd.Series, replacement: pd.Series) -> pd.Series:
    """Texts with the parts at ordered, disjoint places replaced, each in one pass: a column finds a place from the start."""
    def one(whole, begins, ends, by):
        if whole is None or any(value is None for value in by):
            return None
        parts, at = [], 0
        for b, e, new in zip(begins.tolist(), ends.tolist(), by):
            parts += [whole[at:b], new]
            at = e
        return "".join([*parts, whole[at:]])
    return pd.Series([None if b is None else one(t, b, e, r) for t, b, e, r in zip(text, begin, end, replacement)], dtype=object)


def substitute(texts: DataFrame, spans: DataFrame, keys: Sequence[str], replace: Callable[[Column, Column], Column],
               text: str = "text", length: str = "length") -> DataFrame:
    """Each text with its valid spans replaced; what is between them is kept as it is.

    The spans of a text meet it as one list, so a text is shuffled once however many spans it has.
    """
    rest = [c for c in spans.columns if c not in (*keys, "begin", "end", "span_ord")]
    listed = valid_spans(spans, keys, length).groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("begin", "span_ord", "end", *rest))).alias("_s"))
    joined = texts.join(listed, list(keys), "left")
    return joined.withColumn(text, F.when(F.col("_s").isNull(), F.col(text)).otherwise(
        splice(F.col(text), F.col("_s"), replace))).drop("_s")


def apply_edits(texts: DataFrame, edits: DataFrame, keys: Sequence[str], text: str = "text"
                ) -> tuple[DataFrame, DataFrame]:
    """Texts with their edits applied, and the edits that stop a text being edited.

    Equal edits are one. A text with an edit that overlaps one before it, is inverted or runs past the end is
    rejected whole. A text's edits meet it as one list and are weighed in the row.
    """
    listed = edits.select(*keys, "begin", "end", "replacement").distinct().groupBy(*keys).agg(F.array_sort(
        F.collect_list(F.struct("begin", "end", "replacement"))).alias("_e"))
    joined = texts.join(listed, list(keys), "left")
    start = F.struct(F.lit(0).cast("bigint").alias("reach"), F.filter("_e", lambda e: F.lit(False)).alias("bad"))
    # A list of one binds the length to a variable: it is counted once, not again for every edit.
    weighed = F.get(F.transform(F.array(F.length(text)), lambda whole: F.aggregate("_e", start, lambda acc, e: F.struct(
        F.greatest(acc["reach"], e["end"].cast("bigint")).alias("reach"),
        F.when((e["begin"] < acc["reach"]) | (e["end"] < e["begin"]) | (e["end"] > whole),
               F.array_append(acc["bad"], e)).otherwise(acc["bad"]).alias("bad")), lambda acc: acc["bad"])), 0)
    flagged = joined.withColumn("_bad", weighed)
    rejects = flagged.select(*keys, F.explode("_bad").alias("_z")).select(
        *keys, F.col("_z.begin").alias("begin"), F.col("_z.end").alias("end")).withColumn(
        "message", X.template(V.EDIT_OVERLAP, F.col("begin"), F.col("end")))
    good = flagged.filter(F.col("_e").isNull() | (F.size("_bad") == 0)).withColumn(
        text, F.when(F.col("_e").isNull(), F.col(text)).otherwise(
            spliced(F.col(text), F.transform("_e", lambda e: e["begin"].cast("int")), F.transform("_e", lambda e: e["end"].cast("int")),
                    F.col("_e")["replacement"])))
    return good.drop("_e", "_bad"), rejects


def back_to_front(edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct edits of each text as one list, the last in the text first."""
    listed = edits.select(*keys, "begin", "end").distinct().groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("begin", "end")), asc=False).alias("edits"))
    return listed


def drop_dominated(edits: DataFrame, dominant: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edits that no dominant edit of their text overlaps.

    An edit is overlapped when, of the dominant ones that begin before its end, the furthest reaching ends behind its
    begin. Both kinds of a text are one ordered sequence, so that is a running maximum and no pair of them is made.
    """
    columns = edits.columns
    asked = edits.select(F.col("end").alias("_at"), F.lit(0).alias("_d"), F.lit(None).cast("bigint").alias("_reach"), *columns)
    ruling = dominant.select(F.col("begin").alias("_at"), F.lit(1).alias("_d"), F.col("end").cast("bigint").alias("_reach"),
                             *[F.col(c) if c in keys else F.lit(None).cast(edits.schema[c].dataType).alias(c) for c in columns])
    before = Window.partitionBy(*keys).orderBy("_at", "_d").rowsBetween(Window.unboundedPreceding, -1)
    return asked.unionByName(ruling).withColumn("_max", F.max("_reach").over(before)).filter(
        (F.col("_d") == 0) & (F.col("_max").isNull() | (F.col("_max") <= F.col("begin")))).select(*columns)


def shift_offsets(points: DataFrame, edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where an old offset is after the edits: every edit that ends at or before it moves it.

    Edits and points of a text are one ordered sequence, so the sum is a running one and no pair of them is made.
    """
    moves = edits.select(*keys, F.col("end").alias("_at"), F.lit(0).alias("_point"),
                         (F.length("replacement") - (F.col("end") - F.col("begin"))).cast("bigint").alias("_delta"),
                         F.lit(None).cast("bigint").alias("_old"))
    asked = points.select(*keys, F.col("offset").alias("_at"), F.lit(1).alias("_point"),
                          F.lit(0).cast("bigint").alias("_delta"), F.col("offset").alias("_old"))
    order = Window.partitionBy(*keys).orderBy("_at", "_point").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (moves.unionByName(asked).withColumn("_sum", F.sum("_delta").over(order)).filter("_point = 1")
            .select(*keys, F.col("_old").alias("offset"), (F.col("_old") + F.col("_sum")).alias("moved")))


def spans_in_runs(spans: DataFrame, runs: DataFrame, keys: Sequence[str], bin_size: int = 4096) -> DataFrame:
    """Spans that stand whole inside a changed run; those that straddle an edge are left out.

    A run lists the bins of its text it reaches into and a span looks in the bin it begins in, so spans meet only the
    runs near them.
    """
    r = runs.filter("begin <= end").select(
        *keys, F.col("begin").alias("run_begin"), F.col("end").alias("run_end"), "change", F.explode(F.sequence(
            F.floor(F.col("begin") / bin_size), F.floor(F.col("end") / bin_size))).alias("_bin"))
    s = spans.withColumn("_bin", F.floor(F.col("begin") / bin_size))
    return s.join(r, [*keys, "_bin"]).filter(
        (F.col("begin") >= F.col("run_begin")) & (F.col("end") <= F.col("run_end")) & (F.col("begin") <= F.col("end"))).drop("_bin")


def mask(texts: DataFrame, spans: DataFrame, keys: Sequence[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Spans replaced by placeholders the text does not hold, and the table that gives them back.

    A placeholder opens with one U+0001 more than the longest run of them in the text, then the number of the span and
    U+0002, so it occurs nowhere in the text whatever that holds, and every span of every text is masked.
    """
    runs = F.transform(F.regexp_extract_all(F.col(text), F.lit("\u0001+"), F.lit(0)), lambda r: F.length(r))
    opener = F.repeat(F.lit("\x01"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)

    def placeholder(opened, number):
        return F.concat(opened, number.cast("string"), F.lit("\x02"))

    listed = valid_spans(spans, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("begin", "span_ord", "end"))).alias("_s"))
    table = texts.select(*keys, F.col(text).alias("_text"), opener.alias("_opener")).join(listed, list(keys)).select(
        *keys, F.explode(F.transform("_s", lambda s: F.struct(
            placeholder(F.col("_opener"), s["span_ord"]).alias("placeholder"), F.substring(
                F.col("_text"), s["begin"].cast("int") + 1, (s["end"] - s["begin"]).cast("int")).alias("payload")))).alias("_p"))
    opened = spans.join(texts.select(*keys, opener.alias("_opener")), list(keys))
    masked = substitute(texts, opened, keys, lambda span, covered: placeholder(span["_opener"], span["span_ord"]), text)
    return masked, table.select(*keys, "_p.placeholder", "_p.payload")


def recover(masked: DataFrame, table: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Masked texts with every placeholder replaced by what it stands for."""
    payloads = table.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("placeholder", "payload"))).alias("_m"),
        F.regexp_extract(F.min("placeholder"), "^(\u0001+)", 1).alias("_opener"))
    one = F.concat("_opener", F.lit("[0-9]+\u0002"))
    parts = F.regexp_extract_all(F.col(text), F.concat(one, F.lit("|(?s:(?!"), one, F.lit(").)+")), F.lit(0))
    filled = F.transform(parts, lambda p: F.coalesce(F.try_element_at("_m", p), p))
    return masked.join(payloads, list(keys), "left").withColumn(
        text, F.when(F.col("_m").isNull(), F.col(text)).otherwise(F.array_join(filled, ""))).drop("_m", "_opener")
