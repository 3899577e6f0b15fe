"""Findings tables: one shape, one order, a gate and a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "rule", "severity", "context", "message")


def concatenated(*parts: DataFrame) -> DataFrame:
    """Findings of several rules as one table, with the place of each rule among them."""
    numbered = [p.select(F.lit(i).alias("rule_ord"), *COLUMNS) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, numbered)


def formatted(context: Column, severity: Column, message: Column) -> Column:
    return F.concat_ws(": ", context, severity, message)


def gate(findings: DataFrame, papers: DataFrame, strict: bool = False, paper: str = "paper_id") -> DataFrame:
    """Whether each paper's findings fail its run: an error does, and a warning too when strict.

    ``papers`` maps documents to papers. Findings are reduced to a flag per document before they meet it.
    """
    fatal = F.col("severity").isin("error", "warning") if strict else F.col("severity") == "error"
    flagged = findings.groupBy("doc_id").agg(F.bool_or(fatal).alias("_f"))
    return papers.select(paper, "doc_id").join(flagged, "doc_id", "left").groupBy(paper).agg(
        F.bool_or(F.coalesce("_f", F.lit(False))).alias("fails"))


def report(findings: DataFrame, papers: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Counts by paper, by paper and severity, and over everything."""
    counted = findings.groupBy("doc_id", "severity").agg(F.count("*").alias("_n"))
    return counted.join(papers.select(paper, "doc_id"), "doc_id").rollup(paper, "severity").agg(
        F.sum("_n").alias("n_findings"), F.count("*").alias("n_documents"))
