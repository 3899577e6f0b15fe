"""Writing a corpus: whole papers, fragments, manifests. Nothing is written of a paper that its findings fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gated(pieces: DataFrame, gate: DataFrame, paper: str = "paper_id") -> DataFrame:
    """The pieces of papers whose run does not fail."""
    return pieces.join(gate.filter("NOT fails").select(paper), paper, "left_semi")


def write_whole(pieces: DataFrame, path: str, order: str = "doc_ord", paper: str = "paper_id", text: str = "text") -> None:
    """Whole papers: one folder each, whose part files in name order are the paper.

    The rows are range-partitioned by paper and place, so a paper of any size is written by as many tasks as it
    needs and reads back in order; the line end after each row is the newline that joins documents.
    """
    (pieces.repartitionByRange(paper, order).sortWithinPartitions(paper, order)
     .select(paper, F.col(text).alias("value")).write.mode("overwrite").partitionBy(paper).text(path))


def write_fragments(fragments: DataFrame, path: str, paper: str = "paper_id") -> None:
    """One folder per fragment under its paper's; a fragment is a section of one document and one row."""
    (fragments.select(paper, "fragment", F.col("text").alias("value")).repartition(paper, "fragment")
     .write.mode("overwrite").partitionBy(paper, "fragment").text(path))


def write_saved(documents: DataFrame, path: str) -> None:
    documents.select(F.col("json").alias("value")).write.mode("overwrite").text(path)
