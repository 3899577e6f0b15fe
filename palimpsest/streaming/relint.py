"""Re-lint what changed: a stream of documents against the hashes of the last runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def changed_documents(batch: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Documents whose text no earlier run has linted under their id; repeats inside the batch are one."""
    fresh = batch.withColumn("content_key", F.sha2("text", 256)).dropDuplicates(["doc_id", "content_key"])
    if seen is None:
        return fresh
    return fresh.join(seen.select("doc_id", "content_key"), ["doc_id", "content_key"], "left_anti")


def relint(spark: SparkSession, documents: DataFrame, lint: Callable[[DataFrame], DataFrame], state: str, findings: str,
           checkpoint: str):
    """Lint a stream of documents, each text once, and append what is found.

    ``lint`` maps documents to findings and looks at one document at a time. A batch that is run again after a
    failure writes the same folders again, so findings and state stay whole.
    """
    def earlier(batch_id: int) -> DataFrame | None:
        try:
            return spark.read.parquet(state).filter(F.col("batch") < batch_id)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def run(batch: DataFrame, batch_id: int) -> None:
        fresh = changed_documents(batch, earlier(batch_id)).persist()
        try:
            lint(fresh).write.mode("overwrite").parquet(f"{findings}/batch={batch_id}")
            fresh.select("doc_id", "content_key").write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        finally:
            fresh.unpersist()

    return (documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
