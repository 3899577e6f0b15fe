"""Registered queries and their SQL, collected from the plan modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` as a query, with the SQL that must give the same rows."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return widened(fn(Tables(spark, sf_dir)))
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


class Tables:
    """The given tables, read lazily so that only the columns a query uses are scanned."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def widened(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so that results have one integer type."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select([F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f.name)
                      for f in df.schema])
