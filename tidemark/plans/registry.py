"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as long, for comparison between engines."""
    def one(c: str, t: str):
        if c in keys:
            return F.col(c)
        if t == "double":
            # adding 0.0 turns -0.0 into 0.0
            return (F.round(c, digits) + F.lit(0.0)).alias(c)
        return F.col(c).cast("long").alias(c) if t == "int" else F.col(c)

    return df.select(*[one(c, t) for c, t in df.dtypes])
