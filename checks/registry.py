"""Where queries and their SQL are put side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; dates of its result are shown as text, as the SQL does."""

    def register(query: Query) -> Query:
        def shown(spark: SparkSession, folder: str) -> DataFrame:
            result = query(spark, folder)
            dates = [n for n, kind in result.dtypes if kind == "date"]
            return result.withColumns({n: F.col(n).cast("string") for n in dates})

        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = shown
        if sql is not None:
            SQL[name] = sql
        return query

    return register


def rnd(expression: str, digits: int) -> str:
    """SQL rounding half up on the shortest decimal form of a double, as Spark's ``round`` does."""
    return (
        f"CAST(round(CAST(CAST(CAST({expression} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
