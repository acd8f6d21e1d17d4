"""Profiles, outlier fences, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.operators.selection import group_quantiles


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows, nulls and non-nulls, from one pass over the table."""
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(name).alias("column"),
                    F.lit(kind).alias("type"),
                    F.count_if(F.col(f"`{name}`").isNull()).alias("nulls"),
                )
                for i, (name, kind) in enumerate(df.dtypes)
            ]
        ).alias("profile"),
    )
    return one.select("rows", F.explode("profile").alias("p")).select(
        "p.*", (F.col("rows") - F.col("p.nulls")).alias("non_nulls")
    )


def table_profile(df: DataFrame) -> DataFrame:
    """One row for the whole table: ``rows``, ``columns`` and the ``profile`` of every column as an array of
    structs (see `null_profile`), from one pass."""
    profile = null_profile(df)
    whole = profile.agg(
        F.max(F.col("nulls") + F.col("non_nulls")).alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.sort_array(F.collect_list(F.struct(*profile.columns))).alias("profile"),
    )
    return whole.select(F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "columns", "profile")


def outlier_fences(
    df: DataFrame,
    column: str,
    keys: Sequence[str] = (),
    k: float = 1.5,
    kind: str = "nearest",
    strategy: str = "auto",
) -> DataFrame:
    """Quartiles and the fences ``k`` interquartile ranges outside them, per group of ``keys``."""
    quartiles = group_quantiles(df, keys, [column], {"q1": 0.25, "q3": 0.75}, kind, strategy)
    q1, q3 = F.col(f"{column}_q1"), F.col(f"{column}_q3")
    return quartiles.select(
        *keys,
        q1.alias("q1"),
        q3.alias("q3"),
        (q1 - F.lit(k) * (q3 - q1)).alias("lower"),
        (q3 + F.lit(k) * (q3 - q1)).alias("upper"),
    )


def is_outlier(value: Column, lower: Column, upper: Column) -> Column:
    return (value < lower) | (value > upper)


def fences_column(fences: DataFrame) -> Column:
    """The single row of ungrouped `outlier_fences` as a struct, usable in any expression."""
    return fences.select(F.struct("lower", "upper")).scalar()


def outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows outside the fences of the whole table."""
    return (
        df.withColumn("_fence", fences_column(outlier_fences(df, column, k=k)))
        .filter(is_outlier(F.col(column), F.col("_fence.lower"), F.col("_fence.upper")))
        .drop("_fence")
    )


def correct_unit_errors(
    df: DataFrame,
    column: str,
    text: str,
    pattern: str = "(?i)ar",
    divisor: float = 10.0,
    k: float = 1.5,
) -> DataFrame:
    """Divide outliers whose text names another unit. The correction depends on nothing but the
    row and the two fences, so no join back by key is needed."""
    wrong = is_outlier(F.col(column), F.col("_fence.lower"), F.col("_fence.upper")) & F.coalesce(
        F.col(text).rlike(pattern), F.lit(False)
    )
    return (
        df.withColumn("_fence", fences_column(outlier_fences(df, column, k=k)))
        .withColumn(column, F.when(wrong, F.col(column) / F.lit(divisor)).otherwise(F.col(column)))
        .drop("_fence")
    )


def unresolved(df: DataFrame, probe: str, shown: str) -> DataFrame:
    """Distinct values of ``shown`` in rows whose lookup left ``probe`` null."""
    return df.filter(F.col(probe).isNull()).select(shown).distinct()
