"""Deduplication by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Types whose maximum an aggregate can keep in place, without sorting rows.
PLAIN = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def dedup_latest(df: DataFrame, keys: Sequence[str], recency: Sequence[str]) -> DataFrame:
    """One row per key: the latest by ``recency``, ties settled by the remaining columns, the largest first.

    The latest recency of each key comes from a narrow aggregate, rows that reach it from a join on the
    key, so whole rows are shuffled once, and only what is left, one row for most keys, is put in
    order. Nulls count as oldest, and null keys as equal.
    """
    rest = [c for c in df.columns if c not in keys and c not in recency]
    ranked = df.withColumns({"_key": F.struct(*keys), "_newest": _newest(df, recency)})
    best = ranked.groupBy("_key").agg(F.max("_newest").alias("_best")).hint("shuffle_hash")
    reached = ranked.join(best, "_key").filter(F.col("_newest").eqNullSafe(F.col("_best")))
    order = [F.desc(c) for c in rest] or [F.lit(0)]
    first = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return reached.withColumn("_place", first).filter("_place = 1").select(df.columns)


def _newest(df: DataFrame, recency: Sequence[str]) -> Column:
    """One value that orders like the columns of ``recency``: a plain one for a single column and for two
    dates, else a struct."""
    kinds = dict(df.dtypes)
    if len(recency) == 1 and kinds[recency[0]] in PLAIN:
        return F.col(recency[0])
    if len(recency) == 2 and all(kinds[c] == "date" for c in recency):
        # No date is as early as the number that stands for a missing one.
        first, second = (F.coalesce(F.unix_date(c).cast("long"), F.lit(-(1 << 30))) for c in recency)
        return first * (1 << 32) + second
    return F.struct(*recency)
