"""Lookup joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.session import BROADCAST_BYTES, fits, is_literal, settle

SALT, SALTS = "_salt", "_salts"


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
    parts: int | None = None,
) -> DataFrame:
    """Equi-join of a large ``left`` to a lookup table on one column; null keys never match.

    A ``right`` measured to be small is broadcast, so ``left`` is not shuffled. Otherwise both are
    shuffled, and a key with more rows of ``left`` than one of ``parts`` tasks should get is split over
    several: its rows of ``right`` are repeated for each. Rows without a key are spread. ``right`` is
    evaluated twice, ``left`` too, once for its key alone; have inputs that are costly to compute stored.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    if is_literal(right) or fits(right, max_bytes):
        return left.join(F.broadcast(right), on, how)
    return _salted_join(left, right, on, how, parts or _shuffle_parts(left))


def _shuffle_parts(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _salted_join(left: DataFrame, right: DataFrame, on: str, how: str, parts: int) -> DataFrame:
    hot = hot_keys(left, on, parts)
    kind = T.StructType([T.StructField(on, left.schema[on].dataType), T.StructField(SALTS, T.IntegerType())])
    hot = left.sparkSession.createDataFrame(hot, kind)
    # By the row's content, so that a task that is run again deals its rows out alike.
    content = [c for c, x in zip(left.columns, left.schema) if not _unhashable(x.dataType)]
    spread = F.when(F.col(on).isNull(), parts).otherwise(F.coalesce(SALTS, F.lit(1)))
    given = left.filter(F.col(on).isNotNull()) if how == "inner" else left
    given = given.join(F.broadcast(hot), on, "left")
    given = given.withColumn(SALT, F.pmod(F.xxhash64(*content), spread).cast("int")).drop(SALTS)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(SALTS, F.lit(1)) - 1))
    looked_up = right.join(F.broadcast(hot), on, "left").withColumn(SALT, copies).drop(SALTS)
    columns = [on, *[c for c in left.columns if c != on], *[c for c in right.columns if c != on]]
    return given.join(looked_up, [on, SALT], how).select(columns)


def _unhashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _unhashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unhashable(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def hot_keys(df: DataFrame, on: str, parts: int) -> list[tuple]:
    """Keys that have more rows than a ``parts``-th of all, with the number of such shares they fill; fewer than
    ``parts`` keys, from one pass over the key."""
    counts = df.select(on).rollup(on).agg(F.count(F.lit(1)).alias("n"), F.grouping(on).alias("of_all"))
    known = counts.filter(F.col(on).isNotNull() | (F.col("of_all") == 1))
    most = known.orderBy(F.desc("n"), F.desc("of_all")).limit(parts + 1).collect()
    if not most:
        return []
    total = most[0]["n"]
    return [(row[0], -(-row["n"] * parts // total)) for row in most[1:] if row["n"] * parts > total]


def apply_corrections(
    df: DataFrame, corrections: DataFrame, key: str, column: str, corrected: str
) -> DataFrame:
    """Prefer ``corrections[corrected]`` over ``df[column]`` where the key has one.

    Several corrections of one key are reduced to the largest, so no row of ``df`` is multiplied.
    """
    single = (
        corrections.filter(F.col(corrected).isNotNull())
        .groupBy(key)
        .agg(F.max(corrected).alias("_corrected"))
    )
    joined = lookup_join(df, settle(single), key)
    return (
        joined.withColumn(column, F.coalesce("_corrected", column)).drop("_corrected").select(df.columns)
    )
