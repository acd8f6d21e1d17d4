"""Vectors as columns: usable components and whole-number forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True if there is a vector without null, NaN or infinite components."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def floored(df: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """``id`` and ``vec``, the components as ``floor(scale * x)`` in doubles' arithmetic, of all usable
    vectors with an id."""
    whole = F.transform(
        F.col(vector).cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c).cast("long")
    )
    return df.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), whole.alias("vec")
    )
