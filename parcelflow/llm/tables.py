"""Intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parcelflow.session import stored


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into Parquet in the shared folder.

    A checkpoint would hand on the constraints and sizes that Catalyst has derived so far, which grow
    with every round of an iteration; a table read back has neither, and its true size is known.
    """
    return stored(df, "corpus")
