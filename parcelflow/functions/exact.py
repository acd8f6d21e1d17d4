"""Doubles taken apart into whole numbers, without user functions: exact sums and sortable keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A bucket of `add_limbs` spans so many powers of two; its numbers are split into a high and a low limb.
BUCKET_BITS = 32
LIMB_BITS = 44
LIMB = "decimal(18,0)"
# The bucket of infinite numbers, which are only counted.
INFINITE = 99

# Bits of the fraction of a double, and the smallest exponent of one with all of them.
FRACTION_BITS = 52
LEAST_EXPONENT = -1022


def _scaled(value: Column, exponent: Column) -> Column:
    """``value * 2 ** exponent``, exact as long as the result is; in two steps, each in range."""
    half = F.floor(exponent / 2)
    return value * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), exponent - half)


def _exponent(size: Column) -> Column:
    """Power of two at or below a positive number, too large or small by one at most."""
    return F.floor(F.log2(size)).cast("int")


def add_limbs(df: DataFrame, value: str) -> DataFrame:
    """``bucket``, ``hi`` and ``lo``: ``value`` is ``(hi * 2 ** LIMB_BITS + lo) * 2 ** (BUCKET_BITS * bucket)``
    exactly. Limbs of one bucket may be added in any order. All three are null for null and NaN; an
    infinite number is 1 in ``hi`` or, if negative, in ``lo`` of a bucket of its own."""
    number, size = F.col("_number"), F.abs("_number")
    infinite, plain = size == float("inf"), (size > 0) & (size < float("inf"))
    # Two bits more than the fraction, as the exponent may be off by one.
    bucket = F.floor((_exponent(size) - FRACTION_BITS - 2) / BUCKET_BITS).cast("int")
    bucket = F.when(plain, bucket).when(infinite, INFINITE).when(number == 0, 0)
    whole = F.when(plain, _scaled(number, -F.col("bucket") * BUCKET_BITS))
    high = F.floor(F.col("_whole") / 2.0**LIMB_BITS)
    low = F.col("_whole") - F.col("_high").cast("double") * 2.0**LIMB_BITS
    # Each step is a column of its own, so that none is worked out again for every use.
    return (
        df.withColumn("_number", F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")))
        .withColumn("bucket", bucket)
        .withColumn("_whole", whole)
        .withColumn("_high", high)
        .withColumns(
            {
                "hi": F.when(plain, F.col("_high")).otherwise((number == float("inf")).cast("int")).cast(LIMB),
                "lo": F.when(plain, low).otherwise((number == float("-inf")).cast("int")).cast(LIMB),
            }
        )
        .drop("_number", "_whole", "_high")
    )


def total(sums: Column) -> Column:
    """The double of an array of summed limbs, one struct for each bucket; null for an empty array.

    Each bucket is rounded once, and buckets are added from the smallest on, so the same sums always give
    the same double, however they were come by.
    """

    def rounded(one: Column) -> Column:
        whole = one["hi"].cast("decimal(38,0)") * F.lit(1 << LIMB_BITS).cast("decimal(14,0)") + one["lo"]
        return _scaled(whole.cast("double"), one["bucket"] * BUCKET_BITS)

    finite = F.filter(sums, lambda one: one["bucket"] != INFINITE)
    infinite = F.filter(sums, lambda one: one["bucket"] == INFINITE)
    added = F.aggregate(F.array_sort(finite), F.lit(0.0), lambda x, one: x + rounded(one))
    up = F.exists(infinite, lambda one: one["hi"] > 0)
    down = F.exists(infinite, lambda one: one["lo"] > 0)
    return (
        F.when(up & down, float("nan"))
        .when(up, float("inf"))
        .when(down, float("-inf"))
        .when(F.size(sums) > 0, added)
    )


def add_sortable(df: DataFrame, value: str, key: str) -> DataFrame:
    """``key``, a long that orders like the double ``value``: its bits, counted down for negative numbers. Null
    for null and NaN; both zeros are 0."""
    number, size, power = F.col("_number"), F.abs("_number"), F.col("_power")
    infinite, small = size == float("inf"), size < 2.0**LEAST_EXPONENT
    near = F.when(~infinite & ~small, _exponent(size))
    share = _scaled(size, -F.col("_near"))
    off = F.when(share >= 2, 1).when(share < 1, -1).otherwise(0)
    bits = (power - LEAST_EXPONENT).cast("long") * (1 << FRACTION_BITS) + _scaled(
        size, FRACTION_BITS - power
    ).cast("long")
    bits = (
        F.when(infinite, 2047 << FRACTION_BITS)
        .when(small, _scaled(size, F.lit(FRACTION_BITS - LEAST_EXPONENT)).cast("long"))
        .otherwise(bits)
    )
    return (
        df.withColumn("_number", F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")))
        .withColumn("_near", near)
        .withColumn("_power", F.col("_near") + off)
        .withColumn("_bits", bits)
        .withColumn(key, F.when(number < 0, -F.col("_bits")).otherwise(F.col("_bits")))
        .drop("_number", "_near", "_power", "_bits")
    )


def from_sortable(key: Column) -> Column:
    """The double of a key of `add_sortable`."""
    size = F.abs(key)
    power = F.greatest(F.shiftright(size, FRACTION_BITS), F.lit(1))
    fraction = size - (power - 1) * (1 << FRACTION_BITS)
    number = _scaled(
        fraction.cast("double"), (power - 1).cast("int") + (LEAST_EXPONENT - FRACTION_BITS)
    )
    number = F.when(power == 2047, float("inf")).otherwise(number)
    return F.when(key < 0, -number).otherwise(number)
