"""Numeric columns: distance, bins, ratios."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def great_circle_km(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    """Haversine distance to a fixed point; null where a coordinate is null."""
    half_dlat = (F.radians(lat) - F.lit(math.radians(to_lat))) / F.lit(2.0)
    half_dlon = (F.radians(lon) - F.lit(math.radians(to_lon))) / F.lit(2.0)
    chord = F.pow(F.sin(half_dlat), F.lit(2.0)) + F.lit(math.cos(math.radians(to_lat))) * F.cos(
        F.radians(lat)
    ) * F.pow(F.sin(half_dlon), F.lit(2.0))
    # `least` skips nulls, so the clamp must not be what decides the result of a null coordinate.
    clamped = F.when(chord > 1.0, F.lit(1.0)).otherwise(chord)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clamped))


def bin_ordinal(value: Column, breaks: Sequence[float]) -> Column:
    """Index of the right-closed interval ``value`` falls into; null for null and NaN."""
    if list(breaks) != sorted(set(breaks)):
        raise ValueError("breaks must ascend")
    index = F.when(not_nan(value).isNull(), F.lit(None).cast("int"))
    for position, upper in enumerate(breaks):
        index = index.when(value <= F.lit(float(upper)), F.lit(position))
    return index.otherwise(F.lit(len(breaks)))


def bin_label(value: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval: ``(-inf, b0] (b0, b1] ... (bn, inf)``."""
    if len(labels) != len(breaks) + 1:
        raise ValueError("one label more than breaks is needed")
    return F.get(F.array(*[F.lit(name) for name in labels]), bin_ordinal(value, breaks))


def ratio(numerator: Column, denominator: Column, digits: int | None = None) -> Column:
    """Quotient that is null where the denominator is zero or null."""
    quotient = F.try_divide(numerator, denominator)
    return quotient if digits is None else F.round(quotient, digits)


def not_nan(value: Column) -> Column:
    """Null instead of NaN."""
    return F.when(~F.isnan(value), value)
