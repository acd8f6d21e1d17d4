"""Repair and enrichment rules for listings: DataFrame to DataFrame, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions.dates import days_between, weekday_label
from parcelflow.functions.numeric import bin_label, great_circle_km, ratio

# Defaults of the rules below.
PRICE_FLOOR = 15_000.0
AREA_MISSING = 1.0
AREA_MINIMUM = 100.0
AREA_FACTOR = 100.0
STATUS_DAYS = [(7, "New Offer"), (30, "Active"), (90, "Stale")]
STATUS_LATER = "Old/Negotiable"


def fill_missing(df: DataFrame, column: str, source: str) -> DataFrame:
    """Take ``source`` where ``column`` is null."""
    return df.withColumn(column, F.coalesce(column, source))


def price_floor(df: DataFrame, floor: float = PRICE_FLOOR) -> DataFrame:
    """Prices below ``floor`` are no prices; without a price there is no price per m2."""
    kept = F.when(F.col("PRICE") < floor, None).otherwise(F.col("PRICE"))
    return df.withColumn("PRICE", kept).withColumn(
        "PRICE_M2", F.when(F.col("PRICE").isNotNull(), F.col("PRICE_M2"))
    )


def repaired_area(
    area: Column,
    missing: float = AREA_MISSING,
    minimum: float = AREA_MINIMUM,
    factor: float = AREA_FACTOR,
) -> Column:
    """Area in m2: tiny values are missing, small ones were given in a unit ``factor`` times larger."""
    known = F.when(area <= missing, None).otherwise(area)
    scaled = F.when(known < minimum, known * factor).otherwise(known)
    return F.when(scaled < minimum, None).otherwise(scaled)


def repair_area(df: DataFrame, **limits: float) -> DataFrame:
    """Repair ``AREA_M2``, then derive ``PRICE_M2`` afresh."""
    return df.withColumn("AREA_M2", repaired_area(F.col("AREA_M2"), **limits)).withColumn(
        "PRICE_M2", ratio(F.col("PRICE"), F.col("AREA_M2"))
    )


def unit_price(df: DataFrame, digits: int | None = 2) -> DataFrame:
    return df.withColumn("PRICE_M2", ratio(F.col("PRICE"), F.col("AREA_M2"), digits))


def override_area(df: DataFrame, areas: Mapping[str, float], key: str = "ID") -> DataFrame:
    """Set the area of single listings and derive their price per m2 again."""
    if not areas:
        return df
    pairs = [part for name, area in areas.items() for part in (F.lit(name), F.lit(float(area)))]
    return (
        df.withColumn("_area", F.try_element_at(F.create_map(*pairs), F.col(key)))
        .withColumns(
            {
                "AREA_M2": F.coalesce("_area", "AREA_M2"),
                "PRICE_M2": F.when(
                    F.col("_area").isNotNull(), ratio(F.col("PRICE"), F.col("_area"))
                ).otherwise(F.col("PRICE_M2")),
            }
        )
        .drop("_area")
    )


def order_interval(df: DataFrame, start: str = "DATE_ADDED", end: str = "LAST_UPDATED") -> DataFrame:
    """Swap the two dates where they are reversed; both sides read the old values."""
    reversed_ = F.col(start) > F.col(end)
    return df.withColumns(
        {
            start: F.when(reversed_, F.col(end)).otherwise(F.col(start)),
            end: F.when(reversed_, F.col(start)).otherwise(F.col(end)),
        }
    )


def status(
    days: Column, steps: Sequence[tuple[int, str]] = STATUS_DAYS, later: str = STATUS_LATER
) -> Column:
    """Label of the first step ``days`` does not exceed; also ``later`` for unknown days."""
    label = F
    for limit, name in steps:
        label = label.when(days <= limit, F.lit(name))
    return label.otherwise(F.lit(later))


def market_status(df: DataFrame, start: str = "DATE_ADDED", end: str = "LAST_UPDATED") -> DataFrame:
    return df.withColumn("DAYS_ON_MARKET", days_between(F.col(start), F.col(end))).withColumn(
        "MARKET_STATUS", status(F.col("DAYS_ON_MARKET"))
    )


def add_distance(df: DataFrame, centre: tuple[float, float]) -> DataFrame:
    return df.withColumn("MAIN_CITY_DIST", great_circle_km(F.col("LAT"), F.col("LON"), *centre))


def add_segment(df: DataFrame, breaks: Sequence[float], labels: Sequence[str]) -> DataFrame:
    return df.withColumn("SIZE_SEGMENT", bin_label(F.col("AREA_M2"), breaks, labels))


def add_weekday(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.withColumn("DAY_NAME_PL", weekday_label(F.col("DATE_ADDED"), labels))
