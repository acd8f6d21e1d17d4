"""Declared schemas of the inputs and outputs."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns every prepared source must deliver, with the types they are cast to.
TARGET = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("DATE_ADDED", T.DateType()),
        T.StructField("LAST_UPDATED", T.DateType()),
        T.StructField("AREA_M2", T.DoubleType()),
        T.StructField("PRICE_M2", T.DoubleType()),
        T.StructField("CITY", T.StringType()),
        T.StructField("LAT", T.DoubleType()),
        T.StructField("LON", T.DoubleType()),
        T.StructField("PRICE", T.DoubleType()),
    ]
)

LISTINGS = T.StructType(
    [
        *TARGET.fields,
        T.StructField("SOURCE", T.StringType()),
        T.StructField("DAY_NAME_PL", T.StringType()),
        T.StructField("MAIN_CITY_DIST", T.DoubleType()),
        T.StructField("SIZE_SEGMENT", T.StringType()),
        T.StructField("DAYS_ON_MARKET", T.LongType()),
        T.StructField("MARKET_STATUS", T.StringType()),
    ]
)

DAILY_STATS = T.StructType(
    [
        T.StructField("ACTIVE_DAY", T.DateType()),
        T.StructField("TOTAL_ACTIVE_OFFERS", T.LongType()),
        T.StructField("AVG_PRICE_M2", T.DoubleType()),
        T.StructField("MEDIAN_PRICE_M2", T.DoubleType()),
        T.StructField("MEDIAN_PRICE", T.DoubleType()),
        T.StructField("AVG_PRICE", T.DoubleType()),
        T.StructField("AVG_AREA_M2", T.DoubleType()),
        T.StructField("TOTAL_AREA_ON_MARKET", T.DoubleType()),
        T.StructField("MEDIAN_AREA_M2", T.DoubleType()),
    ]
)

RING = T.ArrayType(
    T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
)

# A region has one outline or the outlines of all its parts and holes.
REGIONS = T.StructType(
    [
        T.StructField("region_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("ring", RING),
        T.StructField("rings", T.ArrayType(RING)),
    ]
)


def mismatches(actual: T.StructType, declared: T.StructType) -> list[str]:
    """Differences in column names, order or types; nullability is not compared."""
    found = [(f.name, f.dataType.simpleString()) for f in actual.fields]
    wanted = [(f.name, f.dataType.simpleString()) for f in declared.fields]
    return [f"{w} expected, {f} found" for f, w in zip(found, wanted) if f != w] + [
        f"{abs(len(found) - len(wanted))} column(s) too {'many' if len(found) > len(wanted) else 'few'}"
        for _ in range(len(found) != len(wanted))
    ]


def require(actual: T.StructType, declared: T.StructType) -> None:
    problems = mismatches(actual, declared)
    if problems:
        raise ValueError("; ".join(problems))
