"""Small tables given in code: gazetteers, ordered categories, regions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parcelflow import schemas

GAZETTEER = T.StructType(
    [
        T.StructField("priority", T.IntegerType()),
        T.StructField("CITY", T.StringType()),
        T.StructField("LAT", T.DoubleType()),
        T.StructField("LON", T.DoubleType()),
    ]
)


def parse_gazetteer(text: str, normalise: bool = True) -> list[tuple[int, str, float, float]]:
    """Rows ``(priority, name, lat, lon)`` from lines ``name; lat; lon``.

    A name given twice keeps its first place in the order and its last coordinates. ``normalise``
    turns names into upper case, as listings spell them after cleaning.
    """
    places: dict[str, tuple[float, float]] = {}
    for line in filter(str.strip, text.splitlines()):
        name, lat, lon = (part.strip() for part in line.split(";"))
        places[name.upper() if normalise else name] = (float(lat), float(lon))
    return [(i, name, lat, lon) for i, (name, (lat, lon)) in enumerate(places.items())]


def gazetteer_frame(spark: SparkSession, rows: Sequence[tuple[int, str, float, float]]) -> DataFrame:
    return dimension_frame(spark, rows, GAZETTEER, key="CITY")


def dimension_frame(
    spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType, key: str
) -> DataFrame:
    """DataFrame of literal rows; a repeated key would multiply rows in a join and is refused."""
    rows = list(rows)
    position = schema.fieldNames().index(key)
    keys = [row[position] for row in rows]
    repeated = sorted({str(k) for k in keys if keys.count(k) > 1}) if len(set(keys)) < len(keys) else []
    if repeated:
        raise ValueError(f"repeated {key}: {', '.join(repeated)}")
    # From Arrow the rows become part of the plan instead of a distributed scan.
    columns = {name: [row[i] for row in rows] for i, name in enumerate(schema.fieldNames())}
    return spark.createDataFrame(pa.table(columns), schema)


def ordered_categories(spark: SparkSession, names: Sequence[str], column: str) -> DataFrame:
    """Categories with their position in ``ordinal``."""
    schema = T.StructType(
        [T.StructField(column, T.StringType()), T.StructField("ordinal", T.IntegerType())]
    )
    return dimension_frame(spark, [(n, i) for i, n in enumerate(names)], schema, key=column)


def read_regions(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Regions in longitude and latitude, Parquet or JSON: ``region_id``, ``name`` and ``ring`` (one outline)
    or ``rings`` (of all parts and holes); the column that a file does not have is null."""
    return spark.read.schema(schemas.REGIONS).format(kind).load(path)
