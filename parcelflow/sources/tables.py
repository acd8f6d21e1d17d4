"""Reading tables: Parquet folders or a database over JDBC."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class ParquetTables:
    """Tables stored as ``<root>/<name><suffix>``."""

    root: str
    suffix: str = ".parquet"
    schemas: Mapping[str, T.StructType] = field(default_factory=dict)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        reader = spark.read
        if name in self.schemas:
            reader = reader.schema(self.schemas[name])
        return reader.parquet(f"{self.root.rstrip('/')}/{name}{self.suffix}")


@dataclass(frozen=True)
class JdbcTables:
    """Tables of a database, read in parallel slices of a numeric, date or timestamp column.

    ``slices`` maps a table to ``(column, lower, upper, partitions)``. A table without an entry is
    read by one task, which is only right for small ones.
    """

    url: str
    slices: Mapping[str, tuple[str, str, str, int]] = field(default_factory=dict)
    properties: Mapping[str, str] = field(default_factory=dict)
    fetch_size: int = 10_000

    def options(self, name: str) -> dict[str, str]:
        chosen = {
            "url": self.url,
            "dbtable": name,
            "fetchsize": str(self.fetch_size),
            "pushDownPredicate": "true",
            **self.properties,
        }
        if name in self.slices:
            column, lower, upper, partitions = self.slices[name]
            chosen.update(
                partitionColumn=column,
                lowerBound=str(lower),
                upperBound=str(upper),
                numPartitions=str(partitions),
            )
        return chosen

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options(name)).load()


def load_table(spark: SparkSession, source: ParquetTables | JdbcTables, name: str) -> DataFrame:
    """One table, lazily. A missing table is an error, not an empty result."""
    return source.read(spark, name)


def load_tables(
    spark: SparkSession, source: ParquetTables | JdbcTables, names: Iterable[str]
) -> dict[str, DataFrame]:
    return {name: load_table(spark, source, name) for name in names}
