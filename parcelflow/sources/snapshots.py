"""Dated snapshots, each of which appears at once.

The files of a snapshot are written to a folder of their own, ``_data/snapshot_date=<day>/<version>``, that
no reader looks at. An empty file ``_days/<day>/<number>-<version>`` then makes it the snapshot of the day;
readers follow the file with the highest number. Until that file is there, and after a write that
failed, they see the version before.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION = "snapshot_date"
# Versions of a day that are kept: the current one, and one that readers may still be at.
KEPT = 2


def write_snapshot(df: DataFrame, root: str, day: dt.date | str, files: int | None = None) -> str:
    """Write ``df`` as the snapshot of ``day`` and return its folder; other days below ``root`` stay untouched.

    A rerun replaces its own day, at once, when all its files are there. ``files`` sets the number of
    output files without moving rows by key, so a hot key cannot make one file large. Versions of the day
    before the last ``KEPT`` are deleted; files of failed writes stay until they are deleted by hand.
    """
    day = str(day)
    dt.date.fromisoformat(day)
    spark, version = df.sparkSession, uuid.uuid4().hex
    folder = _data(root, day, version)
    out = df if files is None else df.repartition(files)
    out.write.parquet(folder)
    before = _versions(spark, root, day)
    number = 1 + (int(before[-1].split("-", 1)[0]) if before else 0)
    system, path = _at(spark, f"{_marks(root)}/{day}/{number:012d}-{version}")
    system.create(path, False).close()
    for mark in before[: max(0, len(before) + 1 - KEPT)]:
        for old in (f"{_marks(root)}/{day}/{mark}", _data(root, day, mark.split("-", 1)[1])):
            system, path = _at(spark, old)
            system.delete(path, True)
    return folder


def _data(root: str, day: str, version: str) -> str:
    return f"{root.rstrip('/')}/_data/{PARTITION}={day}/{version}"


def _marks(root: str) -> str:
    return f"{root.rstrip('/')}/_days"


def _at(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, where: str) -> list[str]:
    """Names below a folder, in order; none if it is not there."""
    system, path = _at(spark, where)
    return sorted(item.getPath().getName() for item in system.listStatus(path)) if system.exists(path) else []


def _versions(spark: SparkSession, root: str, day: str) -> list[str]:
    return [name for name in _names(spark, f"{_marks(root)}/{day}") if name[:1].isdigit()]


def snapshot_days(spark: SparkSession, root: str) -> list[str]:
    """Days that have a snapshot, oldest first: folders are listed, no data is read."""
    return [day for day in _names(spark, _marks(root)) if _versions(spark, root, day)]


def read_snapshot(spark: SparkSession, root: str, day: dt.date | str) -> DataFrame:
    """The snapshot of ``day`` with the day as a column; only its own files are listed and read."""
    versions = _versions(spark, root, str(day))
    if not versions:
        raise FileNotFoundError(f"no snapshot of {day} below {root}")
    folder = _data(root, str(day), versions[-1].split("-", 1)[1])
    return spark.read.parquet(folder).withColumn(PARTITION, F.lit(str(day)).cast("date"))


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot."""
    days = snapshot_days(spark, root)
    if not days:
        raise FileNotFoundError(f"no snapshot below {root}")
    return read_snapshot(spark, root, days[-1])


def all_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The snapshots of all days below each other; a column that a day does not have is null there."""
    days = [read_snapshot(spark, root, day) for day in snapshot_days(spark, root)]
    if not days:
        raise FileNotFoundError(f"no snapshot below {root}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), days)
