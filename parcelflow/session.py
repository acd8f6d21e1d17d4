"""Session settings and the helpers that decide what may be broadcast or written down."""

from __future__ import annotations

import functools
import tempfile
import uuid

from collections.abc import Callable
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Narrow rows are broadcast only after they have been counted to be no more than this, other sides of a join
# only after their bytes have been.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024

# What a row and a value take up besides the bytes of texts.
ROW_BYTES = 32
VALUE_BYTES = 8

# Frees the shuffled files of a query when it ends, not when the driver next collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Tables that the running ``passing`` function has stored, with their paths; None outside of one.
_PASSING: ContextVar[list[tuple[DataFrame, str]] | None] = ContextVar("passing", default=None)

# Inputs that Catalyst estimates below this size may use aggregates that hold a group in one task.
SMALL_BYTES = 1024 * 1024


def build_session(master: str | None = None, app: str = "parcelflow", **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for. Values in ``conf`` win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        # Recording the Python call site of every column expression slows down building plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="parcelflow-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage through a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back, for inputs that are costly to compute
    and read several times with few of their columns."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    if (made := _PASSING.get()) is not None:
        made.append((table, path))
    return table


def passing(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``make`` with its result stored, and the tables that it stored on the way deleted."""

    @functools.wraps(make)
    def run(*args, **options) -> DataFrame:
        made: list[tuple[DataFrame, str]] = []
        around = _PASSING.get()
        token = _PASSING.set(made)
        try:
            result = make(*args, **options)
            at = next((i for i, (table, _) in enumerate(made) if table is result), None)
            if at is None:
                result, at = stored(result, make.__name__), -1
            own = made.pop(at)
            if around is not None:
                around.append(own)
            return result
        finally:
            _PASSING.reset(token)
            _delete(made)

    return run


def discard(*tables: DataFrame) -> None:
    """Delete tables that the running ``passing`` function has stored and does not read any more; others
    are left alone."""
    made = _PASSING.get() or []
    gone = [i for i, (table, _) in enumerate(made) if any(table is x for x in tables)]
    _delete([made.pop(i) for i in reversed(gone)])


def _delete(tables: list[tuple[DataFrame, str]]) -> None:
    for table, path in tables:
        remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a `scratch_path` and what is below it."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has no more than ``rows`` rows; reads only as far as needed to tell."""
    return df.limit(rows + 1).count() <= rows


def row_bytes(kind: T.DataType, value: Column) -> Column:
    """About how many bytes a value takes up in memory."""
    own = F.lit(VALUE_BYTES).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return own + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.StructType):
        return reduce(Column.__add__, [row_bytes(f.dataType, value[f.name]) for f in kind], own)
    if isinstance(kind, T.ArrayType):
        sizes = F.transform(value, lambda x: row_bytes(kind.elementType, x))
        return own + F.coalesce(F.aggregate(sizes, F.lit(0).cast("long"), Column.__add__), F.lit(0))
    if isinstance(kind, T.MapType):
        entries = T.ArrayType(kind.keyType), T.ArrayType(kind.valueType)
        return row_bytes(entries[0], F.map_keys(value)) + row_bytes(entries[1], F.map_values(value))
    return own


def is_literal(df: DataFrame) -> bool:
    """True if the rows of ``df`` are part of its plan, so that each task has them anyway."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        return plan.getClass().getSimpleName() == "LocalRelation"
    except AttributeError:
        return False


def fits(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if the rows of ``df``, measured in one pass over it, take up no more than ``max_bytes``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    size = F.sum(row_bytes(df.schema, whole) + ROW_BYTES)
    return (df.agg(size).first()[0] or 0) <= max_bytes


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df``; None where the session does not expose one."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except AttributeError:
        return None


def is_small(df: DataFrame, max_bytes: int = SMALL_BYTES) -> bool:
    size = estimated_bytes(df)
    return size is not None and size <= max_bytes
