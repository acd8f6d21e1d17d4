"""Daily market series: what was on offer on each day.

A row per listing and day is made for small inputs only. Otherwise counts and sums come from what starts and ends
on each day, in whole numbers that leave no rest, and medians from counts per range of values and day.
Sums are the same numbers either way (`functions.exact`).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import exact
from parcelflow.functions.numeric import not_nan
from parcelflow.operators.selection import long_form
from parcelflow.session import BROADCAST_ROWS, at_most, is_small, settle

MEDIANS = {"MEDIAN_PRICE_M2": "PRICE_M2", "MEDIAN_PRICE": "PRICE", "MEDIAN_AREA_M2": "AREA_M2"}
# Decimals of the published figures.
DIGITS = {
    "AVG_PRICE_M2": 2,
    "MEDIAN_PRICE_M2": 2,
    "MEDIAN_PRICE": 2,
    "AVG_PRICE": 2,
    "AVG_AREA_M2": 0,
    "TOTAL_AREA_ON_MARKET": 0,
    "MEDIAN_AREA_M2": 0,
}
MEANS = {"AVG_PRICE_M2": "PRICE_M2", "AVG_PRICE": "PRICE", "AVG_AREA_M2": "AREA_M2"}
SUMMED = ("PRICE_M2", "PRICE", "AREA_M2")
# Bits of a value's key that name its first cell, and those that each division of a full cell adds. A
# window over the parts of a cell has at most 2 ** PART_BITS rows.
CELL_BITS = 19
PART_BITS = 9
KEY_BITS = 64
# Values of a cell that are active on a day and may be sorted; a fuller cell is divided.
SORTED_ROWS = 4096
# Inputs estimated below this size may become one row per listing and day.
EXPLODED_BYTES = 64 * 1024
ORDER = ["ACTIVE_DAY", "TOTAL_ACTIVE_OFFERS", *DIGITS]


def day_range(start: Column, end: Column) -> Column:
    """All days from ``start`` to ``end``, both included; null if reversed or open."""
    return F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day")))


def explode_days(
    listings: DataFrame, start: str = "DATE_ADDED", end: str = "LAST_UPDATED", day: str = "ACTIVE_DAY"
) -> DataFrame:
    """One row per listing and active day; a listing without an interval keeps one row, day null."""
    return listings.withColumn(day, F.explode_outer(day_range(F.col(start), F.col(end))))


def daily_market_stats(
    listings: DataFrame,
    start: str = "DATE_ADDED",
    end: str = "LAST_UPDATED",
    digits: Mapping[str, int] = DIGITS,
    strategy: str = "auto",
) -> DataFrame:
    """Counts, means, sums and exact medians of the listings active on each day, ordered by day.

    Days before the earliest ``end`` are left out; NaN counts as missing. ``explode`` makes one row per
    listing and day and aggregates them; ``changes`` adds up what starts and ends on each day; ``auto``
    explodes small inputs. All give the same numbers: sums are exact and rounded once for each range
    of 32 powers of two.
    """
    if strategy not in ("auto", "explode", "changes"):
        raise ValueError(strategy)
    numbers = {c: not_nan(F.col(c).cast("double")) for c in SUMMED}
    needed = listings.select("ID", start, end, *numbers).withColumns(numbers)
    if strategy == "explode" or strategy == "auto" and is_small(needed, EXPLODED_BYTES):
        totals = _exploded_totals(needed, start, end)
        medians = _exploded_medians(needed, start, end)
    else:
        totals = daily_totals(needed, start, end)
        medians = daily_medians(needed, MEDIANS, start, end)
    series = totals.join(medians, "ACTIVE_DAY", "left")
    first = needed.agg(F.min(end)).scalar()
    rounded = {name: F.round(name, places) for name, places in digits.items()}
    return (
        series.filter(F.col("ACTIVE_DAY") >= first)
        .withColumns(rounded)
        .select(ORDER)
        .orderBy("ACTIVE_DAY")
    )


def _measured(listings: DataFrame, *others: str) -> DataFrame:
    """A row per listing and figure it has: ``metric`` (``rows``, ``ID`` or a summed column) and limbs."""
    figures = {"rows": F.lit(0.0), "ID": F.when(F.col("ID").isNotNull(), 0.0)}
    figures |= {c: F.col(c) for c in SUMMED}
    each = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("v")) for n, v in figures.items()])
    rows = listings.select(*others, F.explode(each).alias("m")).filter(F.col("m.v").isNotNull())
    return exact.add_limbs(rows.select(*others, "m.metric", "m.v"), "v").drop("v")


def _totals(sums: DataFrame) -> DataFrame:
    """The figures of a day from counts ``n`` and sums of limbs per day, metric and bucket."""

    def count(metric: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("metric") == metric, F.col("n"))), F.lit(0)).cast("long")

    def summed(metric: str) -> Column:
        found = F.when(F.col("metric") == metric, F.struct("bucket", "hi", "lo"))
        return exact.total(F.collect_list(found))

    return sums.groupBy("ACTIVE_DAY").agg(
        count("ID").alias("TOTAL_ACTIVE_OFFERS"),
        *[F.try_divide(summed(c), count(c)).alias(name) for name, c in MEANS.items()],
        F.coalesce(summed("AREA_M2"), F.lit(0.0)).alias("TOTAL_AREA_ON_MARKET"),
    )


def _exploded_totals(listings: DataFrame, start: str, end: str) -> DataFrame:
    days = explode_days(listings, start, end).filter(F.col("ACTIVE_DAY").isNotNull())
    sums = _measured(days, "ACTIVE_DAY").groupBy("ACTIVE_DAY", "metric", "bucket")
    return _totals(sums.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in ("hi", "lo")]))


def _exploded_medians(listings: DataFrame, start: str, end: str) -> DataFrame:
    days = explode_days(listings, start, end).filter(F.col("ACTIVE_DAY").isNotNull())
    return days.groupBy("ACTIVE_DAY").agg(*[F.median(c).alias(name) for name, c in MEDIANS.items()])


def _changes(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Two rows for each interval: ``sign`` +1 on its first day and -1 on the day after its last."""
    edges = F.array(
        F.struct(F.col(start).alias("day"), F.lit(1).alias("sign")),
        F.struct(F.date_add(end, 1).alias("day"), F.lit(-1).alias("sign")),
    )
    return (
        rows.filter(F.col(start) <= F.col(end))
        .withColumn("edge", F.explode(edges))
        .select("*", "edge.*")
        .drop("edge")
    )


def _levels(steps: DataFrame, group: list[str], *sums: str) -> DataFrame:
    """Running sums of a group from each day of change to the day before the next (``day``, ``until``);
    without the times when nothing is active."""
    along = Window.partitionBy(*group).orderBy("day")
    running = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.select(
        *group,
        "day",
        F.date_sub(F.lead("day").over(along), 1).alias("until"),
        *[F.sum(c).over(running).alias(c) for c in sums],
    ).filter("n > 0")


def _each_day() -> Column:
    return F.explode(F.sequence(F.col("day"), F.col("until"), F.expr("interval 1 day")))


def daily_totals(
    listings: DataFrame, start: str = "DATE_ADDED", end: str = "LAST_UPDATED"
) -> DataFrame:
    """Additive figures per day without a row per listing and day.

    Sums are kept in whole numbers, from which what ended is taken off again without a rest. Running
    sums are over one row per metric, bucket and calendar day.
    """
    group = ["metric", "bucket"]
    changes = _changes(_measured(listings, start, end), start, end)

    def signed(x: str) -> Column:
        return F.sum(F.when(F.col("sign") > 0, F.col(x)).otherwise(-F.col(x))).alias(x)

    steps = changes.groupBy(*group, "day").agg(F.sum("sign").alias("n"), signed("hi"), signed("lo"))
    levels = _levels(steps, group, "n", "hi", "lo")
    return _totals(levels.withColumn("ACTIVE_DAY", _each_day()))


def daily_medians(
    listings: DataFrame,
    medians: Mapping[str, str] = MEDIANS,
    start: str = "DATE_ADDED",
    end: str = "LAST_UPDATED",
    cell_bits: int = CELL_BITS,
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """Exact medians of the listings active on each day, without a row per listing and day.

    The first bits of a value's sortable key name its cell. What starts and ends per cell and day gives
    the number of active values, and so the cell that holds the median of each day. While more than
    ``sorted_rows`` values of a wanted cell are active on a day, its days look into the parts that the
    next bits make of it, by counts again; at the last bit a cell is a single value. Rows of the cells
    that are left are expanded to the days on which their cell is wanted.
    """
    rows = long_form(
        listings.filter(F.col(start) <= F.col(end)),
        [],
        {source: F.col(source).cast("double") for source in set(medians.values())},
        {"start": F.col(start), "end": F.col(end)},
    ).select(F.col("g.metric").alias("metric"), "v", "start", "end")
    # Never null, so that joins on cells need not test for it, with all its steps in the test.
    rows = exact.add_sortable(rows, "v", "key").withColumn("key", F.coalesce("key", F.lit(0))).drop("v")

    def cell(shift: int) -> Column:
        return F.shiftright("key", shift)

    shift = KEY_BITS - cell_bits
    first = rows.withColumn("cell", cell(shift))
    active = _levels(_steps(first, "metric", "cell"), ["metric", "cell"], "n").withColumn("day", _each_day())
    of_day = Window.partitionBy("metric", "day")
    through = F.sum("n").over(of_day.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = F.array(
        F.struct(F.lit("low").alias("side"), F.floor((F.col("total") - 1) / 2).alias("k")),
        F.struct(F.lit("high").alias("side"), F.floor(F.col("total") / 2).alias("k")),
    )
    before = F.col("through") - F.col("n")
    here = F.filter(middle, lambda m: (m["k"] >= before) & (m["k"] < F.col("through")))
    targets = settle(
        active.withColumns({"through": through, "total": F.sum("n").over(of_day)})
        .withColumn("m", F.explode(here))
        .select("metric", "day", "m.side", "cell", "n", (F.col("m.k") - before).alias("k"))
    )
    found = []
    while True:
        full = F.col("n") > sorted_rows
        found.append(_sorted(rows, targets.filter(~full), cell(shift)))
        targets = targets.filter(full)
        if shift == 0 or targets.isEmpty():
            break
        parts = min(PART_BITS, shift)
        targets = settle(_divided(rows, targets, cell(shift), cell(shift - parts)))
        shift -= parts
    # Cells of the last bit are single values, however many rows have them.
    if shift == 0:
        found.append(targets.select("metric", "day", "side", F.col("cell").alias("key")))
    picked = reduce(DataFrame.unionByName, found)

    def median(source: str) -> Column:
        value = F.when(F.col("metric") == source, exact.from_sortable(F.col("key")))
        low = F.max(F.when(F.col("side") == "low", value))
        high = F.max(F.when(F.col("side") == "high", value))
        return F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)

    return picked.groupBy(F.col("day").alias("ACTIVE_DAY")).agg(
        *[median(source).alias(name) for name, source in medians.items()]
    )


def _steps(rows: DataFrame, *group: str) -> DataFrame:
    return _changes(rows, "start", "end").groupBy(*group, "day").agg(F.sum("sign").alias("n"))


def _reached(counts: DataFrame, group: list[str]) -> DataFrame:
    """The cell that holds the rank ``k`` (from 0) of a group, with ``k`` from the cell's first value on."""
    by_cell = Window.partitionBy(*group).orderBy("cell")
    through = F.sum("n").over(by_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.col("through") - F.col("n")
    return (
        counts.withColumn("through", through)
        .filter((F.col("k") >= before) & (F.col("k") < F.col("through")))
        .select(*group, "cell", "n", (F.col("k") - before).alias("k"))
    )


def _wanted(rows: DataFrame, targets: DataFrame, cell: Column) -> tuple[DataFrame, bool]:
    """Rows of the wanted cells with the days on which these are wanted; whether targets are few."""
    few = at_most(targets, BROADCAST_ROWS)
    days = targets.groupBy("metric", "cell").agg(F.collect_set("day").alias("days"))
    return rows.withColumn("cell", cell).join(F.broadcast(days) if few else days, ["metric", "cell"]), few


def _divided(rows: DataFrame, targets: DataFrame, cell: Column, part: Column) -> DataFrame:
    """The targets in the parts of their cells."""
    wanted, few = _wanted(rows, targets, cell)
    steps = _steps(wanted.drop("days").withColumn("part", part), "metric", "cell", "part")
    levels = _levels(steps, ["metric", "cell", "part"], "n")
    side = targets.select("metric", "cell", "day", "side", "k")
    days = side.groupBy("metric", "cell").agg(F.collect_list(F.struct("day", "side", "k")).alias("of_day"))
    inside = F.filter("of_day", lambda t: t["day"].between(F.col("day"), F.col("until")))
    counts = (
        levels.join(F.broadcast(days) if few else days, ["metric", "cell"])
        .select("metric", F.col("part").alias("cell"), "n", F.explode(inside).alias("t"))
        .select("metric", "cell", "n", "t.*")
    )
    return _reached(counts, ["metric", "day", "side"])


def _sorted(rows: DataFrame, targets: DataFrame, cell: Column) -> DataFrame:
    """The values at the targets' ranks, from the rows of their cells."""
    wanted, few = _wanted(rows, targets, cell)
    on = F.filter("days", lambda day: day.between(F.col("start"), F.col("end")))
    values = (
        wanted.select("metric", "cell", F.col("key"), F.explode(on).alias("day"))
        .groupBy("metric", "day", "cell", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    side = targets.select("metric", "day", "cell", "side", "k")
    of_side = values.join(F.broadcast(side) if few else side, ["metric", "day", "cell"])
    reached = _reached(of_side.drop("cell").withColumnRenamed("key", "cell"), ["metric", "day", "side"])
    return reached.select("metric", "day", "side", F.col("cell").alias("key"))
