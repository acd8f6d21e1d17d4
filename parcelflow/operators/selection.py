"""Exact order statistics and quantiles per group without gathering a group in one task.

Built-in exact percentiles keep all distinct values of a group in the memory of one task, which fails
once a single group holds a large part of the table. Here each value is first mapped to a cell by a
monotone function, cells are counted (map-side combined), the cell that holds the wanted rank is
found from the counts, and only the rows of that cell are looked at again. Cells that are still too
full are divided further. The result is exact for any distribution; the cells only set the cost.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions.numeric import not_nan
from parcelflow.session import BROADCAST_ROWS, is_small, settle

# Cells per e-fold of the value, parts a full cell is divided into, rows a cell may hold at last.
CELLS_PER_EFOLD = 128
PARTS = 1024
CELL_ROWS = 2_000_000

Rank = Callable[[Column], Column]


def log_cell(value: Column, per_efold: int = CELLS_PER_EFOLD) -> Column:
    """Monotone cell number of any number, logarithmic in size and symmetric about zero."""
    number = value.cast("double")
    size = F.log1p(F.abs(number))
    bounded = F.when(size > 800.0, F.lit(800.0)).otherwise(size)
    cell = (F.signum(number) * F.floor(bounded * F.lit(float(per_efold)))).cast("int")
    # Never null, so that joins on cells need not test for it.
    return F.coalesce(cell, F.lit(0))


def long_form(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], others: Mapping[str, Column] = {}
) -> DataFrame:
    """One row per row and value: ``g`` = struct(metric, keys), ``v`` and the ``others``; no nulls.

    A struct of the keys compares null to null as equal, in grouping as in joining.
    """
    extra = [column.alias(name) for name, column in others.items()]
    kinds = dict(df.select(*[c.alias(n) for n, c in values.items()]).dtypes)
    clean = {
        name: not_nan(c) if kinds[name] in ("double", "float") else c
        for name, c in values.items()
    }
    # `explode` also keeps the optimiser from copying the value's expression into every later use.
    each = F.explode(
        F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("v")) for n, c in clean.items()])
    )
    return (
        df.select(*keys, *extra, each.alias("m"))
        .filter(F.col("m.v").isNotNull())
        .select(F.struct(F.col("m.metric").alias("metric"), *keys).alias("g"), F.col("m.v").alias("v"), *others)
    )


def _running(counts: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """Add the number of rows of the group that come before (``before``)."""
    window = Window.partitionBy(*group).orderBy(order)
    through = F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumn("before", through - F.col("n"))


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    ranks: Mapping[str, Rank],
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The value at each wanted rank (from 0) of each group.

    ``ranks`` maps a label to a function from the non-null count of the group to a rank; ranks
    outside the group are clamped to its ends. Gives ``g`` (struct of metric and keys), ``rank``,
    ``total`` and ``value``.
    """
    rows = long_form(df, keys, values).withColumn("cell", log_cell(F.col("v")))
    counts = rows.groupBy("g", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    total = F.sum("n").over(Window.partitionBy("g"))
    counted = _running(counts, ["g"], "cell").withColumn("total", total)
    last = F.col("total") - 1
    wanted = F.array(
        *[
            F.struct(
                F.lit(label).alias("rank"),
                F.greatest(F.lit(0), F.least(last, rank(F.col("total")))).cast("bigint").alias("k"),
            )
            for label, rank in ranks.items()
        ]
    )
    cells = settle(_holding(counted, wanted).select("g", "total", "cell", "lo", "hi", "n", "wanted"))
    wide = F.col("hi").cast("double") > F.col("lo").cast("double")
    before = None
    while True:
        size = cells.agg(
            F.count(F.lit(1)).alias("cells"),
            F.max(F.when(wide, F.col("n"))).alias("fullest"),
            F.count_if(F.col("lo") < F.col("hi")).alias("open"),
        ).first()
        few = size["cells"] <= BROADCAST_ROWS
        # Ends of a cell fall into different parts, so cells get smaller, unless their range is infinite.
        if size["fullest"] is None or size["fullest"] <= cell_rows or size["fullest"] == before:
            break
        before = size["fullest"]
        cells = settle(_divide(rows, cells, few))
    single = _found(cells.filter(F.col("lo") == F.col("hi")), F.col("lo"))
    if not size["open"]:
        return single
    several = cells.filter(F.col("lo") < F.col("hi"))
    return single.unionByName(_pick(rows, several, few))


HOME = ["g", "cell", "lo", "hi"]


def _holding(counted: DataFrame, wanted: Column) -> DataFrame:
    """Rows that hold any of the ranks in the array ``wanted``, which then count from the row on."""
    inside = F.filter(
        wanted,
        lambda w: (w["k"] >= F.col("before")) & (w["k"] < F.col("before") + F.col("n")),
    )
    return (
        counted.withColumn("inside", inside)
        .filter(F.size("inside") > 0)
        .withColumn(
            "wanted",
            F.transform(
                "inside",
                lambda w: F.struct(w["rank"].alias("rank"), (w["k"] - F.col("before")).alias("k")),
            ),
        )
    )


def _found(cells: DataFrame, value: Column) -> DataFrame:
    return cells.select("g", F.explode("wanted").alias("w"), "total", value.alias("value")).select(
        "g", "w.rank", "total", "value"
    )


def _small_side(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _in_cells(rows: DataFrame, cells: DataFrame, few: bool) -> DataFrame:
    """Rows that lie in a wanted cell; the cells are broadcast if they were counted to be few."""
    return rows.join(_small_side(cells.select(HOME), few), ["g", "cell"]).filter(
        F.col("v").between(F.col("lo"), F.col("hi"))
    )


def _divide(rows: DataFrame, cells: DataFrame, few: bool) -> DataFrame:
    """Replace each wanted cell by those of its equal parts that hold its ranks."""
    low, high = F.col("lo").cast("double"), F.col("hi").cast("double")
    part = F.floor(F.try_divide(F.col("v").cast("double") - low, high - low) * PARTS)
    counts = (
        _in_cells(rows, cells, few)
        .withColumn("part", F.coalesce(F.least(part, F.lit(PARTS - 1)), F.lit(0)))
        .groupBy(*HOME, "part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("from"), F.max("v").alias("to"))
    )
    parts = _running(counts, HOME, "part").join(_small_side(cells.drop("n"), few), HOME)
    return _holding(parts, F.col("wanted")).select(
        "g", "total", "cell", F.col("from").alias("lo"), F.col("to").alias("hi"), "n", "wanted"
    )


def _pick(rows: DataFrame, cells: DataFrame, few: bool) -> DataFrame:
    counts = _in_cells(rows, cells, few).groupBy(*HOME, "v").agg(F.count(F.lit(1)).alias("n"))
    values = _running(counts, HOME, "v").join(_small_side(cells.drop("n"), few), HOME)
    return _found(_holding(values, F.col("wanted")), F.col("v"))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    probs: Mapping[str, float],
    kind: str = "linear",
    strategy: str = "auto",
) -> DataFrame:
    """Exact quantiles per group: ``keys`` and a column ``<value>_<label>`` for each value and label.

    ``linear`` interpolates between neighbours, ``nearest`` takes the element at
    ``round(p * (n - 1))``. ``strategy`` is ``builtin`` (one aggregate, a group in one task),
    ``cells`` (see the module) or ``auto``, which takes ``builtin`` for small inputs only. Groups
    without any value are left out.
    """
    if strategy not in ("auto", "builtin", "cells"):
        raise ValueError(strategy)
    if kind not in ("linear", "nearest"):
        raise ValueError(kind)
    if kind == "linear" and (strategy == "builtin" or strategy == "auto" and is_small(df)):
        points = F.array(*[F.lit(p) for p in probs.values()])
        direct = df.groupBy(*keys).agg(
            *[F.percentile(not_nan(F.col(value).cast("double")), points).alias(value) for value in values]
        )
        if keys:
            direct = direct.filter(F.coalesce(*values).isNotNull())
        return direct.select(
            *keys,
            *[
                F.get(value, F.lit(i)).alias(f"{value}_{label}")
                for value in values
                for i, label in enumerate(probs)
            ],
        )

    def position(p: float) -> Rank:
        return lambda total: F.lit(p) * (total - 1)

    ranks: dict[str, Rank] = {}
    for label, p in probs.items():
        if kind == "nearest":
            ranks[label] = lambda total, at=position(p): F.round(at(total))
        else:
            ranks[f"{label}<"] = lambda total, at=position(p): F.floor(at(total))
            ranks[f"{label}>"] = lambda total, at=position(p): F.ceil(at(total))
    found = order_statistics(df, keys, {v: F.col(v).cast("double") for v in values}, ranks)

    def at_rank(value: str, rank: str) -> Column:
        chosen = (F.col("g.metric") == value) & (F.col("rank") == rank)
        return F.max(F.when(chosen, F.col("value")))

    def result(value: str, label: str, p: float) -> Column:
        if kind == "nearest":
            return at_rank(value, label).alias(f"{value}_{label}")
        low, high = at_rank(value, f"{label}<"), at_rank(value, f"{label}>")
        at = position(p)(F.max(F.when(F.col("g.metric") == value, F.col("total"))))
        between = low * (F.ceil(at) - at) + high * (at - F.floor(at))
        return F.when(F.ceil(at) == F.floor(at), low).otherwise(between).alias(f"{value}_{label}")

    outputs = [result(v, label, p) for v in values for label, p in probs.items()]
    if not keys:
        return found.agg(*outputs)
    return (
        found.groupBy(F.struct(*[F.col(f"g.{k}").alias(k) for k in keys]).alias("key"))
        .agg(*outputs)
        .select("key.*", *[f"{v}_{label}" for v in values for label in probs])
    )


def summarise(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Mapping[str, Column],
    medians: Mapping[str, str] = {},
    strategy: str = "auto",
) -> DataFrame:
    """Group aggregates together with exact medians (``medians``: output name to column)."""
    plain = [column.alias(name) for name, column in aggregates.items()]
    if not medians:
        return df.groupBy(*keys).agg(*plain)
    if strategy == "builtin" or strategy == "auto" and is_small(df):
        direct = [F.median(not_nan(F.col(source))).alias(name) for name, source in medians.items()]
        return df.groupBy(*keys).agg(*plain, *direct)
    sources = sorted(set(medians.values()))
    middle = group_quantiles(df, keys, sources, {"median": 0.5}, strategy="cells").select(
        *keys, *[F.col(f"{source}_median").alias(name) for name, source in medians.items()]
    )
    if not keys:
        row = middle.select(F.struct(*medians).alias("m"))
        return df.agg(*plain).withColumn("m", row.scalar()).select(*aggregates, "m.*")
    key = F.struct(*keys).alias("key")
    return (
        (df.groupBy(*keys).agg(*plain).select(key, *aggregates))
        .join(middle.select(key, *medians), "key", "left")
        .select("key.*", *aggregates, *medians)
    )
