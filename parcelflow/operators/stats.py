"""Group statistics and the data behind charts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions.numeric import not_nan
from parcelflow.operators.joins import lookup_join
from parcelflow.operators.selection import group_quantiles, summarise
from parcelflow.session import settle

# Power sums kept of each bin of a density, bandwidths that its kernels reach, and what both leave out at
# most, in parts of 1 / bandwidth. A bin reaches a quarter of a bandwidth to either side, so the terms left
# out of the series are below 0.44 * 0.25 ** k / sqrt(k!) each, k from 12 on.
DENSITY_TERMS = 12
DENSITY_REACH = 7.2
DENSITY_ERROR = 1e-11


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most frequent first, equal counts by value."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return value_counts(df, column).limit(k)


def ordered_counts(df: DataFrame, column: str, categories: DataFrame) -> DataFrame:
    """Counts for the given categories in their order; a category without rows has a null count."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return categories.join(counts, column, "left").orderBy("ordinal")


FUNCTIONS = {"mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "sum": F.sum}


def group_stats(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    functions: Sequence[str] = ("mean", "median"),
    strategy: str = "auto",
) -> DataFrame:
    """Several functions of several columns per group, named ``<column>_<function>``.

    Rows with a null key belong to no group; NaN counts as missing.
    """
    floats = [c for c, kind in df.dtypes if c in columns and kind in ("double", "float")]
    known = df.withColumns({c: not_nan(F.col(c)) for c in floats if c not in keys})
    for key in keys:
        known = known.filter(F.col(key).isNotNull())
    plain = {f"{c}_{f}": FUNCTIONS[f](c) for c in columns for f in functions if f != "median"}
    medians = {f"{c}_median": c for c in columns if "median" in functions}
    if not plain:
        plain = {"_rows": F.count(F.lit(1))}
    return summarise(known, keys, plain, medians, strategy).select(
        *keys, *[f"{c}_{f}" for c in columns for f in functions]
    )


def boxplot_stats(
    df: DataFrame, key: str, column: str, whisker: float = 1.5, strategy: str = "auto"
) -> DataFrame:
    """Quartiles, whiskers at the outermost points inside the fences, number of points outside.

    The second pass joins the fences of a bounded number of groups back to the rows. NaN counts as
    missing.
    """
    known = df.select(key, column).filter(F.col(key).isNotNull() & not_nan(F.col(column)).isNotNull())
    quartiles = group_quantiles(
        known, [key], [column], {"q1": 0.25, "median": 0.5, "q3": 0.75}, strategy=strategy
    ).select(key, *[F.col(f"{column}_{q}").alias(q) for q in ("q1", "median", "q3")])
    reach = F.lit(whisker) * (F.col("q3") - F.col("q1"))
    inside = F.col(column).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        lookup_join(known, settle(quartiles), key, "inner")
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, F.col(column))).alias("whisker_low"),
            F.max(F.when(inside, F.col(column))).alias("whisker_high"),
            F.count_if(~inside).alias("fliers"),
        )
    )


def _spread(df: DataFrame, column: str) -> Column:
    """One struct with count, extremes and sample deviation, as a scalar subquery."""
    return df.agg(
        F.struct(
            F.count(column).cast("double").alias("n"),
            F.min(column).cast("double").alias("lo"),
            F.max(column).cast("double").alias("hi"),
            F.stddev_samp(column).alias("sd"),
        ).alias("s")
    ).scalar()


def histogram(df: DataFrame, column: str, bins: int = 500) -> DataFrame:
    """Counts in ``bins`` equal intervals over the range of the data, the last one closed.

    Empty bins are listed with 0. A constant column is spread over a range of one around it.
    """
    known = df.select(not_nan(F.col(column).cast("double")).alias("x")).filter(F.col("x").isNotNull())
    flat = F.col("s.lo") == F.col("s.hi")
    low = F.when(flat, F.col("s.lo") - 0.5).otherwise(F.col("s.lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("s.hi") - F.col("s.lo")) / F.lit(float(bins))
    index = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1))
    spread = _spread(known, "x")
    counts = (
        known.withColumn("s", spread).select(index.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    spine = (
        df.sparkSession.range(bins)
        .select(F.col("id").alias("bin"), spread.alias("s"))
        .filter(F.col("s.lo").isNotNull())
        .select("bin", low.alias("lo"), width.alias("width"))
    )
    return spine.join(counts, "bin", "left").select(
        F.col("bin").cast("int").alias("bin"),
        (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("right_edge"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def kernel_density(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth h on an even grid over the data range.

    Values are gathered in bins of half a bandwidth, of each its power sums about the middle. A kernel moved
    by u is the sum of He_k(z) u^k / k! times the kernel, He_k being the Hermite polynomials, so ``DENSITY_TERMS``
    sums stand for all values of a bin, and each bin meets the grid points within ``DENSITY_REACH``
    bandwidths only. The result is within ``DENSITY_ERROR`` / h of the exact sum.
    """
    known = df.select(not_nan(F.col(column).cast("double")).alias("x")).filter(F.col("x").isNotNull())
    s = F.col("s")
    scale = [
        s["n"].alias("n"),
        s["lo"].alias("lo"),
        ((s["hi"] - s["lo"]) / F.lit(float(points - 1))).alias("step"),
        (s["sd"] * F.pow(s["n"], F.lit(-0.2))).alias("h"),
    ]
    scaled = known.withColumn("s", _spread(known, "x")).select("x", *scale).filter(F.col("h") > 0)
    bins = scaled.withColumn("bin", F.floor((F.col("x") - F.col("lo")) / (F.col("h") / 2)))
    bins = bins.withColumn("middle", F.col("lo") + (F.col("bin") + 0.5) * (F.col("h") / 2))
    u = (F.col("x") - F.col("middle")) / F.col("h")
    sums = bins.groupBy("middle", "n", "lo", "step", "h").agg(
        *[F.sum(F.pow(u, F.lit(float(k)))).alias(f"m{k}") for k in range(DENSITY_TERMS)]
    )
    hermite = _hermite(DENSITY_TERMS)
    weights = {
        f"c{j}": sum(
            (F.col(f"m{k}") * (hermite[k][j] / math.factorial(k)) for k in range(j, DENSITY_TERMS) if hermite[k][j]),
            F.lit(0.0),
        )
        for j in range(DENSITY_TERMS)
    }

    def reached(side: int) -> Column:
        edge = (F.col("middle") + side * (DENSITY_REACH + 0.25) * F.col("h") - F.col("lo")) / F.col("step")
        return F.greatest(F.lit(0), F.least(F.lit(points - 1), F.ceil(edge) if side < 0 else F.floor(edge)))

    near = F.explode(F.sequence(reached(-1).cast("int"), reached(1).cast("int")))
    met = sums.select("middle", "n", "lo", "step", "h", *[c.alias(x) for x, c in weights.items()], near.alias("point"))
    z = F.col("z")
    series = F.lit(0.0)
    for j in reversed(range(DENSITY_TERMS)):
        series = series * z + F.col(f"c{j}")
    density = F.exp(-0.5 * z * z) * series / (F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
    curve = (
        met.withColumn("z", (F.col("lo") + F.col("point") * F.col("step") - F.col("middle")) / F.col("h"))
        .groupBy("point")
        .agg(F.sum(density).alias("density"))
    )
    grid = df.sparkSession.range(points).withColumn("s", _spread(known, "x"))
    grid = grid.select(F.col("id").cast("int").alias("point"), *scale).filter(F.col("h") > 0)
    return grid.join(curve, "point", "left").select(
        "point",
        (F.col("lo") + F.col("point") * F.col("step")).alias("x"),
        F.greatest(F.coalesce("density", F.lit(0.0)), F.lit(0.0)).alias("density"),
    )


def _hermite(terms: int) -> list[list[int]]:
    """Coefficients of the (probabilists') Hermite polynomials, by power."""
    found = [[1] + [0] * terms, [0, 1] + [0] * (terms - 1)]
    for k in range(1, terms - 1):
        found.append([a - k * b for a, b in zip([0, *found[k][:-1]], found[k - 1])])
    return found


def melt(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), name, value)


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value over all ``columns`` together and the largest of each."""
    return df.agg(
        F.array_min(F.array(*[F.min(c) for c in columns])).alias("smallest"),
        F.array_max(F.array(*[F.max(c) for c in columns])).alias("largest"),
        *[F.max(c).alias(f"max_{c}") for c in columns],
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()

