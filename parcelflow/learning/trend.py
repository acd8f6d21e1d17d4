"""Robust straight line by iteratively reweighted least squares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.operators.selection import group_quantiles
from parcelflow.session import stored

# Huber's tuning constant, and the upper quartile of the normal distribution.
HUBER_T = 1.345
NORMAL_MAD = 0.6744897501960817

# Up to so many points, one task takes the median of all residuals.
SMALL_ROWS = 500_000


@dataclass(frozen=True)
class Line:
    """``converged`` tells whether the last round moved the line by no more than the tolerance."""

    intercept: float
    slope: float
    scale: float
    rounds: int
    rows: int
    converged: bool


def _weighted_line(points: DataFrame, weight) -> tuple[float, float, int]:
    x, y = F.col("x"), F.col("y")
    s = points.agg(
        F.sum(weight).alias("w"),
        F.sum(weight * x).alias("wx"),
        F.sum(weight * y).alias("wy"),
        F.sum(weight * x * x).alias("wxx"),
        F.sum(weight * x * y).alias("wxy"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if not s["n"]:
        raise ValueError("no points to fit a line to")
    spread = s["w"] * s["wxx"] - s["wx"] ** 2
    slope = (s["w"] * s["wxy"] - s["wx"] * s["wy"]) / spread if spread else 0.0
    return (s["wy"] - slope * s["wx"]) / s["w"], slope, s["n"]


def fit_robust_line(
    df: DataFrame,
    x: str,
    y: str,
    t: float = HUBER_T,
    max_rounds: int = 50,
    tolerance: float = 1e-8,
    small_rows: int = SMALL_ROWS,
) -> Line:
    """Huber line of ``y`` on ``x``; the scale is the median absolute residual, renewed each round.

    Each round makes one pass for the median and one for five weighted sums; only these numbers
    reach the driver. The two columns are written down once, so rounds do not read the source again.
    """
    points = stored(
        df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(
            F.col("x").isNotNull() & F.col("y").isNotNull()
        )
    )
    intercept, slope, rows = _weighted_line(points, F.lit(1.0))
    strategy = "builtin" if rows <= small_rows else "cells"
    scale, done, converged = 0.0, 0, False
    for done in range(1, max_rounds + 1):
        size = F.abs(F.col("y") - F.lit(intercept) - F.lit(slope) * F.col("x"))
        sizes = points.select(size.alias("r"))
        scale = group_quantiles(sizes, [], ["r"], {"m": 0.5}, strategy=strategy).first()[0] / NORMAL_MAD
        if scale == 0.0:
            # More than half of the points lie on the line.
            converged = True
            break
        limit = F.lit(t * scale)
        weight = F.when(size <= limit, F.lit(1.0)).otherwise(limit / size)
        before = (intercept, slope)
        intercept, slope, _ = _weighted_line(points, weight)
        moved = max(abs(intercept - before[0]), abs(slope - before[1]))
        converged = moved <= tolerance * max(1.0, abs(before[0]), abs(before[1]))
        if converged:
            break
    return Line(intercept, slope, scale, done, rows, converged)
