"""Date columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column, strict: bool = True, pattern: str = "yyyy-MM-dd") -> Column:
    """Date from text; bad text raises an error if ``strict``, else gives null."""
    return F.to_date(text, pattern) if strict else F.try_to_date(text, pattern)


def iso_weekday(day: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(day) + F.lit(1)


def weekday_label(day: Column, labels: Sequence[str]) -> Column:
    """Weekday name from seven ``labels``, Monday first."""
    if len(labels) != 7:
        raise ValueError("seven weekday labels are needed")
    # `get`, not `element_at`: the latter ignores a null index in ANSI mode.
    return F.get(F.array(*[F.lit(name) for name in labels]), F.weekday(day))


def weekday_english(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def days_between(first: Column, last: Column) -> Column:
    return F.datediff(last, first).cast("bigint")
