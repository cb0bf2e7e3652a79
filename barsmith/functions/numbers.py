"""Number helpers that hold under ANSI rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(raw: Column) -> Column:
    """A double, or null for what is null, unreadable, NaN or infinite."""
    x = raw.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def percent_change(start: Column, end: Column) -> Column:
    return F.when(start == 0, F.lit(0.0)).otherwise((end - start) / F.abs(start) * 100)


def is_close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), rel * F.greatest(F.abs(a), F.abs(b)))


def round_tick(value: Column, tick: float, precision: int) -> Column:
    return F.round(F.rint(value / tick) * tick, precision)
