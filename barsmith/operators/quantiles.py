"""Exact order statistics of a column, without sorting it and without a buffer of its values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of one round. Each round reads the rows between two values and keeps the bin that holds the rank.
BINS = 1024


def nth(rows: DataFrame, value: str, rank: int, bins: int = BINS) -> tuple[float, int]:
    """The value at ``rank`` (from 0) in ascending order, and how many values are not above it.

    Counts of at most ``bins`` bins come to the driver in each round, and there are about log(values) / log(bins) rounds;
    ties end the search early, as a bin of one value is not cut further.
    """
    x = F.col(value)
    rows = rows.where(x.isNotNull()).select(x)
    low, high = rows.agg(F.min(x), F.max(x)).first()
    before = 0
    while low < high:
        width = (high - low) / bins
        at = F.least(F.greatest(F.floor((x - low) / width), F.lit(0)), F.lit(bins - 1)) if width > 0 else (x > low).cast("int")
        counts = rows.where(x.between(low, high)).groupBy(at.alias("bin")).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).orderBy("bin").collect()
        for c in counts:
            if before + c["n"] > rank:
                break
            before += c["n"]
        low, high = c["low"], c["high"]
        upto = before + c["n"]
    if before == 0:
        upto = rows.where(x <= low).count()
    return low, upto


def median(rows: DataFrame, value: str, bins: int = BINS) -> float | None:
    """The middle value, or the mean of the two middle ones; None if there is none."""
    n = rows.select(F.count(value)).first()[0]
    if not n:
        return None
    lower, upto = nth(rows, value, (n - 1) // 2, bins)
    if n % 2 or upto > n // 2:
        return float(lower)
    return (lower + rows.where(F.col(value) > lower).agg(F.min(value)).first()[0]) / 2
