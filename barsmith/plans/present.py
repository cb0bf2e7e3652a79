"""What results look like to those who read them: rounded, named, drawn, as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.functions.intervals import DAY, HOUR, MINUTE
from barsmith.functions.time import local

#: Qualities of data on which a win rate is not to be trusted.
UNRELIABLE = ("demo", "partial")


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Sizes in percent, penetration and strength to six digits; prices as they are."""
    return rows.withColumns({c: F.round(c, digits) for c in ("size_percent", "penetration", "strength") if c in rows.columns and dict(rows.dtypes)[c] == "double"})


def of_kind(swings: DataFrame, kind: str) -> DataFrame:
    return swings.where(F.col("kind") == kind)


def chart(bars: DataFrame) -> DataFrame:
    """Bars with times in whole seconds, and whether a bar's volume is drawn as of a rising bar."""
    return bars.select("symbol", F.floor(F.col("time") / 1000).alias("time"), "open", "high", "low", "close", "volume", (F.col("close") >= F.col("open")).alias("up"))


def from_chart(seconds: Column) -> Column:
    return (seconds * 1000).cast("bigint")


def trusted(quality: Column) -> Column:
    return ~quality.isin(*UNRELIABLE)


def fallback(failed: Column, provider: Column, preferred: Column) -> Column:
    """Whether bars came from elsewhere than wanted: a fetch failed, or another provider than the preferred one answered."""
    return failed | ~provider.eqNullSafe(preferred)


def price_text(price: Column, digits: int) -> Column:
    """A price with thousands apart and a fixed number of digits."""
    return F.format_number(price, digits)


def percent_text(value: Column) -> Column:
    """A signed percentage with two digits; a dash for none."""
    text = F.concat(F.when(value > 0, "+").otherwise(""), F.format_string("%.2f", value), F.lit("%"))
    return F.when(value.isNull(), "-").otherwise(text)


def number_text(value: Column, digits: int = 2) -> Column:
    """A number with thousands apart; a dash for none."""
    return F.when(value.isNull() | F.isnan(value), "-").otherwise(F.format_number(F.round(value, digits), digits))


def compact_text(value: Column) -> Column:
    """A number with at most one digit after the point, in thousands, millions, billions or trillions; a dash for none."""
    text = F.lit(None).cast("string")
    for size, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"), (1.0, "")):
        part = F.round(value / size, 1)
        shown = F.concat(F.regexp_replace(F.format_number(part, 1), "[.]0$", ""), F.lit(unit))
        fits = F.abs(F.round(value / (size / 1000), 1)) >= 1000 if size > 1 else F.lit(True)
        text = F.coalesce(text, F.when(fits, shown))
    return F.when(value.isNull() | F.isnan(value), "-").otherwise(text)


def ratio_text(value: Column) -> Column:
    """A ratio as 1.23x; a dash for one that is not defined, as a profit factor without losses."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "-").otherwise(F.format_string("%.2fx", value))


def date_text(ms: Column, zone: str = "UTC") -> Column:
    return F.date_format(local(ms, zone), "dd MMM yyyy")


def time_text(ms: Column, zone: str = "UTC") -> Column:
    return F.date_format(local(ms, zone), "HH:mm")


def moment_text(ms: Column, interval: str, zone: str = "UTC") -> Column:
    """The date of a daily bar, date and time of a finer one; a dash for none."""
    text = date_text(ms, zone) if interval == "1d" else F.concat(date_text(ms, zone), F.lit(", "), time_text(ms, zone))
    return F.coalesce(text, F.lit("-"))


def duration_text(bars: Column, interval: str) -> Column:
    return F.concat(bars.cast("string"), F.when(bars == 1, " bar").otherwise(" bars"), F.lit(f" ({interval})"))


def ago_text(ms: Column, now: Column) -> Column:
    """How long ago something was, in whole minutes, hours or days."""
    past = now - ms
    whole = lambda unit, name: F.concat(F.floor(past / unit).cast("string"), F.lit(name))
    return F.when(ms.isNull(), "never").when(past < MINUTE, "just now").when(past < HOUR, whole(MINUTE, "m ago")).when(past < DAY, whole(HOUR, "h ago")).otherwise(whole(DAY, "d ago"))


def configuration(request) -> str:
    """A request as JSON."""
    return json.dumps(asdict(request), sort_keys=True)


def as_json(rows: DataFrame, name: str) -> DataFrame:
    """One column ``name`` with each row as a JSON object, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias(name))
