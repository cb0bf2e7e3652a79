"""Bar intervals: their lengths, how they derive from each other, and grid arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barsmith.functions.time import EXCHANGE_ZONE, local_day_start

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
#: Milliseconds of each interval.
LENGTH = {"5m": 5 * MINUTE, "15m": 15 * MINUTE, "1h": HOUR, "4h": 4 * HOUR, "6h": 6 * HOUR, "1d": DAY}
#: What each interval is built from, nearest first, and those that are stored.
FINER = {"5m": (), "15m": ("5m",), "1h": ("5m",), "4h": ("1h", "5m"), "6h": ("1h", "5m"), "1d": ("1h", "5m")}
STORED = ("5m", "15m", "1h", "1d")
#: Other spellings of intervals.
ALIASES = {"5": "5m", "15": "15m", "60": "1h", "240": "4h", "360": "6h", "D": "1d", "1D": "1d"}
#: Most bars of a request, most days of one within the day.
MOST_BARS, MOST_DAYS = 20_000, 730
#: Days that vendors look back at most, and days of one request, by interval.
HISTORY_DAYS = {"5m": 58, "15m": 58, "1h": 720, "1d": 20_000}
CHUNK_DAYS = {"5m": 55, "15m": 55, "1h": 700, "1d": 5_000}


def interval(name: str) -> str:
    """The canonical name; raises KeyError for an unknown one."""
    name = ALIASES.get(name, name)
    if name not in LENGTH:
        raise KeyError(f"unknown interval {name!r}")
    return name


def fetch_interval(wanted: str, native: set[str]) -> str:
    """The interval itself or the nearest one it is built from that a source has."""
    name = interval(wanted)
    usable = [n for n in (name, *FINER[name]) if n in native]
    if not usable:
        raise KeyError(f"no native interval for {wanted!r}")
    return usable[0]


def storage_interval(wanted: str) -> str:
    return wanted if wanted in STORED else FINER[wanted][0]


def is_intraday(name: str) -> bool:
    return LENGTH[interval(name)] < DAY


def checked_request(name: str, start: int, end: int) -> str:
    """The interval's name; ValueError for a range that is empty or costs too much."""
    name = interval(name)
    if end <= start:
        raise ValueError("a range ends after it starts")
    if bar_count(start, end, name) > MOST_BARS:
        raise ValueError(f"over {MOST_BARS} bars asked for")
    if is_intraday(name) and end - start > MOST_DAYS * DAY:
        raise ValueError(f"over {MOST_DAYS} days of bars within the day asked for")
    return name


def align_range(start: int, end: int, step: int) -> tuple[int, int]:
    """The range widened to the UTC grid."""
    return start - start % step, end + -end % step


def align_down(ms: Column, step: int) -> Column:
    return ms - F.pmod(ms, F.lit(step))


def align_up(ms: Column, step: int) -> Column:
    return ms + F.pmod(-ms, F.lit(step))


def bucket(ms: Column, name: str, zone: str = EXCHANGE_ZONE) -> Column:
    """The start of the bar that holds ``ms``: on the UTC grid, or local midnight for days."""
    return local_day_start(ms, zone) if name == "1d" else align_down(ms, LENGTH[name])


def bar_count(start: int, end: int, name: str) -> int:
    return max(0, (end - start) // LENGTH[name])


def cacheable_end(end: int, now: int, name: str) -> int:
    """The last two bars are still forming and are never recorded as covered."""
    return min(end, now - 2 * LENGTH[name])


def build_range(now: int, name: str, days: int) -> tuple[int, int]:
    """A range that ends with the running bar and spans ``days``."""
    end = now - now % LENGTH[name] + LENGTH[name]
    return end - days * DAY, end
