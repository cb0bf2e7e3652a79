"""File sources, and a Spark data source that reads a paged vendor."""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterable, Iterator

import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from barsmith.functions.intervals import CHUNK_DAYS, DAY, HISTORY_DAYS
from barsmith.functions.intervals import interval as checked_interval
from barsmith.functions.time import parse_time_param
from barsmith.operators.ingest import from_payloads

COLUMN_LIST = "columns array<string>, bars array<array<double>>"


def read_column_list(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars of a JSON file {columns, bars: [[t, o, h, l, c, v], ...]}."""
    rows = spark.read.schema(COLUMN_LIST).json(path, multiLine=True).select(F.explode("bars").alias("b"))
    names = ("time", "open", "high", "low", "close", "volume")
    return rows.select(F.lit(symbol).alias("symbol"), *(F.get("b", F.lit(i)).cast("bigint" if n == "time" else "double").alias(n) for i, n in enumerate(names)))


def write_column_list(bars: DataFrame, path: str) -> None:
    """One JSON object a symbol; for demo data, whose size is that of a file."""
    rows = bars.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("time", "open", "high", "low", "close", "volume"))), lambda b: F.array(*(b[c].cast("double") for c in ("time", "open", "high", "low", "close", "volume")))).alias("bars"))
    rows.select(F.array(*map(F.lit, ("time", "open", "high", "low", "close", "volume"))).alias("columns"), "bars", "symbol").write.partitionBy("symbol").mode("overwrite").json(path)


def read_vendor(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Raw rows of vendor JSON files in any of the known envelopes, one document a file."""
    text = spark.read.text(path, wholetext=True).select(F.lit(symbol).alias("symbol"), F.col("value").alias("payload"))
    return from_payloads(text)


def in_range(bars: DataFrame, start: int, end: int) -> DataFrame:
    return bars.where(F.col("time").between(start, end))


#: Tries of a page, first and longest pause in seconds, and the bounds of a pause that the vendor asks for.
TRIES, PAUSE, LONGEST, ASKED = 3, 0.5, 8.0, (0.5, 30.0)


class Refused(PermissionError):
    """The vendor knows the caller and says no (401, 403); asking again is of no use."""


class TooMany(ConnectionError):
    """The vendor wants fewer requests (429), perhaps after ``seconds``."""

    def __init__(self, message: str = "", seconds: float | None = None):
        super().__init__(message)
        self.seconds = seconds


class BadData(ValueError):
    """An answer that cannot be used: another client error, or a shape that is not known."""


def by_status(status: int, message: str = "", retry_after: str | None = None) -> Exception | None:
    """The error that stands for an HTTP status; None for success."""
    if status < 400:
        return None
    if status in (401, 403):
        return Refused(message)
    if status == 429:
        try:
            return TooMany(message, float(retry_after) if retry_after else None)
        except ValueError:
            return TooMany(message)
    return ConnectionError(message) if status >= 500 else BadData(message)


def pause(error: Exception, attempt: int) -> float:
    """Seconds to wait after a failed try: what the vendor asks for, within bounds, or twice as long each time."""
    asked = getattr(error, "seconds", None)
    return min(max(asked, ASKED[0]), ASKED[1]) if asked is not None else min(LONGEST, PAUSE * 2**attempt)


def answered(fetch: str, symbol: str, interval: str, start: int, end: int, options: dict) -> list:
    """What the function of that dotted name gives for a page; it is asked again after errors that may pass."""
    module, name = fetch.rsplit(".", 1)
    function = getattr(importlib.import_module(module), name)
    for attempt in range(TRIES):
        try:
            return function(symbol, interval, start, end, **options)
        except (ConnectionError, TimeoutError) as e:
            if attempt == TRIES - 1:
                raise
            time.sleep(pause(e, attempt))
    return []


def archive(symbol: str, interval: str, start: int, end: int, folder: str, token: str | None = None, needs: str | None = None) -> list[tuple]:
    """A vendor that is a folder of Parquet (symbol=.../...) in any file system that Arrow reads: bars of a half-open range.

    With ``needs``, only callers with that ``token`` are served.
    """
    if needs is not None and token != needs:
        raise by_status(401, "the token is not known")
    at = ds.field("time")
    rows = ds.dataset(f"{folder}/symbol={symbol}", format="parquet").to_table(columns=["time", "open", "high", "low", "close", "volume"], filter=(at >= start) & (at < end))
    return list(zip(*(rows.column(c).to_pylist() for c in rows.column_names)))


class Page(InputPartition):
    def __init__(self, symbol: str, start: int, end: int):
        self.symbol, self.start, self.end = symbol, start, end


def _bound(value) -> int | None:
    return int(value) if isinstance(value, int) and not isinstance(value, bool) else None


class PagedReader(DataSourceReader):
    """One task a page of time of a symbol; pages outside of pushed filters on symbol and time are not read.

    The fetching function raises the errors above, or :class:`ConnectionError` and :class:`TimeoutError`; the latter two
    and too many requests are tried again. An error of the last try stops the job; a chain of sources makes it a row.
    """

    def __init__(self, options: dict):
        self.options = options
        self.interval = checked_interval(options["interval"])
        self.symbols = [s.strip() for s in options["symbol"].split(",")]
        self.start, self.end = int(options["start"]), int(options["end"])
        self.step = int(options.get("page", CHUNK_DAYS.get(self.interval, 55) * DAY))
        if "oldest" in options:
            self.start = max(self.start, int(options["oldest"]))
        if "now" in options:
            self.start = max(self.start, int(options["now"]) - HISTORY_DAYS[self.interval] * DAY)
        self.low, self.high = self.start, self.end
        self.asked = {k.split(".", 1)[1]: v for k, v in options.items() if k.startswith("vendor.")}

    def pushFilters(self, filters: list) -> Iterable:
        """Takes bounds of time and lists of symbols in; all filters stay, as pages hold more than was asked for."""
        for f in filters:
            column, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if column == ("symbol",):
                wanted = {value} if isinstance(f, EqualTo) else set(value) if isinstance(f, In) else None
                self.symbols = [s for s in self.symbols if wanted is None or s in wanted]
            elif column == ("time",) and _bound(value) is not None:
                if isinstance(f, (GreaterThan, EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, value + (not isinstance(f, LessThan)))
            yield f

    def partitions(self) -> list[Page]:
        found = [Page(s, max(a, self.low), min(a + self.step, self.end, self.high)) for s in self.symbols for a in range(self.start, self.end, self.step)]
        return [p for p in found if p.start < p.end] or [Page("", 0, 0)]

    def read(self, page: Page) -> Iterator[tuple]:
        if page.start >= page.end:
            return
        for k, r in enumerate(answered(self.options["fetch"], page.symbol, self.interval, page.start, page.end, self.asked)):
            at = str(r[0])
            yield (page.symbol, page.start * 1000 + k, in_ms(at), *(None if x is None else str(x) for x in r[1:]))


def in_ms(text: str) -> int | None:
    """The time that a vendor wrote; None if it cannot be read."""
    try:
        return parse_time_param(text)
    except (ValueError, OverflowError):
        return None


class PagedSource(DataSource):
    """``spark.read.format("paged_bars")``: bars of a vendor, a task a page.

    Options: symbol (or several, with commas between them), interval, start, end (exclusive), fetch (the dotted name of
    ``fetch(symbol, interval, start, end, ...)``), and perhaps page (milliseconds; by default what sources allow for the
    interval), oldest, now (then what is older than sources keep is not asked for), and ``vendor.x`` for an argument x of the function
    (a token, an address). Filters on symbol and time are pushed down where ``spark.sql.python.filterPushdown.enabled`` is set.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return "symbol string, ingest_seq bigint, time bigint, open string, high string, low string, close string, volume string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))
