"""Sources of bars, and chains of them: what one fails to give, the next one is asked for.

A fetch is a table of ranges (symbol, start, end; closed, in milliseconds). A source cuts it into pages, and gives back one
row a page with its bars or the error that it met, so a failure is data: it stops no job, and pages that failed are
the ranges that the next source is asked for. Pages are fetched on the executors, each in the task that Spark deals it to.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions.intervals import CHUNK_DAYS, DAY, HISTORY_DAYS, bucket, fetch_interval
from barsmith.operators.bars import resample
from barsmith.operators.ingest import normalize
from barsmith.operators.tables import kept
from barsmith.sources.files import BadData, Refused, answered

RAW = ("time", "open", "high", "low", "close", "volume")
PAGE = f"symbol string, start bigint, end bigint, reason string, error string, permanent boolean, bars array<struct<{', '.join(f'{c}: string' for c in RAW)}>>"
ROWS = "symbol string, time bigint, open double, high double, low double, close double, volume double, provider string"
OUTCOMES = "symbol string, start bigint, end bigint, provider string, quality string, reason string, failed boolean"


def pages_of(requests: DataFrame, interval: str, now: int | None = None, page: int | None = None) -> DataFrame:
    """(symbol, start, end, reason): closed ranges cut into pages that do not overlap.

    A page is as long as sources allow for the interval. With ``now``, what is older than they keep is cut off; a range of
    which nothing is left is one page that ends before it starts.
    """
    length = page or CHUNK_DAYS[interval] * DAY
    reason = F.col("reason") if "reason" in requests.columns else F.lit(None).cast("string")
    oldest = F.lit(now - HISTORY_DAYS[interval] * DAY if now is not None else 0).cast("bigint")
    cut = requests.select("symbol", F.greatest("start", oldest).alias("from") if now is not None else F.col("start").alias("from"), F.col("end").alias("to"), reason.alias("reason"))
    starts = F.when(F.col("from") <= F.col("to"), F.sequence("from", "to", F.lit(length).cast("bigint"))).otherwise(F.array("from"))
    each = cut.withColumn("start", F.explode(starts))
    return each.select("symbol", "start", F.least(F.col("start") + length - 1, "to").alias("end"), "reason")


@dataclass(frozen=True)
class Vendor:
    """A source whose pages are fetched on the executors by a function known by its dotted name.

    ``fetch(symbol, interval, start, end, **options)`` gives the rows of a half-open range or raises the errors of
    :mod:`barsmith.sources.files`. ``limited`` cuts off what is older than :data:`HISTORY_DAYS`; with
    ``needs_rows`` a page without rows is an error.
    """

    name: str
    fetch: str
    native: frozenset[str]
    quality: str = "delayed"
    options: dict = field(default_factory=dict)
    page: int | None = None
    limited: bool = False
    needs_rows: bool = False

    def pages(self, requests: DataFrame, interval: str, now: int) -> DataFrame:
        fetch, options, needs_rows = self.fetch, dict(self.options), self.needs_rows
        shape = pa.list_(pa.struct([(c, pa.string()) for c in RAW]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    error, bars = None, []
                    if row["start"] <= row["end"]:
                        try:
                            found = answered(fetch, row["symbol"], interval, row["start"], row["end"] + 1, options)
                            bars = [dict(zip(RAW, (None if x is None else str(x) for x in r))) for r in found]
                            if needs_rows and not bars:
                                raise BadData("no bars")
                        except Exception as e:  # a failure is a row: the next source is asked
                            error, bars = e, None
                    columns = [[row["symbol"]], [row["start"]], [row["end"]], [row["reason"]], [None if error is None else f"{error}" or type(error).__name__], [isinstance(error, Refused)]]
                    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
                    yield pa.record_batch([*map(pa.array, columns, types), pa.array([bars], shape)], names=["symbol", "start", "end", "reason", "error", "permanent", "bars"])

        dealt = pages_of(requests, interval, now if self.limited else None, self.page).repartition("symbol", "start")
        return dealt.mapInArrow(run, PAGE)


@dataclass(frozen=True)
class Table:
    """A source that is a table of bars (symbol, time, open, high, low, close, volume) of one interval."""

    name: str
    bars: DataFrame
    interval: str
    quality: str = "delayed"

    @property
    def native(self) -> frozenset[str]:
        return frozenset((self.interval,))

    def pages(self, requests: DataFrame, interval: str, now: int) -> DataFrame:
        asked = pages_of(requests, interval).withColumn("span", F.explode(F.sequence(F.floor(F.col("start") / (30 * DAY)), F.floor(F.col("end") / (30 * DAY)))))
        rows = self.bars.select(F.col("symbol").alias("_s"), F.floor(F.col("time") / (30 * DAY)).alias("_span"), F.col("time").alias("_time"), F.struct(*(F.col(c).cast("string").alias(c) for c in RAW)).alias("bar"))
        met = asked.join(rows, (F.col("symbol") == F.col("_s")) & (F.col("span") == F.col("_span")) & F.col("_time").between(F.col("start"), F.col("end")), "left")
        return met.groupBy("symbol", "start", "end", "reason").agg(F.collect_list("bar").alias("bars")).select("symbol", "start", "end", "reason", F.lit(None).cast("string").alias("error"), F.lit(False).alias("permanent"), "bars")


@dataclass
class Health:
    """Which sources rest, and why. It is told how the pages of each source went."""

    #: Seconds of rest after an error, and after one that will not pass by itself; fallbacks remembered.
    rest: float = 120.0
    long_rest: float = 900.0
    remembered: int = 25
    clock: Callable[[], float] = time.monotonic
    until: dict[str, float] = field(default_factory=dict)
    reasons: dict[str, str] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)

    def usable(self, name: str) -> bool:
        return self.until.get(name, 0.0) <= self.clock()

    def fell_back(self, name: str, to: str | None, reason: str) -> None:
        self.history = [{"source": name, "to": to, "reason": reason}, *self.history][: self.remembered]

    def told(self, name: str, pages: int, failed: int, permanent: bool, reason: str | None) -> None:
        """A source rests if no page came through, or if it refused one for good."""
        if failed and (failed == pages or permanent):
            self.until[name], self.reasons[name] = self.clock() + (self.long_rest if permanent else self.rest), reason or ""
        elif pages:
            self.until.pop(name, None)
            self.reasons.pop(name, None)

    def status(self, names: list[str]) -> list[dict]:
        """Each source in order: whether it may be asked, whether it is about to be tried again, and how long it rests."""
        now = self.clock()
        ends = {n: self.until.get(n) for n in names}
        return [{"source": n, "usable": e is None or e <= now, "probing": e is not None and e <= now, "seconds": max(0.0, e - now) if e is not None else 0.0, "reason": self.reasons.get(n)} for n, e in ends.items()]


@dataclass(frozen=True)
class Fetched:
    """``rows``: bars with their provider. ``outcomes``: one row a page that was served or given up. ``health``: one a source."""

    rows: DataFrame
    outcomes: DataFrame
    health: DataFrame


@dataclass
class Chain:
    """Sources in order of preference."""

    sources: list
    health: Health = field(default_factory=Health)

    def fetch(self, requests: DataFrame, interval: str, now: int) -> Fetched:
        """Bars of (symbol, start, end) ranges at ``interval``.

        Each source is asked once for what is still missing, at the interval or the nearest one it is built from. One job runs a
        source; its pages are kept in the shared folder, and only their counts reach the driver.
        """
        spark = requests.sparkSession
        pending = requests.select("symbol", "start", "end", F.lit(None).cast("string").alias("reason"))
        served, told, coarser = [], [], False
        for k, source in enumerate(self.sources):
            after = self.sources[k + 1].name if k + 1 < len(self.sources) else None
            skip, native = None, None
            if not self.health.usable(source.name):
                skip = f"unavailable: {self.health.reasons.get(source.name, 'it failed a short time ago')}"
            else:
                try:
                    native = fetch_interval(interval, source.native)
                except KeyError:
                    skip = f"cannot serve {interval}"
            if skip:
                self.health.fell_back(source.name, after, skip)
                told.append((k, source.name, 0, 0, False, skip))
                pending = pending.withColumn("reason", F.coalesce("reason", F.lit(f"{source.name} {skip}")))
                continue
            found = kept(source.pages(pending, native, now), "pages")
            failed = F.col("error").isNotNull()
            count = found.agg(F.count(F.lit(1)), F.count_if(failed), F.coalesce(F.max("permanent"), F.lit(False)), F.min_by("error", F.struct(~failed, "symbol", "start"))).first()
            told.append((k, source.name, *count))
            self.health.told(source.name, *count)
            if count[1]:
                self.health.fell_back(source.name, after, count[3])
            coarser |= native != interval
            served.append(found.where(~failed).withColumns({"provider": F.lit(source.name), "quality": F.lit(source.quality), "_k": F.lit(k)}))
            pending = found.where(failed).select("symbol", "start", "end", F.coalesce("reason", F.concat(F.lit(f"{source.name}: "), "error")).alias("reason"))
            if not count[1]:
                pending = pending.limit(0)
                break
        left = pending.select("symbol", "start", "end", F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("quality"), "reason", F.lit(True).alias("failed"))
        rows, outcomes = spark.createDataFrame([], ROWS), left
        if served:
            every = served[0]
            for part in served[1:]:
                every = every.unionByName(part)
            outcomes = every.select("symbol", "start", "end", "provider", "quality", "reason", F.lit(False).alias("failed")).unionByName(left)
            raw = every.select("symbol", "provider", F.posexplode("bars").alias("ingest_seq", "bar")).select("symbol", "ingest_seq", "provider", "bar.*")
            rows = self._clean(raw, interval, coarser)
        return Fetched(rows, outcomes, spark.createDataFrame(told, "place int, source string, pages bigint, failed bigint, permanent boolean, reason string"))

    @staticmethod
    def _clean(raw: DataFrame, interval: str, coarser: bool) -> DataFrame:
        """Pages do not overlap, so a time has one provider; a coarser bar has that of its last part."""
        who = normalize(raw.withColumn("symbol", F.struct("symbol", "provider"))).select("symbol.*", *(c for c in RAW))
        if not coarser:
            return who
        of = who.groupBy("symbol", bucket(F.col("time"), interval).alias("time")).agg(F.max_by("provider", "time").alias("provider"))
        return resample(who.drop("provider"), interval).join(of, ["symbol", "time"])


def no_pages(spark: SparkSession) -> Fetched:
    """What a fetch of nothing gives: no source is asked."""
    return Fetched(spark.createDataFrame([], ROWS), spark.createDataFrame([], OUTCOMES), spark.createDataFrame([], "place int, source string, pages bigint, failed bigint, permanent boolean, reason string"))
