"""The three analyses: bars, structure, backtest. Each is one plan over a table of bars."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.functions.intervals import LENGTH, align_down, align_range, align_up, cacheable_end, checked_request, interval, storage_interval
from barsmith.operators import divergence, gaps, metrics, similarity, simulate, structure
from barsmith.operators.bars import resample, tail
from barsmith.operators.blocks import indexed
from barsmith.operators.ranges import coalesce
from barsmith.operators.store import PART, Store, latest_provider
from barsmith.operators.tables import kept
from barsmith.plans.present import as_json, configuration, fallback, of_kind, rounded, trusted
from barsmith.sources import chain
from barsmith.sources.catalog import quality

#: Most symbols, matches, and rows of each kind that an answer holds; windows of a search; bars of a pattern.
MOST_SYMBOLS, MOST_MATCHES, SWINGS, GAPS, DIVERGENCES = 3, 25, 600, 400, 200
MOST_WINDOWS, LEAST_BARS = 250_000, 5


def bars(stored: DataFrame, symbol: str, name: str, start: int, end: int) -> DataFrame:
    """Bars of one symbol in a closed range.

    Only stored rows of the interval that ``name`` is kept as or built from are read, in the range and one bar on
    each side of it, so that bars at its ends are whole. Tables of one interval need no column ``interval``.
    """
    name = checked_request(name, start, end)
    source, step = storage_interval(name), LENGTH[name]
    low, high = align_range(start - step, end + step, LENGTH[source])
    rows = stored.where((F.col("symbol") == symbol) & F.col("time").between(low, high))
    if "interval" in stored.columns:
        rows = rows.where(F.col("interval") == source)
    rows = rows.select("symbol", "time", "open", "high", "low", "close", "volume")
    return (rows if name == source and "interval" in stored.columns else resample(rows, name)).where(F.col("time").between(start, end))


@dataclass(frozen=True)
class Served:
    """``bars`` of all symbols; ``state``: one row a symbol that says where they came from; ``health``: one row a source."""

    bars: DataFrame
    state: DataFrame
    health: DataFrame


def padded(requests: DataFrame, name: str) -> DataFrame:
    """Ranges widened by a bar on each side and to the grid on which ``name`` is stored."""
    source = storage_interval(name)
    low, high = F.col("start") - LENGTH[name], F.col("end") + LENGTH[name]
    return requests.select("symbol", F.lit(source).alias("interval"), align_down(low, LENGTH[source]).alias("start"), align_up(high, LENGTH[source]).alias("end"))


def read_through(store: Store, requests: DataFrame, name: str, sources: chain.Chain, now: int, *, refresh: bool = False) -> Served:
    """Bars of (symbol, start, end), one range a symbol: what the cache lacks is fetched, kept, and then all is read from it.

    Missing ranges of all symbols are fetched together, each by the first source of the chain that gives it. What was
    fetched counts as covered up to the last two bars, which are still forming, so those are asked for again. A range
    that no source gives is no error: the bars that there are come back, and the symbol's state says ``partial`` and why.
    If nothing is missing, no source is asked. ``refresh`` fetches what is covered too.
    """
    name = interval(name)
    source, step = storage_interval(name), LENGTH[storage_interval(name)]
    requests = kept(requests.select("symbol", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")), "requests")
    wanted = padded(requests, name)
    gaps = kept(coalesce(wanted if refresh else store.missing(wanted), step), "gaps")
    got = chain.no_pages(requests.sparkSession) if gaps.isEmpty() else sources.fetch(gaps, source, now)
    outcomes = kept(got.outcomes, "outcomes")
    served = outcomes.where("not failed")
    if not served.isEmpty():
        store.save_candles(got.rows.withColumns({"interval": F.lit(source), "fetched_at": F.lit(now).cast("bigint")}))
        settled = served.select("symbol", F.lit(source).alias("interval"), "start", F.least("end", F.lit(cacheable_end(now, now, source))).alias("end"))
        store.record_coverage(settled.where("start <= end"))
    stored = store.candles().where(F.col("interval") == source)
    near = padded(requests, name).select("symbol", F.col("start").alias("_low"), F.col("end").alias("_high"))
    parts = near.withColumn("part", F.explode(F.sequence(F.floor(F.col("_low") / PART), F.floor(F.col("_high") / PART))))
    rows = stored.join(parts, ["symbol", "part"]).where(F.col("time").between(F.col("_low"), F.col("_high"))).select("symbol", "time", "open", "high", "low", "close", "volume")
    bars_ = (rows if name == source else resample(rows, name)).join(requests, "symbol").where(F.col("time").between(F.col("start"), F.col("end"))).drop("start", "end")
    return Served(bars_, _state(store, requests, outcomes, source, sources), got.health)


def _state(store: Store, requests: DataFrame, outcomes: DataFrame, source: str, sources: chain.Chain) -> DataFrame:
    """(symbol, provider, quality, trusted, cached, fallback, reason, ranges, failed): one row a symbol."""
    preferred = sources.sources[0].name
    ok = ~F.col("failed")
    last = F.max_by(F.when(ok, F.struct("provider", "quality")), F.when(ok, F.col("start")))
    told = outcomes.groupBy("symbol").agg(F.count(F.lit(1)).alias("ranges"), F.count_if("failed").alias("failed"), last.alias("last"), F.min_by("reason", F.struct(F.col("reason").isNull(), ok, "start")).alias("why"))
    told = requests.select("symbol").join(told, "symbol", "left").fillna(0, ["ranges", "failed"])
    known = latest_provider(store.candles().where(F.col("interval") == source)).select("symbol", F.col("provider").alias("known"))
    rows = told.join(known, "symbol", "left")
    fetched = F.col("last").isNotNull()
    provider = F.coalesce("last.provider", F.when(F.col("failed") == 0, F.col("known")), F.lit(preferred))
    missing = F.concat(F.col("failed").cast("string"), F.lit(" of "), F.col("ranges").cast("string"), F.lit(" missing ranges could not be fetched"))
    reason = F.when(F.col("failed") > 0, F.concat_ws(": ", missing, "why")).otherwise(F.col("why"))
    state = quality(F.col("failed") > 0, fetched, F.col("last.quality"))
    rows = rows.select("symbol", provider.alias("provider"), state.alias("quality"), (~fetched).alias("cached"), reason.alias("reason"), "ranges", "failed")
    return rows.withColumns({"trusted": trusted(F.col("quality")), "fallback": fallback(F.col("failed") > 0, F.col("provider"), F.lit(preferred))})


def warnings(series: DataFrame, primary: str, references: list[str], strength: int) -> DataFrame:
    """(reference_symbol, code, warning): references that cannot be compared, or only with care.

    Codes: ``too_few_bars``, ``no_shared_bars``, ``mixed_source`` (if the table tells providers).
    """
    spark = series.sparkSession
    wanted = spark.createDataFrame([(r,) for r in references], "reference_symbol string")  # at most two
    counts = wanted.join(divergence.shared_bars(series, primary, references), "reference_symbol", "left")
    provider = F.max_by("provider", "time") if "provider" in series.columns else F.lit(None).cast("string")
    of = series.groupBy("symbol").agg(provider.alias("provider") if "provider" in series.columns else F.first(provider).alias("provider"))
    mine = of.where(F.col("symbol") == primary).select(F.col("provider").alias("_mine"), F.lit(1).alias("_one"))
    counts = counts.join(of.withColumnRenamed("symbol", "reference_symbol"), "reference_symbol", "left").withColumn("_one", F.lit(1)).join(mine, "_one", "left")
    few = F.coalesce("bars", F.lit(0)) < 2 * strength + 1
    code = F.when(few, "too_few_bars").when(F.col("shared") == 0, "no_shared_bars").when(F.col("provider") != F.col("_mine"), "mixed_source")
    text = (
        F.when(few, F.concat("reference_symbol", F.lit(f" has too few bars here to be compared with {primary}")))
        .when(F.col("shared") == 0, F.concat("reference_symbol", F.lit(f" and {primary} have no bar time in common")))
        .otherwise(F.concat(F.lit("mixed-source: "), "reference_symbol", F.lit(" is from "), "provider", F.lit(f", {primary} from "), "_mine", F.lit("; do not rely on their divergences")))
    )
    return counts.withColumn("code", code).where("code is not null").select("reference_symbol", "code", text.alias("warning"))


def structure_of(series: DataFrame, primary: str, references: list[str], *, strength: int = 2, min_gap_percent: float = 0.0, include_filled: bool = True, kind: str | None = None) -> dict[str, DataFrame]:
    """``swings``, ``gaps``, ``divergences`` and ``warnings`` of a primary symbol against up to two others, the most recent ones.

    Leaving out filled gaps also takes them from the primary gaps that divergences are placed in. References with
    too few bars are not compared. ``kind`` keeps highs or lows among the swings shown.
    """
    if not 1 <= strength <= 20 or not 0 <= min_gap_percent <= 10:
        raise ValueError("strength is 1 to 20, min_gap_percent 0 to 10")
    references = [r for r in dict.fromkeys(references) if r != primary][: MOST_SYMBOLS - 1]
    rows = kept(indexed(series.where(F.col("symbol").isin(primary, *references))), "structure")
    swings = structure.swing_points(rows, strength)
    every = kept(gaps.fair_value_gaps(rows, min_gap_percent), "gaps")
    shown = every if include_filled else every.where("not filled")
    mine = lambda df: df.where(F.col("symbol") == primary)
    points = mine(swings) if kind is None else of_kind(mine(swings), kind)
    out = {"swings": tail(points, SWINGS, ["symbol"], [F.desc("time"), F.desc("kind")]), "gaps": rounded(tail(mine(shown), GAPS, ["symbol"], [F.desc("time")]))}
    if references:
        enough = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * strength + 1).select("symbol")
        found = divergence.between(rows, swings, every, primary, references, shown=mine(shown)).join(enough.withColumnRenamed("symbol", "reference_symbol"), "reference_symbol", "left_semi")
        place = F.array_position(F.array(*map(F.lit, references)), F.col("reference_symbol"))
        out["divergences"] = rounded(tail(found.withColumn("_r", place), DIVERGENCES, ["primary_symbol"], [F.desc("end_time"), F.desc("_r"), F.desc("kind")]).drop("_r"))
        out["warnings"] = warnings(rows, primary, references, strength)
    return out


@dataclass(frozen=True)
class Request:
    primary: str
    symbols: tuple[str, ...]
    selection: tuple[int, int]
    lookback: tuple[int, int]
    interval: str = "1h"
    length: int | None = None
    threshold: float = 0.75
    matches: int = 10
    separation: int | None = None
    exclude_selection: bool = True
    rules: simulate.Rules = field(default_factory=simulate.Rules)

    def __post_init__(self):
        if not 1 <= self.matches <= MOST_MATCHES or not 0 <= self.threshold <= 1:
            raise ValueError("matches is 1 to 25, threshold 0 to 1")
        if self.selection[0] >= self.selection[1] or self.lookback[0] >= self.lookback[1]:
            raise ValueError("a range ends before it starts")
        if self.selection[1] - self.selection[0] < LEAST_BARS * LENGTH[interval(self.interval)]:
            raise ValueError(f"a selection spans {LEAST_BARS} bars at least")
        if self.length is not None and not 5 <= self.length <= 400:
            raise ValueError("a pattern has 5 to 400 bars")
        if self.separation is not None and self.separation < 1:
            raise ValueError("separation is at least one bar")

    @property
    def searched(self) -> tuple[str, ...]:
        """The primary symbol first, each once."""
        return tuple(dict.fromkeys((self.primary, *self.symbols)))[:MOST_SYMBOLS]


#: What every backtest takes for granted.
ASSUMPTIONS = (
    "a bar that reaches both stop and target counts as stopped",
    "a bar that opens past a stop or target trades at its open",
    "slippage makes entry and exit worse",
    "fees are a percentage of the position, paid at entry and at exit",
    "what is still open after the longest holding time is closed at that bar's close",
    "returns are percentages of the entry price, without multipliers, margin or financing",
    "matches come from a fixed comparison of features, not from a trained model",
)


def notes(rows: DataFrame, request: Request, resampled: int | None, state: DataFrame | None = None) -> DataFrame:
    """(place, note): what the data was, and what was assumed. ``state`` (of a read through the cache) tells why a symbol's bars are not what was wanted."""
    provider = F.array_join(F.array_sort(F.collect_set("provider")), ", ") if "provider" in rows.columns else F.lit(None).cast("string")
    each = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).select(F.lit(2).alias("place"), F.concat("symbol", F.lit(": searched "), F.col("n").cast("string"), F.lit(f" bars of {request.interval}")).alias("note"))
    from_ = rows.agg(provider.alias("p") if "provider" in rows.columns else F.first(provider).alias("p")).where("p is not null")
    sources = from_.select(F.lit(0).alias("place"), F.concat(F.lit("source: "), "p").alias("note"))
    synthetic = from_.where(F.array_contains(F.split("p", ", "), "demo")).select(F.lit(1).alias("place"), F.lit("demo bars are made up from a seed; they are no market data").alias("note"))
    fixed = ["contracts are strung together without adjustment, so prices may jump where they change", "trades may overlap" if request.rules.overlap else "a match that begins before the last trade ends is left out"]
    if resampled:
        fixed.append(f"the selection was resampled to {resampled} bars")
    fixed += ASSUMPTIONS
    if state is not None:
        reasons = state.where(F.col("reason").isNotNull() & F.col("symbol").isin(*request.searched))
        each = each.unionByName(reasons.select(F.lit(2).alias("place"), F.concat("symbol", F.lit(": "), "reason").alias("note")))
    return each.unionByName(sources).unionByName(synthetic).unionByName(rows.sparkSession.createDataFrame([(3 + k, n) for k, n in enumerate(fixed)], "place int, note string"))


def save(store: Store, request: Request, out: dict[str, DataFrame], run: str, now: int) -> None:
    """Persists what a backtest gave under the id ``run``: matches and trades, and last the header with its request and summary as JSON."""
    name = F.lit(run).alias("run")
    summary = as_json(out["summary"], "summary")
    header = summary.select(F.lit(now).cast("bigint").alias("created_at"), F.lit(request.primary).alias("primary_symbol"), F.lit(request.interval).alias("interval"), F.lit("done").alias("status"), F.lit(configuration(request)).alias("configuration"), "summary", name)
    store.save_run(header, out["matches"].withColumn("run", name), out["trades"].withColumn("run", name))


def backtest(series: DataFrame, request: Request, state: DataFrame | None = None) -> dict[str, DataFrame]:
    """``matches`` with outcomes and their normalised closes, numbered ``trades``, ``skipped``, ``summary``, ``equity`` and ``notes`` of one pattern."""
    inside = lambda r: F.col("time").between(*r)
    query = similarity.pattern(series.where((F.col("symbol") == request.primary) & inside(request.selection)), request.length)
    hold = request.rules.hold
    rows = indexed(series.where(F.col("symbol").isin(*request.searched) & inside(request.lookback)))
    usable = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= query.length + hold + 2).select("symbol")
    rows = kept(rows.join(usable, "symbol", "left_semi"), "searched")
    similarity.guarded(rows, query.length, MOST_WINDOWS)
    excluded = [(request.primary, *request.selection)] if request.exclude_selection else []
    found = similarity.eligible(similarity.scores(rows, query), rows, threshold=request.threshold, future=hold + 2, exclude_of=excluded)
    best = kept(similarity.spaced(found, request.matches, request.separation or max(1, query.length // 2)).drop("rank"), "spaced")
    best = similarity.overall(best, request.matches).withColumn("id", similarity.match_id(length=query.length))
    best = kept(similarity.with_series(rows, best), "matches")
    trades = kept(simulate.simulate(rows, best, request.rules), "trades")
    done = simulate.numbered(trades)
    total, skipped = best.count(), trades.where("skip_reason is not null").count()  # at most MOST_MATCHES
    return {
        "matches": simulate.outcomes(best, trades), "trades": done, "skipped": trades.where("skip_reason is not null").select("id", "skip_reason"),
        "summary": metrics.summary(done, total, skipped), "equity": metrics.equity_curve(done), "notes": notes(rows, request, query.length if query.length != query.selected else None, state),
    }
