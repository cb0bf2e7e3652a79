"""Search of a series for windows that look like a pattern."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.operators.blocks import BLOCK, in_blocks, indexed
from barsmith.operators.ranges import outside

#: What counts as zero, bars of the trailing deviation, windows scored at once.
EPSILON, TRAIL, AT_ONCE = 1e-12, 5, 4096
#: The parts of a feature vector, in order, and their weights.
WEIGHTS = (("normalised_close", 1.0), ("returns", 0.9), ("body", 0.6), ("upper_wick", 0.4), ("lower_wick", 0.4), ("volatility", 0.5), ("volume", 0.3))


def _ratio(a: np.ndarray, b: np.ndarray, otherwise: float) -> np.ndarray:
    safe = np.abs(b) > EPSILON
    return np.where(safe, a / np.where(safe, b, 1.0), otherwise)


def features(o: np.ndarray, h: np.ndarray, l: np.ndarray, c: np.ndarray, v: np.ndarray, volume: bool) -> np.ndarray:
    """One vector a row for windows given as (windows, length) arrays."""
    moves = np.zeros_like(c)
    moves[:, 1:] = _ratio(c[:, 1:] - c[:, :-1], c[:, :-1], 0.0)
    span = h - l
    live = span > EPSILON
    part = lambda x: np.where(live, x / np.where(live, span, 1.0), 0.0)
    trail = np.stack([moves[:, max(0, i - TRAIL + 1) : i + 1].std(axis=1) for i in range(moves.shape[1])], axis=1)
    parts = [_ratio(c, c[:, :1], 1.0) - 1.0, moves, part(c - o), part(h - np.maximum(o, c)), part(np.minimum(o, c) - l), _ratio(trail, trail.mean(axis=1, keepdims=True), 1.0)]
    if volume:
        logged = np.log1p(np.maximum(v, 0.0))
        parts.append(_ratio(logged, logged.mean(axis=1, keepdims=True), 1.0))
    out = []
    for x, (_, weight) in zip(parts, WEIGHTS):
        centred = x - x.mean(axis=1, keepdims=True)
        sigma = np.sqrt((centred**2).mean(axis=1, keepdims=True))
        out.append(np.where(sigma > EPSILON, centred / np.where(sigma > EPSILON, sigma, 1.0), 0.0) * weight)
    return np.hstack(out)


#: Windows whose running sums are made together, and when a window's are too inexact: its variance beside that of all of
#: them, and its squared distance beside that of the pattern.
TOGETHER, THIN, NEAR = 512, 1e-4, 1e-3


def _running(x: np.ndarray, size: int, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum, sum of squares, and product with a kernel, of each stretch of ``size`` values."""
    wide = np.concatenate(([0.0], x)).astype(np.longdouble)
    total, squares = np.cumsum(wide), np.cumsum(wide * wide)
    return total[size:] - total[:-size], squares[size:] - squares[:-size], np.einsum("ij,j->i", np.lib.stride_tricks.sliding_window_view(x, size), kernel)


def _parts_of(bars: tuple[np.ndarray, ...], size: int, volume: bool) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """Each part of a feature vector as (values a bar, how many values at a window's start are others, those values a window)."""
    o, h, l, c, v = bars
    n = len(c) - size + 1
    moves = np.zeros_like(c)
    moves[1:] = _ratio(c[1:] - c[:-1], c[:-1], 0.0)
    span = h - l
    live = span > EPSILON
    part = lambda x: np.where(live, x / np.where(live, span, 1.0), 0.0)
    trail = np.zeros_like(c)
    if len(c) >= TRAIL:
        trail[TRAIL - 1 :] = np.lib.stride_tricks.sliding_window_view(moves, TRAIL).std(axis=1)
    # the first deviations of a window look back to its first bar only, which has moved by nothing
    early = np.zeros((n, min(TRAIL, size)))
    for i in range(1, early.shape[1]):
        seen = np.lib.stride_tricks.sliding_window_view(moves[1:], i)[:n]
        early[:, i] = np.hstack([np.zeros((n, 1)), seen]).std(axis=1)
    none = np.zeros((n, 0))
    parts = [(c, 0, none), (moves, 1, np.zeros((n, 1))), (part(c - o), 0, none), (part(h - np.maximum(o, c)), 0, none), (part(np.minimum(o, c) - l), 0, none), (trail, early.shape[1], early)]
    if volume:
        parts.append((np.log1p(np.maximum(v, 0.0)), 0, none))
    return parts


def window_scores(bars: tuple[np.ndarray, ...], size: int, q: np.ndarray, volume: bool) -> tuple[np.ndarray, np.ndarray]:
    """Similarity and distance of each window of a series to the vector ``q``, without a vector a window.

    A standardised part takes its product with the pattern from three running values: sum, sum of squares, and product with the
    pattern's part. Sums are made of a few hundred windows at a time, about their mean and in extended precision. Windows
    with a part that hardly moves beside those around it, and those that nearly equal the pattern, are worked out
    from their vectors instead.
    """
    n = len(bars[3]) - size + 1
    parts, of_q = _parts_of(bars, size, volume), q.reshape(-1, size)
    similar, far, again = np.empty(n), np.empty(n), np.zeros(n, bool)
    whole = float(np.linalg.norm(q))
    for a in range(0, n, TOGETHER):
        b = min(n, a + TOGETHER)
        product, norm, thin = np.zeros(b - a), np.zeros(b - a), np.zeros(b - a, bool)
        for k, ((x, first, others), kernel, (_, weight)) in enumerate(zip(parts, of_q, WEIGHTS)):
            total, squares, dot = np.zeros(b - a, np.longdouble), np.zeros(b - a, np.longdouble), np.zeros(b - a)
            mine = x[a + first : b + size - 1]
            if first < size:
                shift = float(mine.mean()) if not first else 0.0
                total, squares, dot = _running(mine - shift, size - first, kernel[first:])
                spread = float((mine - shift).var())
            else:
                shift, spread = 0.0, 0.0
            if first:
                early = others[a:b]
                total, squares, dot = total + early.sum(axis=1), squares + (early * early).sum(axis=1), dot + early @ kernel[:first]
                spread = max(spread, float(early.var()))
            mean = total / size
            variance = np.maximum((squares / size - mean * mean).astype(np.float64), 0.0)
            sigma = np.sqrt(variance)
            # what the part is divided by before it is standardised
            scale = np.abs(x[a:b]) if k == 0 else np.abs((mean + shift).astype(np.float64)) if k in (5, 6) else np.ones(b - a)
            live = (scale > EPSILON) & (sigma > EPSILON * scale)
            if spread > 0:
                thin |= variance < THIN * spread
            else:
                live &= False
            product += np.where(live, weight * (dot - mean.astype(np.float64) * kernel.sum()) / np.where(live, sigma, 1.0), 0.0)
            norm += np.where(live, weight * weight * size, 0.0)
        both = np.sqrt(norm) * whole
        similar[a:b] = np.where(both > EPSILON, product / np.where(both > EPSILON, both, 1.0), 0.0)
        square = norm + whole * whole - 2 * product
        far[a:b] = np.sqrt(np.maximum(square, 0.0)) / max(np.sqrt(len(q)), EPSILON)
        again[a:b] = thin | (square < NEAR * max(whole * whole, EPSILON))
    rest = np.nonzero(again)[0]
    for i in range(0, len(rest), AT_ONCE):
        at = rest[i : i + AT_ONCE]
        m = features(*(np.lib.stride_tricks.sliding_window_view(x, size)[at] for x in bars), volume)
        norm = np.linalg.norm(m, axis=1) * whole
        similar[at] = np.where(norm > EPSILON, m @ q / np.where(norm > EPSILON, norm, 1.0), 0.0)
        far[at] = np.linalg.norm(m - q, axis=1) / max(np.sqrt(len(q)), EPSILON)
    return similar, far


def resample(series: np.ndarray, length: int) -> np.ndarray:
    """Linear interpolation of a series over 0..1 at ``length`` points."""
    if len(series) == 1:
        return np.full(length, series[0])
    return np.interp(np.linspace(0, 1, length), np.linspace(0, 1, len(series)), series)


@dataclass(frozen=True)
class Pattern:
    """What is looked for; a few hundred numbers on the driver."""

    length: int
    bars: np.ndarray  # (5, length): open, high, low, close, volume
    normalized: tuple[float, ...]
    selected: int

    def vector(self, volume: bool) -> np.ndarray:
        return features(*(row[None] for row in self.bars), volume)[0]

    @property
    def has_volume(self) -> bool:
        return bool((self.bars[4] > 0).any())


def pattern(selection: DataFrame, length: int | None = None, least: int = 5, most: int = 400) -> Pattern:
    """The pattern of the bars of a selection, resampled if another length is asked for."""
    rows = selection.orderBy("time").select("open", "high", "low", "close", "volume").limit(most * 50).toPandas().to_numpy(np.float64)
    wanted = length or len(rows)
    if len(rows) < least or not least <= wanted <= most:
        raise ValueError(f"a pattern has {least} to {most} bars")
    columns = rows.T
    if wanted != len(rows):
        columns = np.stack([resample(x, wanted) for x in columns])
    closes = rows[:, 3]
    return Pattern(wanted, columns, tuple(round(float(x), 4) for x in (closes / closes[0] - 1) * 100), len(rows))


def scores(bars: DataFrame, query: Pattern) -> DataFrame:
    """(symbol, start_index, end_index, start_time, end_time, entry_price, similarity, distance) of every window.

    Volume counts if the pattern has any and the symbol's series has any. Each block of positions is a
    task of its own with the window length of overlap, and works with running sums (:func:`window_scores`).
    """
    size = query.length
    rows = bars if "index" in bars.columns else indexed(bars)
    some = rows.groupBy("symbol").agg(F.max(F.col("volume") > 0).alias("_some"))
    dealt = in_blocks(rows.join(some, "symbol"), 0, size - 1, BLOCK)
    vectors = {volume: query.vector(volume) for volume in (False, True)}
    of_query = query.has_volume

    def score(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("index")
        n = len(part) - size + 1
        columns = ["symbol", "start_index", "end_index", "start_time", "end_time", "entry_price", "similarity", "distance"]
        if n < 1:
            return pd.DataFrame(columns=columns)
        volume = of_query and bool(part["_some"].iloc[0])
        q = vectors[volume]
        similar, far = window_scores(tuple(part[c].to_numpy(np.float64) for c in ("open", "high", "low", "close", "volume")), size, q, volume)
        at, time = part["index"].to_numpy(), part["time"].to_numpy()
        out = pd.DataFrame({"symbol": part["symbol"].iloc[0], "start_index": at[:n], "end_index": at[size - 1 :], "start_time": time[:n], "end_time": time[size - 1 :], "entry_price": part["close"].to_numpy()[size - 1 :], "similarity": similar, "distance": far})
        return out[part["_own"].to_numpy()[:n]]

    shape = "symbol string, start_index bigint, end_index bigint, start_time bigint, end_time bigint, entry_price double, similarity double, distance double"
    return dealt.groupBy("symbol", "_block").applyInPandas(score, shape)


def eligible(scored: DataFrame, bars: DataFrame, *, threshold: float, future: int = 0, exclude: list[tuple[int, int]] = (), exclude_of: list[tuple[str, int, int]] = (), excluded: DataFrame | None = None) -> DataFrame:
    """Windows similar enough, with ``future`` bars after them, that touch none of the excluded time ranges (of all symbols, or of one).

    A few ranges are predicates; many are a table ``excluded`` (symbol, start, end), which windows meet by counting its end points.
    """
    last = bars.groupBy("symbol").agg((F.count(F.lit(1)) - 1).alias("_last"))
    rows = scored.join(last, "symbol").where((F.col("similarity") >= threshold) & (F.col("end_index") + future <= F.col("_last"))).drop("_last")
    for start, end in exclude:
        rows = rows.where(~((F.col("start_time") <= end) & (F.col("end_time") >= start)))
    for symbol, start, end in exclude_of:
        rows = rows.where(~((F.col("symbol") == symbol) & (F.col("start_time") <= end) & (F.col("end_time") >= start)))
    return rows if excluded is None else outside(rows, excluded, "start_time", "end_time", ["symbol"])


def guarded(rows: DataFrame, length: int, most: int) -> None:
    """ValueError if a series has more windows than ``most``."""
    found = rows.groupBy("symbol").agg((F.count(F.lit(1)) - length + 1).alias("n")).agg(F.max("n")).first()[0] or 0  # one number
    if found > most:
        raise ValueError(f"a search of {found} windows; at most {most} are allowed")


def with_series(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Adds ``normalized``: the closes of each match as changes from its first one in percent, four digits."""
    steps = matches.select("id", "symbol", F.explode(F.sequence("start_index", "end_index")).alias("index"))
    closes = steps.join(rows.select("symbol", "index", "close"), ["symbol", "index"]).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "close"))), lambda x: x["close"]).alias("_c"))
    change = F.transform("_c", lambda c: F.round((c / F.get("_c", F.lit(0)) - 1) * 100, 4))
    return matches.join(closes, "id").withColumn("normalized", change).drop("_c")


def spaced(candidates: DataFrame, k: int, separation: int) -> DataFrame:
    """Greedily the ``k`` most similar windows of each symbol whose starts are ``separation`` apart, with their ``rank``.

    A pick rules out at most 2 * separation - 1 windows, so the picks are among the first
    k * (2 * separation - 1) and only those are folded.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("similarity"), "start_index")
    few = candidates.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k * (2 * separation - 1))
    order = F.array_sort(F.collect_list(F.struct("_r", "start_index")))
    def fold(kept, x):
        near = F.exists(kept, lambda y: F.abs(y - x["start_index"]) < separation)
        return F.when((F.size(kept) >= k) | near, kept).otherwise(F.array_append(kept, x["start_index"]))
    picks = few.groupBy("symbol").agg(F.aggregate(order, F.array().cast("array<bigint>"), fold).alias("_picks"))
    picks = picks.select("symbol", F.posexplode("_picks").alias("_p", "start_index"))
    return few.drop("_r").join(picks, ["symbol", "start_index"]).withColumn("rank", (F.col("_p") + 1).cast("int")).drop("_p")


def overall(matches: DataFrame, k: int) -> DataFrame:
    """The ``k`` best matches of all symbols, ranked anew."""
    best = matches.orderBy(F.desc("similarity"), "symbol", "start_index").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "symbol", "start_index")).cast("int"))


def match_id(symbol="symbol", start="start_time", length: int = 0):
    return F.substring(F.sha2(F.concat_ws("|", symbol, start, F.lit(length)), 256), 1, 32)


#: Queries and vectors compared in one matrix.
QUERIES, VECTORS = 2048, 1024


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity, rank): for each query the ``k`` rows of the largest cosine, smaller ids first among equals.

    Queries are cut into blocks of about QUERIES, vectors into parts; a task compares one block with one part, tile by
    tile, and keeps k of each query. Vectors are compared with those of their own length. Null embeddings, as query or vector,
    are left out; a zero vector is like nothing (0). Counting the queries runs a job.
    """
    spark = vectors.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = queries.where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    blocks = max(1, -(-asked.count() // QUERIES))  # one number
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    q = asked.select(block.alias("block"), F.explode(every).alias("part"), F.size("embedding").alias("size"), F.lit(0).alias("place"), "vec_id", "embedding")
    v = vectors.where("vec_id is not null and embedding is not null").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part.alias("part"), F.size("embedding").alias("size"), F.lit(1).alias("place"), "vec_id", "embedding")
    rows = q.unionByName(v).repartition(parts * blocks, "block", "part").sortWithinPartitions("block", "part", "size", "place", "vec_id")

    def unit(x: pd.Series) -> np.ndarray:
        x = np.stack(x.to_numpy()).astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores), axis=-1)[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, asking, names, ids, scores = None, [], None, None, None

        def done() -> Iterator[pd.DataFrame]:
            if ids is not None:
                real = np.isfinite(scores)
                yield pd.DataFrame({"query_id": np.repeat(names, ids.shape[1])[real.ravel()], "vec_id": ids[real], "similarity": scores[real]})

        for batch in batches:
            for at, group in batch.groupby(["block", "part", "size", "place"], sort=False):
                if at[:3] != key:
                    yield from done()
                    key, asking, ids = at[:3], [], None
                if at[3] == 0:
                    asking.append(group)
                    continue
                if not asking:
                    continue
                if ids is None:
                    names, x = np.concatenate([g["vec_id"].to_numpy() for g in asking]), unit(pd.concat([g["embedding"] for g in asking]))
                    ids, scores = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
                for i in range(0, len(group), VECTORS):
                    tile = group.iloc[i : i + VECTORS]
                    there = tile["vec_id"].to_numpy()
                    found = x @ unit(tile["embedding"]).T
                    found[names[:, None] == there[None]] = -np.inf
                    ids, scores = best(np.hstack([ids, np.broadcast_to(there, found.shape)]), np.hstack([scores, found]))
        yield from done()

    found = rows.mapInPandas(run, "query_id bigint, vec_id bigint, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
