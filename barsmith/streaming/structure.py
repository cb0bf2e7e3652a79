"""Swing points and gaps of a stream of closed bars, with the state that each symbol needs and no more.

Bars of a symbol must come in order of time from batch to batch, as a watermarked stream closes them; within a batch they may
come in any order (so a folder of closed bars is read by whole batches, not by some files of one). A bar that is not newer than
what was seen is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SWINGS = "symbol string, kind string, index bigint, time bigint, price double, confirmed_time bigint, strength int"
GAPS = "symbol string, direction string, index bigint, time bigint, start_time bigint, bottom double, top double, midpoint double, size double, size_percent double, mitigated_time bigint, filled_time bigint, penetration double, as_of bigint"
_RING = "index bigint, times array<bigint>, highs array<double>, lows array<double>"
_OPEN = "open array<struct<direction: string, index: bigint, time: bigint, start_time: bigint, bottom: double, top: double, level: double, mitigated_time: bigint>>"


def _newer(parts: Iterator[pd.DataFrame], times: list[int]) -> pd.DataFrame:
    rows = pd.concat(list(parts)).sort_values("time").drop_duplicates("time", keep="last")
    return rows[rows["time"] > times[-1]] if times else rows


def _ring(state: GroupState) -> tuple[int, list, list, list]:
    """(bars seen, and the times, highs and lows of the last ones)."""
    if not state.exists:
        return 0, [], [], []
    index, times, highs, lows, *_ = state.get
    return index, list(times), list(highs), list(lows)


def swings(bars: DataFrame, strength: int = 2) -> DataFrame:
    """Swing points of (symbol, time, high, low) as they are confirmed; the state of a symbol is its last 2 * strength bars."""
    s = strength
    if s < 1:
        raise ValueError("strength must be at least 1")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, times, highs, lows = _ring(state)
        rows = _newer(parts, times)
        first = index - len(times)
        times, highs, lows = times + rows["time"].tolist(), highs + rows["high"].tolist(), lows + rows["low"].tolist()
        state.update((index + len(rows), times[-2 * s :], highs[-2 * s :], lows[-2 * s :]))
        if len(times) <= 2 * s:
            return
        at = np.arange(s, len(times) - s)
        view = lambda x: np.lib.stride_tricks.sliding_window_view(np.array(x), 2 * s + 1)
        h, l = view(highs), view(lows)
        high = (h[:, s] > h[:, :s].max(axis=1)) & (h[:, s] >= h[:, s + 1 :].max(axis=1))
        low = (l[:, s] < l[:, :s].min(axis=1)) & (l[:, s] <= l[:, s + 1 :].min(axis=1))
        found = [(key[0], kind, int(first + i), times[i], prices[i], times[i + s], s) for kind, on, prices in (("high", high, highs), ("low", low, lows)) for i in at[on].tolist()]
        if found:
            yield pd.DataFrame(found, columns=["symbol", "kind", "index", "time", "price", "confirmed_time", "strength"])

    rows = bars.select("symbol", "time", "high", "low")
    return rows.groupBy("symbol").applyInPandasWithState(step, SWINGS, _RING, "append", GroupStateTimeout.NoTimeout)


class Side:
    """Open gaps of one direction, by the price that next changes one: a bar touches only gaps that it changes.

    Prices are as the direction sees them: ``touch`` is the edge that is reached first, ``fill`` the far one, and lower is deeper
    (those of bearish gaps are mirrored).
    """

    def __init__(self, gaps: list[dict]):
        self.gaps = {g["index"]: g for g in gaps}
        self.order = [(-g["level"], g["mitigated_time"] is not None, g["index"]) for g in gaps]
        heapify(self.order)
        self.touched = 0

    def add(self, gap: dict) -> None:
        self.gaps[gap["index"]] = gap
        heappush(self.order, (-gap["level"], False, gap["index"]))

    def bar(self, reach: float, time: int) -> Iterator[dict]:
        """Gaps that a bar changes. Filled ones are forgotten."""
        again = []
        while self.order and (-self.order[0][0] > reach or -self.order[0][0] == reach and not self.order[0][1]):
            gap = self.gaps[heappop(self.order)[2]]
            self.touched += 1
            gap["mitigated_time"] = time if gap["mitigated_time"] is None else gap["mitigated_time"]
            gap["level"] = reach
            if reach <= gap["fill"]:
                gap["filled_time"] = time
                del self.gaps[gap["index"]]
            else:
                again.append((-reach, True, gap["index"]))
            yield gap
        for entry in again:
            heappush(self.order, entry)


def _seen(gap: dict) -> dict:
    """A gap with its edges as its direction sees them."""
    up = gap["direction"] == "bullish"
    touch, fill = (gap["top"], gap["bottom"]) if up else (-gap["bottom"], -gap["top"])
    return {"filled_time": None, "level": touch, "mitigated_time": None, **gap, "touch": touch, "fill": fill}


def gaps(bars: DataFrame, min_size_percent: float = 0.0) -> DataFrame:
    """Gaps of (symbol, time, high, low) and what becomes of them: one row for each gap that a batch changed, ``as_of`` its last bar.

    The state of a symbol is its last two bars and its open gaps. :func:`latest` makes a table of the rows.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, times, highs, lows = _ring(state)
        rows = _newer(parts, times)
        held = [_seen(g if isinstance(g, dict) else g.asDict()) for g in (state.get[4] if state.exists else [])]
        sides = {d: Side([g for g in held if g["direction"] == d]) for d in ("bullish", "bearish")}
        changed: dict[tuple, dict] = {}
        for time, high, low in zip(rows["time"].tolist(), rows["high"].tolist(), rows["low"].tolist()):
            for d, reach in (("bullish", low), ("bearish", -high)):
                for gap in sides[d].bar(reach, time):
                    changed[d, gap["index"]] = gap
            if len(times) >= 2:
                edges = ("bullish", highs[-2], low) if highs[-2] < low else ("bearish", high, lows[-2]) if lows[-2] > high else None
                if edges:
                    d, bottom, top = edges
                    middle = (top + bottom) / 2
                    if ((top - bottom) / middle * 100 if middle else 0.0) >= min_size_percent:
                        gap = _seen({"direction": d, "index": index, "time": time, "start_time": times[-2], "bottom": bottom, "top": top})
                        sides[d].add(gap)
                        changed[d, index] = gap
            index += 1
            times, highs, lows = [*times[-1:], time], [*highs[-1:], high], [*lows[-1:], low]
        names = ("direction", "index", "time", "start_time", "bottom", "top", "level", "mitigated_time")
        state.update((index, times, highs, lows, [tuple(g[n] for n in names) for side in sides.values() for g in side.gaps.values()]))
        out = []
        for g in changed.values():
            size, middle = g["top"] - g["bottom"], (g["top"] + g["bottom"]) / 2
            deep = (g["touch"] - g["level"]) / size if size else 0.0
            out.append((key[0], g["direction"], g["index"], g["time"], g["start_time"], g["bottom"], g["top"], middle, size, size / middle * 100 if middle else 0.0, g["mitigated_time"], g["filled_time"], max(0.0, min(1.0, deep)), times[-1]))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in GAPS.split(", ")]).astype({"mitigated_time": "Int64", "filled_time": "Int64"})

    rows = bars.select("symbol", "time", "high", "low")
    return rows.groupBy("symbol").applyInPandasWithState(step, GAPS, f"{_RING}, {_OPEN}", "append", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame, bars: DataFrame) -> DataFrame:
    """The gaps of a log of updates as :func:`barsmith.operators.gaps.mitigation` gives them; ``bars`` tell how far each symbol has come."""
    key = ["symbol", "direction", "index"]
    others = [c for c in updates.columns if c not in (*key, "as_of")]
    now = updates.groupBy(*key).agg(F.max_by(F.struct(*others), "as_of").alias("g")).select(*key, "g.*")
    ends = bars.groupBy("symbol").agg(F.max("time").alias("_last"))
    return now.join(ends, "symbol").select("symbol", "direction", "index", "time", "start_time", F.coalesce("filled_time", "_last").alias("end_time"), "bottom", "top", "midpoint", "size", "size_percent", F.col("mitigated_time").isNotNull().alias("mitigated"), "mitigated_time", F.col("filled_time").isNotNull().alias("filled"), "filled_time", "penetration")
