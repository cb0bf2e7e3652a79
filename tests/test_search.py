"""Scores by running sums against scores from the vectors of all windows."""

import time

import numpy as np
import pytest

from barsmith.operators import similarity


def series(seed, n, kind):
    r = np.random.default_rng(seed)
    c = {"walk": lambda: 100 + np.cumsum(r.normal(size=n)), "noise": lambda: r.uniform(1, 100, n), "high": lambda: 50_000 + np.cumsum(r.normal(size=n)), "steps": lambda: 100 + np.repeat(r.integers(0, 3, n // 20 + 1), 20)[:n].astype(float), "flat": lambda: np.full(n, 7.0), "zeros": lambda: np.where(r.random(n) < 0.3, 0.0, r.uniform(0, 1, n))}[kind]()
    c = np.abs(c)
    o = np.concatenate(([c[0]], c[:-1]))
    wick = np.zeros(n) if kind in ("flat", "steps") else r.random(n)
    v = np.where(r.random(n) < 0.1, 0.0, r.integers(0, 1000, n)).astype(float) if kind != "flat" else np.zeros(n)
    return o, np.maximum(o, c) + wick, np.minimum(o, c) - wick / 2, c, v


def by_vectors(bars, size, q, volume):
    m = similarity.features(*(np.lib.stride_tricks.sliding_window_view(x, size) for x in bars), volume)
    norm = np.linalg.norm(m, axis=1) * np.linalg.norm(q)
    return np.where(norm > similarity.EPSILON, m @ q / np.where(norm > similarity.EPSILON, norm, 1.0), 0.0), np.linalg.norm(m - q, axis=1) / max(np.sqrt(len(q)), similarity.EPSILON)


@pytest.mark.parametrize("kind", ["walk", "noise", "high", "steps", "flat", "zeros"])
@pytest.mark.parametrize("size", [5, 6, 12, 100])
def test_equal_to_vectors(kind, size):
    bars = series(1, 1500, kind)
    for volume in (False, True):
        for at in (0, 700):
            q = similarity.features(*(x[None, at : at + size] for x in bars), volume)[0]
            got, want = similarity.window_scores(bars, size, q, volume), by_vectors(bars, size, q, volume)
            assert np.abs(got[0] - want[0]).max() < 1e-11 and np.abs(got[1] - want[1]).max() < 1e-10
            assert got[1][at] < 1e-9


def test_series_as_short_as_the_pattern():
    bars = series(2, 12, "walk")
    q = similarity.features(*(x[None] for x in bars), True)[0]
    assert similarity.window_scores(bars, 12, q, True)[0] == pytest.approx([1.0])


def test_long_patterns_are_searched_ten_times_faster():
    bars = series(3, 4096 + 399, "walk")
    q = similarity.features(*(x[None, 50:450] for x in bars), True)[0]

    def took(f):
        best = 1e9
        for _ in range(3):
            t = time.perf_counter()
            f()
            best = min(best, time.perf_counter() - t)
        return best

    def chunks():
        views = [np.lib.stride_tricks.sliding_window_view(x, 400) for x in bars]
        for i in range(0, 4096, similarity.AT_ONCE):
            m = similarity.features(*(w[i : i + similarity.AT_ONCE] for w in views), True)
            m @ q, np.linalg.norm(m - q, axis=1)

    assert took(lambda: similarity.window_scores(bars, 400, q, True)) * 10 < took(chunks)
