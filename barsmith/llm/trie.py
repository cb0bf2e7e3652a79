"""A binary trie of fingerprints joined with itself, walked as pairs of nodes with an error budget."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Most pairs of leaves compared at once, and most pairs of nodes in a work item.
LEAF_PAIRS, FRONTIER = 64, 200_000

#: Whether the values at two arrays of positions are near by another measure.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i] in place; a label is the smallest index of its class."""
    while True:
        x, y = label[a], label[b]
        if not (open_ := x != y).any():
            return
        x, y = x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(jump := label[label], label):
            label[:] = jump


def trie_join(values: np.ndarray, roots: list[tuple[int, int]], depth: int, budget: int, label: np.ndarray, near: Near | None = None) -> None:
    """Links values (uint64, sorted within each root's range, equal in the first ``depth`` bits) into ``label``.

    A node is a range of values with a common prefix. A work item is a depth and arrays of node pairs
    (lo, hi, lo, hi) with the number of bits in which their prefixes differ. With ``near``, a pair within the
    budget is linked only if that finds it near too.
    """
    start = np.array(roots, np.int64).reshape(-1, 2)
    work = [(depth, start[:, 0], start[:, 1], start[:, 0], start[:, 1], np.zeros(len(start), np.int64))]
    ones: dict[int, np.ndarray] = {}
    while work:
        d, a, b, c, e, acc = work.pop()
        if len(a) > FRONTIER:
            work += [(d, a[i : i + FRONTIER], b[i : i + FRONTIER], c[i : i + FRONTIER], e[i : i + FRONTIER], acc[i : i + FRONTIER]) for i in range(0, len(a), FRONTIER)]
            continue
        # sorted by class, a range holds one class iff its ends agree in every change count
        changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        one_class = (changes[a] == changes[b - 1]) & (changes[c] == changes[e - 1]) & (label[a] == label[c])
        keep = ~one_class & ~((a == c) & (b - a < 2))
        a, b, c, e, acc = a[keep], b[keep], c[keep], e[keep], acc[keep]
        small = ((b - a) * (e - c) <= LEAF_PAIRS) | (d >= 64)
        if small.any():
            leaves(values, a[small], b[small], c[small], e[small], budget, label, near)
        a, b, c, e, acc = a[~small], b[~small], c[~small], e[~small], acc[~small]
        if not len(a):
            continue
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum((values >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)))
        up = ones[d]
        m, n = b - (up[b] - up[a]), e - (up[e] - up[c])
        same = a == c
        other = ~same
        children = [(a, m, c, n, acc, slice(None)), (m, b, n, e, acc, slice(None)), (a, m, n, e, acc + 1, slice(None)), (m, b, c, n, acc + 1, other)]
        parts = []
        for lo, hi, lo2, hi2, cost, which in children:
            lo, hi, lo2, hi2, cost = lo[which], hi[which], lo2[which], hi2[which], cost[which]
            ok = (hi > lo) & (hi2 > lo2) & (cost <= budget)
            parts.append((lo[ok], hi[ok], lo2[ok], hi2[ok], cost[ok]))
        work.append((d + 1, *(np.concatenate(x) for x in zip(*parts))))


def leaves(values, a, b, c, e, budget, label, near) -> None:
    """Compares all values of one node with all of the other."""
    per = (b - a) * (e - c)
    step = max(1, FRONTIER * 5 // max(1, int(per.max())))
    for i in range(0, len(a), step):
        n = per[i : i + step]
        pair = np.repeat(np.arange(i, i + len(n)), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        w = (e - c)[pair]
        x, y = a[pair] + k // w, c[pair] + k % w
        hit = (np.bitwise_count(values[x] ^ values[y]) <= budget) & (label[x] != label[y])
        if near is not None:
            hit[hit] = near(x[hit], y[hit])
        if hit.any():
            settle(label, x[hit], y[hit])
