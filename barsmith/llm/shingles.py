"""Words and shingles as the near-copy operators read them.

A-Z are lower-cased, words stand between ASCII white space, and a shingle is ``width`` words joined by a
space; a text of fewer words is one shingle, a text without words has none.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash


def hashes(text: str | None, width: int) -> np.ndarray:
    """The XXH64 (seed 42) of each shingle, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(width, len(words))
    slices = map(joined.__getitem__, map(slice, starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(42)), np.uint64, len(words) - k + 1)


def majority(found: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; zero for none."""
    if not len(found):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 16):
        part = found[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(found)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])
