"""Texts of an Arrow batch as one array of bytes, for work that numpy does on many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handed out at a time; one longer text comes alone.
TOGETHER = 1 << 20


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends)."""
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)], dtype=np.int64)


def parts(texts: list[bytes], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Stretches (first, end) of consecutive texts that sum up to about ``most`` bytes."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)
