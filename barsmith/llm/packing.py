"""Packing texts into training sequences by vector bin packing.

A sequence has three limits: tokens, segments, and loss-bearing tokens. A text is tokenized whole, an end
id is added, and stretches as long as a sequence are cut off. What is left of each text goes into a pool.
The open sequence takes, of the pieces that fit, the one with the largest dot product of its demand and
the room left, each as a part of the limit; if none fits, the best one is cut to the room left. So
sequences are filled to the last token unless a limit on segments or loss comes first. What is left at
the end of a partition is cut into sequences whose lengths are powers of two, which need no padding.

Each partition packs its own texts as they stream by, with a pool of bounded size: no shuffle, no group
that grows, and a lost task is simply run again with the same result.

Nulls: a null text is the empty text, which is the end id alone; a null id stays null; a null
``loss_from`` means 1. Rows that repeat are packed each for itself; among places that fit equally well the first one
is taken, and any choice keeps the limits. A very long text or word is held whole, in ids,
until it is packed. An empty table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm import tokens
from barsmith.llm.common import table

CAPACITY, SEGMENTS, POOL = 4096, 128, 512
SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, loss_tokens bigint, ids binary"


class Packer:
    """Packs pieces of one partition. ``done`` collects (doc, start, length, sequence, offset, loss, ids)."""

    def __init__(self, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = CAPACITY, pool: int = POOL):
        if min(capacity, segments, loss, pool) < 1:
            raise ValueError("all limits must be at least 1")
        self.capacity, self.segments, self.loss, self.limit = capacity, segments, loss, pool
        self.docs: list[tuple] = []  # (id, ids, loss_from, start) of each piece in the pool
        self.size = np.zeros(0, np.int64)
        self.cost = np.zeros(0, np.int64)
        self.fresh: list[tuple] = []
        self.sequence, self.done = 0, []

    def _bearing(self, start: int, end: int, loss_from: int) -> int:
        return max(0, end - max(start, loss_from))

    def _reach(self, start: int, total: int, loss_from: int, room: int, loss: int) -> int:
        """How many tokens from ``start`` fit."""
        n = min(room, total - start)
        free = max(0, min(loss_from, start + n) - start)
        return min(n, free + loss)

    def _emit(self, doc: tuple, start: int, n: int, offset: int) -> None:
        key, ids, loss_from, _ = doc
        self.done.append((key, start, n, len(ids) // 4, self.sequence, offset, self._bearing(start, start + n, loss_from), ids[4 * start : 4 * (start + n)]))

    def add(self, key, ids: bytes, loss_from: int = 1) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.capacity and self._reach(start, total, loss_from, self.capacity, self.loss) == self.capacity:
            self._emit((key, ids, loss_from, start), start, self.capacity, 0)
            self.sequence += 1
            start += self.capacity
        if start < total:
            self.fresh.append((key, ids, loss_from, start))
        if len(self.docs) + len(self.fresh) >= 2 * self.limit:
            self._pack(self.limit)

    def _pack(self, keep: int) -> None:
        docs = self.docs + self.fresh
        self.fresh = []
        size = np.array([len(d[1]) // 4 - d[3] for d in docs], np.int64)
        cost = np.array([self._bearing(d[3], len(d[1]) // 4, d[2]) for d in docs], np.int64)
        live, left = np.ones(len(docs), bool), len(docs)
        while left > keep and (keep or size[live].sum() >= self.capacity or cost[live].sum() > self.loss or left > self.segments):
            room, seats, loss, at = self.capacity, self.segments, self.loss, 0
            while room and seats and left:
                score = size * (room / self.capacity**2) + seats / self.segments**2 + cost * (loss / self.loss**2)
                fits = live & (size <= room) & (cost <= loss)
                if fits.any():
                    k = int(np.argmax(np.where(fits, score, -1.0)))
                    n = int(size[k])
                else:
                    k = int(np.argmax(np.where(live, score, -1.0)))
                    n = self._reach(docs[k][3], len(docs[k][1]) // 4, docs[k][2], room, loss)
                    if not n:
                        break
                key, ids, loss_from, start = docs[k]
                self._emit(docs[k], start, n, at)
                loss -= self._bearing(start, start + n, loss_from)
                at, room, seats = at + n, room - n, seats - 1
                docs[k] = (key, ids, loss_from, start + n)
                size[k] -= n
                cost[k] = self._bearing(start + n, len(ids) // 4, loss_from)
                if not size[k]:
                    live[k] = False
                    left -= 1
            self.sequence += 1
        self.docs = [d for d, ok in zip(docs, live) if ok]

    def finish(self) -> None:
        """Packs the rest; less than one sequence of it goes into sequences of 2048, 1024, ... tokens."""
        self._pack(0)
        rest = sum(len(d[1]) // 4 - d[3] for d in self.docs)
        room, at = (1 << rest.bit_length() - 1 if rest else 0), 0
        for key, ids, loss_from, start in self.docs:
            total = len(ids) // 4
            while start < total:
                n = min(room - at, total - start)
                self._emit((key, ids, loss_from, start), start, n, at)
                start, at, rest = start + n, at + n, rest - n
                if at == room:
                    self.sequence += 1
                    room, at = (1 << rest.bit_length() - 1 if rest else 0), 0
        self.docs = []


def pack(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", loss_from: str | None = None, tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, loss_tokens, ids (little-endian uint32).

    ``loss_from`` names a column with the first token of a text that bears loss (instruction data: the
    length of the prompt); without it all but the first token do.
    """
    path = tokenizer or tokens.default_path()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), (F.coalesce(F.col(loss_from).cast("bigint"), F.lit(1)) if loss_from else F.lit(1).cast("bigint")).alias("loss_from"))
    end = int(end_id).to_bytes(4, "little")
    types = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset", "loss_tokens")), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = tokens.words(path), Packer(capacity, segments, loss)
        first = TaskContext.get().partitionId() << 40

        def out() -> pa.RecordBatch:
            rows, packer.done = packer.done, []
            columns = list(zip(*rows)) if rows else [()] * 8
            columns[4] = [first + x for x in columns[4]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types.types)], schema=types)

        for batch in batches:
            for i, j in _together(batch.column(1)):
                part = batch.slice(i, j - i)
                for key, ids, start in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), part.column(2).to_pylist()):
                    packer.add(key, ids + end, start)
                if packer.done:
                    yield out()
        packer.finish()
        yield out()

    return rows.mapInArrow(run, SCHEMA)


def _together(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``tokens.TOGETHER`` bytes of text."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // tokens.TOGETHER
    cuts = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def op3_packing(spark, sf_dir):
    """All ``documents`` in sequences of at most 4096 tokens; the digest stands for a piece's ids."""
    return digest(pack(table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")
