"""Repeated passages: every string of ``depth`` bytes that also starts in an earlier document is found, and taken out.

A suffix sort that goes only ``depth`` bytes deep, by passes from the most significant digit on; suffixes that are
alone in their group leave the sort, and groups that are left at full depth are exactly the repeated windows. The
order of digits is chosen so that few suffixes need a row of their own. The first digit of a suffix is
its anchor, the 16-byte gram of smallest hash among those that lie in its first ``depth`` bytes: equal windows
have equal anchors at equal places, and some twenty suffixes in a row share one. So the passes are

1. by anchor: a run of suffixes with one anchor is one row; anchors that only one document has leave the sort;
   in the same pass, a run whose whole stretch of bytes an earlier document has is settled at once;
2. by half: those suffixes of a run that begin well before the anchor share the bytes before it, the others those behind
   it, which makes two thirds of ``depth``; halves that only one document has leave the sort;
3. by all ``depth`` bytes, for the suffixes that are left.

Documents are first put together in blocks of some megabytes, in a table bucketed by block (one file a block), so that
later passes read texts where they lie; only digits and answers are shuffled. In a block, equal digits are one row with the
smallest document, and an anchor with more than ``MANY`` different stretches in a block is one row that sends them to
pass 2. So a key, however hot, has at most ``MANY`` rows a block, and none are dropped. Digits are hashed: 128 bits
for a stretch with its anchor, 96 bits for a window; what collides would be a false match. ``BLOCK`` should grow with the
executors (about twenty bytes of memory for each of a block), as there are fewer rows the larger blocks are.

Nulls: a null text is empty, a document with a null id comes after all others. Documents of one id, rows that repeat
among them, are not earlier than each other. Very long texts are worked on in pieces. Overlaps count and nothing is judged by what is
left, so one pass over the input settles all. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import partitions, table, written
from barsmith.llm.flat import flat, raw
from barsmith.operators.tables import shared_folder

DEPTH, GRAM = 50, 16
#: Bytes and documents of a block, suffixes worked on at a time, and stretches of one anchor that a block tells apart.
BLOCK, MOST, PIECE, MANY = 1 << 22, 50_000, 1 << 20, 8
LAST = np.iinfo(np.int64).max
CLEAN, REMOVED, OPEN = 0, 1, 2
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_ODD32 = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, kind: str) -> np.ndarray:
    """The little-endian words that begin at each byte."""
    size = np.dtype(kind).itemsize
    return np.ndarray((max(0, len(data) - size + 1),), kind, data, strides=(1,))


def hashed(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """64 bits for each stretch of 8 bytes or more."""
    words = _words(data, "<u8")
    h = mixed(length.astype(np.uint64) + np.uint64(seed << 40))
    for j in range(0, int(length.max(initial=0)), 8):
        on = np.nonzero(length > j)[0]
        at = start[on] + np.minimum(j, length[on] - 8)
        h[on] = mixed((h[on] ^ words[at]) + _ODD[0])
    return h


def _runs(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor): runs of starts of windows of one text that share an anchor, of consecutive texts with these ends."""
    n = len(data) - depth + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    w = np.array(_words(data, "<u4"))
    m = len(data) - GRAM + 1
    h = w[:m] * _ODD32[0]
    for k in (1, 2, 3):
        h += w[4 * k : 4 * k + m] * _ODD32[k]
    h ^= h >> np.uint32(15)
    h *= _ODD32[4]
    h ^= h >> np.uint32(13)
    least = (h.astype(np.uint64) << np.uint64(32)) | np.arange(m, dtype=np.uint64)
    grams, span = depth - GRAM + 1, 1
    while 2 * span <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if grams > span:
        least = np.minimum(least[: -(grams - span)], least[grams - span :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(n + 1, bool)
    inside[n] = False
    for end in ends.tolist():
        inside[max(0, end - depth + 1) : end] = False
    change = np.ones(n + 1, bool)
    change[1:n] = at[1:] != at[:-1]
    change[1:] |= ~inside[:-1]
    first = np.nonzero(change[:n] & inside[:n])[0]
    last = np.nonzero(inside[:n] & (change[1:] | ~inside[1:]))[0]
    return first, last, at[first]


class Block:
    """The documents of a block in order of id, and the digits of their suffixes."""

    def __init__(self, ids: list, texts: list[bytes], depth: int, buckets: int):
        self.data, self.offsets = flat(texts)
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.depth, self.buckets = depth, buckets
        found = [self._piece(a) for a in range(0, len(self.data), PIECE)]
        self.first, self.last, self.at = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
        self.doc = self.ids[np.searchsorted(self.offsets, self.first, "right") - 1]
        self.anchor = hashed(self.data, self.at, np.full(len(self.at), GRAM), 1)
        self.stretch = hashed(self.data, self.first, self.last - self.first + depth, 2)
        self.stretch[self.stretch == 0] = 1

    def _piece(self, a: int) -> tuple[np.ndarray, ...]:
        data = self.data[a : a + PIECE + self.depth - 1]
        ends = self.offsets[1:] - a
        # an end past the piece still shuts out the windows that would cross it
        ends = ends[(ends > 0) & (ends < len(data) + self.depth)]
        return tuple(x + a for x in _runs(data, ends, self.depth))

    def _dealt(self, key: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(bucket, rows) of rows by their first digit."""
        bucket = ((key >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.nonzero(np.diff(bucket[order], prepend=-1))[0]
        return [(int(bucket[rows[0]]), rows) for rows in np.split(order, edges[1:]) if len(rows)]

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """(anchor, stretch, document) of the rows of pass 1, dealt; and which of them each run goes by.

        Sets ``mine``: whether a run belongs to the document that stands for its stretch in this block.
        """
        _, first, to = np.unique(mixed(self.anchor + _ODD[0] * self.stretch), return_index=True, return_inverse=True)
        self.mine = self.doc == self.doc[first][to]
        anchors, of, count = np.unique(self.anchor[first], return_inverse=True, return_counts=True)
        many = count > MANY
        low, high = np.full(len(anchors), LAST), np.full(len(anchors), np.iinfo(np.int64).min)
        every = np.searchsorted(anchors, self.anchor)
        np.minimum.at(low, every, self.doc)
        np.maximum.at(high, every, self.doc)
        few = ~many[of]
        row = np.zeros(len(first), np.int64)
        row[few] = np.argsort(np.argsort(first[few]))  # rows in order of the text, so that documents come in stretches
        at = first[few][np.argsort(first[few])]
        hot = np.nonzero(many)[0]
        row[~few] = len(at) + np.searchsorted(hot, of[~few])
        self.row = row[to]
        if len(hot):
            self.mine |= many[every]
        none = np.zeros(2 * len(hot), np.uint64)
        return (np.concatenate((self.anchor[at], anchors[hot], anchors[hot])), np.concatenate((self.stretch[at], none)), np.concatenate((self.doc[at], low[hot], high[hot])))

    def answer(self, state: np.ndarray) -> None:
        """States of the rows of pass 1; sets the state of each run."""
        self.state = np.where(self.mine, state[self.row] if len(state) else CLEAN, REMOVED)

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digit, nothing, document) of the rows of pass 2, one for each different half of open runs; sets which windows each half has."""
        runs = np.nonzero(self.state == OPEN)[0]
        at, near = self.at[runs], (self.depth - GRAM) // 2
        low = np.concatenate((self.first[runs], np.maximum(self.first[runs], at - near + 1)))
        high = np.concatenate((np.minimum(self.last[runs], at - near), self.last[runs]))
        start = np.concatenate((at - near, at))
        length = np.repeat([near + GRAM, self.depth - near + 1], len(runs))
        on = low <= high
        self.low, self.high, doc = low[on], high[on], np.concatenate((self.doc[runs], self.doc[runs]))[on]
        digit = hashed(self.data, start[on], length[on], 5)
        _, first, self.half = np.unique(digit, return_index=True, return_inverse=True)
        least, most = np.full(len(first), LAST), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(least, self.half, doc)
        np.maximum.at(most, self.half, doc)
        self.shared = least != most
        return digit[first], np.zeros(len(first), np.uint64), least

    def answer_halves(self, state: np.ndarray) -> None:
        """Whether other documents have the rows of pass 2."""
        keep = (self.shared | state.astype(bool))[self.half]
        self.low, self.high = self.low[keep], self.high[keep]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digit, more of it, document) of the rows of pass 3, one for each different window of open halves; sets where they start."""
        n = self.high - self.low + 1
        self.start = np.repeat(self.low - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.start.sort()
        size = np.full(len(self.start), self.depth)
        digit, more = hashed(self.data, self.start, size, 3), hashed(self.data, self.start, size, 4) >> np.uint64(32)
        doc = self.ids[np.searchsorted(self.offsets, self.start, "right") - 1]
        _, first, to = np.unique(mixed(digit + _ODD[0] * more), return_index=True, return_inverse=True)
        place = np.argsort(first)
        rank = np.empty_like(place)
        rank[place] = np.arange(len(place))
        first, self.window = first[place], rank[to]
        self.later = doc > doc[first][self.window]
        return digit[first], more[first], doc[first]

    def spans(self, known: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(document, removed spans) by ``known``: whether an earlier document has the window of each row of pass 3."""
        gone = np.zeros(len(self.data) + 1, np.int64)
        whole = self.state == REMOVED
        np.add.at(gone, self.first[whole], 1)
        np.add.at(gone, self.last[whole] + self.depth, -1)
        start = self.start[self.later | (known[self.window] if len(known) else False)]
        np.add.at(gone, start, 1)
        np.add.at(gone, start + self.depth, -1)
        covered = np.cumsum(gone[:-1]) > 0
        for k, (a, b) in enumerate(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())):
            edges = np.nonzero(np.diff(covered[a:b], prepend=False, append=False))[0].tolist()
            yield k, list(zip(edges[::2], edges[1::2]))


def in_blocks(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Documents as a table of blocks (block, ids, sizes, data), bucketed by block; ids in order, data compressed."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal size, number
            held.sort(key=lambda r: (r[0] is None, r[0]))
            number, size = number + 1, 0
            ids, texts = [r[0] for r in held], [r[1] for r in held]
            held.clear()
            columns = [([number - 1], pa.int64()), ([ids], pa.list_(pa.int64())), ([list(map(len, texts))], pa.list_(pa.int64())), ([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary())]
            return pa.record_batch([pa.array(*c) for c in columns], names=["block", "ids", "sizes", "data"])

        for batch in batches:
            for id_, t in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                if held and (size + len(t) > BLOCK or len(held) >= MOST):
                    yield flush()
                held.append((id_, t))
                size += len(t)
        if held:
            yield flush()

    parts = partitions(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, "block bigint, ids array<bigint>, sizes array<bigint>, data binary")
    name = f"repeats_blocks_{uuid.uuid4().hex}"
    rows.write.bucketBy(parts, "block").option("path", f"{shared_folder(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name)


def _opened(row: dict, depth: int, buckets: int) -> Block:
    data, at, texts = pa.decompress(row["data"], sum(row["sizes"]), "zstd", asbytes=True), 0, []
    for n in row["sizes"]:
        texts.append(data[at : at + n])
        at += n
    return Block(row["ids"], texts, depth, buckets)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _joined(answers: list | None, dealt: list, n: int) -> np.ndarray:
    """The answers of all buckets, in the order of the rows that were asked for; nothing is said where all are 0."""
    out = np.zeros(n, np.uint8)
    by = {a["bucket"]: a["answer"] for a in answers or []}
    for bucket, rows in dealt:
        if bucket in by:
            out[rows] = np.frombuffer(by[bucket], np.uint8)[: len(rows)]
    return out


def _lists(arrays: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([a.view(np.int64)], pa.list_(pa.int64())) for a in arrays]


#: The passes, and the columns in which blocks find what was said to the rows of each.
PASSES = ("anchors", "halves", "windows")


def _asked(block: Block, row: dict, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of pass ``upto``, from 0, of a block that has the answers of all passes before it."""
    rows = block.asked()
    if upto > 0:
        block.answer(_joined(row[PASSES[0]], block._dealt(rows[0]), len(rows[0])))
        rows = block.halves()
    if upto > 1:
        block.answer_halves(_joined(row[PASSES[1]], block._dealt(rows[0]), len(rows[0])))
        rows = block.windows()
    return rows


def _ask(blocks: DataFrame, depth: int, buckets: int, upto: int) -> DataFrame:
    """(bucket, block, a, b, doc): the rows of a pass for blocks joined with the answers of those before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            block = _opened(row, depth, buckets)
            a, b, doc = _asked(block, row, upto)
            for bucket, rows in block._dealt(a):
                yield pa.record_batch([pa.array([bucket], pa.int64()), pa.array([row["block"]], pa.int64()), *_lists([a[rows], b[rows], doc[rows]])], names=["bucket", "block", "a", "b", "doc"])

    return blocks.mapInArrow(run, "bucket bigint, block bigint, a array<bigint>, b array<bigint>, doc array<bigint>")


def states(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Pass 1 in a bucket: a row is clean if its anchor is in one document or has one stretch, removed if an earlier document has its stretch."""
    out = np.zeros(len(a), np.uint8)
    _, of, count = np.unique(a, return_inverse=True, return_counts=True)
    at = np.nonzero(count[of] > 1)[0]
    at = at[np.lexsort((doc[at], b[at], a[at]))]
    if not len(at):
        return out
    a, b, doc = a[at], b[at], doc[at]
    new = np.concatenate(([True], a[1:] != a[:-1]))
    stretch = new | np.concatenate(([True], b[1:] != b[:-1]))
    heads, starts = np.nonzero(new)[0], np.nonzero(stretch)[0]
    group = np.cumsum(new) - 1
    alone = (np.minimum.reduceat(doc, heads) == np.maximum.reduceat(doc, heads))[group]
    mixed_ = (np.add.reduceat(stretch.astype(np.int64), heads) > 1)[group]
    hot = (b == 0) & stretch
    mixed_ |= np.logical_or.reduceat(hot, heads)[group]
    state = np.where(mixed_, OPEN, CLEAN)
    state[(doc > doc[starts][np.cumsum(stretch) - 1]) & (b != 0)] = REMOVED
    state[alone] = CLEAN
    out[at] = state
    return out


def shared(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Pass 2 in a bucket: whether more than one document has the half."""
    order = np.lexsort((doc, a))
    a, doc = a[order], doc[order]
    out = np.zeros(len(a), np.uint8)
    if len(a):
        heads = np.nonzero(np.concatenate(([True], a[1:] != a[:-1])))[0]
        out[order] = np.repeat(np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads), np.diff(heads, append=len(a)))
    return out


def earlier(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Pass 3 in a bucket: whether an earlier document has the window."""
    order = np.lexsort((doc, b, a))
    a, b, sorted_doc = a[order], b[order], doc[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    out = np.zeros(len(a), np.uint8)
    if len(a):
        out[order] = sorted_doc > sorted_doc[new][np.cumsum(new) - 1]
    return out


def _answered(asks: DataFrame, judge, name: str) -> DataFrame:
    """(block, ``name``): for each block the buckets that have something to say to it."""

    def run(rows: pa.Table) -> pa.Table:
        lists = [rows.column(c).combine_chunks() for c in ("a", "b", "doc")]
        a, b, doc = (x.values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py()).to_numpy() for x in lists)
        edges = np.cumsum(lists[0].value_lengths().to_numpy())
        said = [x.tobytes() if x.any() else None for x in np.split(judge(a, b, doc), edges[:-1])]
        out = pa.table({"bucket": rows.column("bucket"), "block": rows.column("block"), "answer": pa.array(said, pa.binary())})
        return out.filter(out.column("answer").is_valid())

    found = asks.groupBy("bucket").applyInArrow(run, "bucket bigint, block bigint, answer binary")
    return written(found.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias(name)), f"repeats-{name}")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", depth: int = DEPTH, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary): one row for each row of ``docs``.

    ``spans`` are the maximal runs of bytes that lie in a string of ``depth`` bytes which a document with a smaller id
    has too; ``kept`` is the rest of the UTF-8 text. ``depth`` is at least 2 * GRAM.
    """
    if depth < 2 * GRAM:
        raise ValueError(f"depth is at least {2 * GRAM}")
    buckets = buckets or 4 * partitions(docs.sparkSession)
    blocks = in_blocks(docs, id_col, text)
    told = blocks
    for k, judge in enumerate((states, shared, earlier)):
        told = told.join(_answered(_ask(told, depth, buckets, k), judge, PASSES[k]), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            block = _opened(row, depth, buckets)
            digits = _asked(block, row, 2)[0]
            known = _joined(row[PASSES[2]], block._dealt(digits), len(digits)).astype(bool)
            out = []
            for k, spans in block.spans(known):
                t = block.data[block.offsets[k] : block.offsets[k + 1]].tobytes()
                ends = [0, *(x for s in spans for x in s), len(t)]
                kept = b"".join(t[i:j] for i, j in zip(ends[::2], ends[1::2]))
                out.append({"doc_id": row["ids"][k], "n_bytes": len(t), "spans": [{"start": i, "end": j} for i, j in spans], "kept": kept})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]))

    return told.mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


def op11_repeats(spark, sf_dir):
    """All ``documents`` without strings of 50 bytes that a document of smaller id has."""
    rows = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.start)
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same with every window as a row, in hexadecimal digits.
ORACLE = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
c as (select doc_id, x, unnest(range(0, greatest(length(x) // 2 - 49, 0), 256)) as q from d),
y as (select doc_id, q, substr(x, 2 * q + 1, 2 * 305) as y from c),
w as (select doc_id, q, y, unnest(range(0, length(y) // 2 - 49)) as p from y),
s as (select doc_id, q + p as p, substr(y, 2 * p + 1, 100) as s from w),
m as (select s, min(doc_id) as first from s group by s having count(*) > 1),
hit as (select distinct doc_id, p from s join m using (s) where first < doc_id),
edge as (select *, p > coalesce(lag(p) over (partition by doc_id order by p) + 50, -1) as new from hit),
part as (select *, sum(cast(new as int)) over (partition by doc_id order by p) as k from edge),
span as (select doc_id, min(p) as a, max(p) + 50 as b from part group by doc_id, k),
gap as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as upto from span),
kept as (select g.doc_id, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(x, 2 * upto + 1, 2 * (a - upto)), '' order by a) || substr(any_value(x), 2 * max(b) + 1) as rest
  from gap g join d on g.doc_id = d.doc_id group by g.doc_id)
select d.doc_id, cast(length(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(rest, x))) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
"""
