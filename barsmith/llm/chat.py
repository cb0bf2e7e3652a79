"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is lines of text in which some lines start with a speaker marker ("User:", "### Assistant",
"[system]", "Q:", "<|im_start|>user", ...), and some markers are missing or doubtful. States are a role
that begins a turn or goes on with it. A line emits its marker's role, whether it is the first of its row,
and two features of content (long, a question). While a turn goes on, features say nothing of the role, so
a long answer stays one speaker's however many lines it has. Viterbi finds the likeliest states, and lines
from one beginning to the next are rendered as one turn: ``<|role|>``, the text without its marker, ``<|end|>``.

Tables are learned: in each of ``rounds`` passes all lines are decoded, and the arcs and emissions of the
paths are counted, summed over partitions and added to PRIOR lines of the first tables. Counts and scores are
integers, so neither the learning nor a path depends on how rows are dealt.

Long conversations are cut into blocks of about BLOCK rows, by their turn numbers and, where turns repeat
very often, by a hash of the text. The path is that of the whole conversation all the same: a block is a
max-plus matrix, a scan over the few matrices of a conversation gives each block the scores with which it
begins, and a scan back gives the state in which it ends. A turn that goes on over the edge of blocks is put
together from its pieces. Only the rendered turn itself, an output row, is held whole.

Nulls: a null text is an empty line; a row whose conversation or turn is null is a conversation of its own.
Rows of one conversation and turn are read in order of a hash of their text; rows that repeat are read one
after the other, in one task, which holds their text once. An empty table gives no turns. Only the named columns are read, whatever others there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import partitions, table, written

ROLES = ("system", "user", "assistant")
#: Words that announce a speaker.
NAMES = {
    "system": "system sys instruction instructions context",
    "user": "user human question q prompter customer me client",
    "assistant": "assistant ai bot answer a model agent gpt response",
}
ROLE_OF = {name: role for role, names in NAMES.items() for name in names.split()}
MARKER = re.compile(r"\s*(?:<\|(?:im_start\|>)?|\[|#{1,4}\s*|\*\*|>\s*)?\s*(" + "|".join(sorted(ROLE_OF, key=len, reverse=True)) + r")\s*(?:\|>|\]|\*\*)?\s*(?::\*\*|[:>]|-\s|$|(?<=[\]>*]))\s*", re.IGNORECASE)
STATES = [(role, begins) for role in range(len(ROLES)) for begins in (True, False)]
#: Rows of a block, lines whose worth the first tables have, characters of a long line.
BLOCK, PRIOR, LONG = 256, 200.0, 400
#: Scores are log-probabilities times SCALE, rounded; NEVER stands for an arc that does not exist.
SCALE, NEVER = 1 << 16, -(1 << 58)

#: A line as one number: 1 + role of its marker (0: none), then bits for first of its row, long, a question.
SYMBOLS = 32
_MARK, _FIRST, _LONG, _ASKS = (np.arange(SYMBOLS) & 3), (np.arange(SYMBOLS) >> 2) & 1, (np.arange(SYMBOLS) >> 3) & 1, (np.arange(SYMBOLS) >> 4) & 1

#: What tells blocks apart, in order: conversation, bucket of turns, turn, part of it.
KEY = ("conv_id", "hb", "at", "sub")


def marker(line: str) -> tuple[int, int]:
    """(role or -1, where the text starts)."""
    found = MARKER.match(line)
    return (ROLES.index(ROLE_OF[found[1].lower()]), found.end()) if found else (-1, 0)


def symbols(text: str) -> bytes:
    """A symbol for each line of a row. The first line counts as long if the row is."""
    out = bytearray()
    for n, line in enumerate(text.split("\n")):
        role, at = marker(line)
        long = len(line) - at > LONG or (n == 0 and len(text) > LONG)
        out.append(role + 1 | (n == 0) << 2 | long << 3 | line.rstrip().endswith("?") << 4)
    return bytes(out)


@dataclass(frozen=True)
class Model:
    """Scores of a first state, of an arc, and of a symbol in a state; a few hundred integers."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def _first_tables() -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Probabilities before anything is learned: starts, arcs, emissions. Speakers mostly alternate."""
    start = np.array([{0: 0.3, 1: 0.6, 2: 0.1}[role] if begins else 0.0 for role, begins in STATES])
    follows = np.array([[0.01, 0.95, 0.04], [0.01, 0.05, 0.94], [0.01, 0.93, 0.06]])
    step = np.array([[0.45 * follows[i // 2, j // 2] if STATES[j][1] else 0.55 * (i // 2 == j // 2) for j in range(6)] for i in range(6)])
    tables = {
        # rows: a beginning of each role, going on
        "mark": np.array([[0.12, 0.86, 0.01, 0.01], [0.12, 0.01, 0.86, 0.01], [0.12, 0.01, 0.01, 0.86], [0.994, 0.002, 0.002, 0.002]]),
        "first": np.array([[0.05, 0.95], [0.9, 0.1]]),  # rows: a beginning, going on
        "long": np.array([[0.75, 0.25], [0.9, 0.1], [0.4, 0.6], [0.7, 0.3]]),
        "asks": np.array([[0.95, 0.05], [0.5, 0.5], [0.9, 0.1], [0.9, 0.1]]),
    }
    return start, step, tables


FIRST = _first_tables()
_KIND = np.array([role if begins else len(ROLES) for role, begins in STATES])
_GOES = np.array([0 if begins else 1 for _, begins in STATES])


def tables(starts: np.ndarray | None = None, arcs: np.ndarray | None = None, seen: np.ndarray | None = None) -> Model:
    """The model of counts (starts: 6, arcs: 6 x 6, seen: 6 x SYMBOLS) added to PRIOR lines of the first tables."""
    start, step, emission = FIRST
    starts = PRIOR * start + (0 if starts is None else starts)
    arcs = PRIOR / len(STATES) * step + (0 if arcs is None else arcs)
    arcs = np.repeat(arcs.reshape(3, 2, 6).sum(axis=1), 2, axis=0)  # what follows depends on the role only
    seen = np.zeros((len(STATES), SYMBOLS)) if seen is None else seen
    log = lambda p: np.where(p > 0, np.log(np.where(p > 0, p, 1.0)), -np.inf)
    total = np.zeros((len(STATES), SYMBOLS))
    for name, of, group in (("mark", _MARK, _KIND), ("first", _FIRST, _GOES), ("long", _LONG, _KIND), ("asks", _ASKS, _KIND)):
        counts = PRIOR / len(STATES) * emission[name]
        np.add.at(counts, (group[:, None], of[None, :]), seen)
        total += log(counts / counts.sum(axis=1, keepdims=True))[group][:, of]
    whole = lambda x: np.where(np.isfinite(x), np.rint(np.where(np.isfinite(x), x, 0) * SCALE), NEVER).astype(np.int64)
    return Model(whole(log(starts / starts.sum())), whole(log(arcs / arcs.sum(axis=1, keepdims=True))), whole(total.T))


DEFAULT = tables()
START, TRANSITIONS = DEFAULT.start, DEFAULT.step


def emissions(lines: list[str], first: list[bool], model: Model = DEFAULT) -> np.ndarray:
    """Score of each line in each state; ``first``: whether a line is the first of its row."""
    rows = "".join("\0" + line if starts else "\n" + line for line, starts in zip(lines, first))
    found = b"".join(map(symbols, rows.split("\0")[1:] if first[0] else rows[1:].split("\0")))
    return model.emit[np.frombuffer(found, np.uint8)]


def viterbi(scores: np.ndarray, start: np.ndarray = START, step: np.ndarray = TRANSITIONS) -> tuple[list[int], np.ndarray]:
    """The likeliest states, and the score of each last state; of equals the lower state, from the end back."""
    back = np.zeros(scores.shape, np.int64)
    best = start + scores[0]
    for k in range(1, len(scores)):
        arcs = best[:, None] + step
        back[k] = arcs.argmax(axis=0)
        best = np.maximum(arcs.max(axis=0), NEVER) + scores[k]
    path = [int(best.argmax())]
    for k in range(len(scores) - 1, 0, -1):
        path.append(int(back[k, path[-1]]))
    return path[::-1], best


def _alike(found: list[bytes], cells: int = 1 << 17) -> Iterator[np.ndarray]:
    """Positions of sequences, longest first, in groups of about one length."""
    length = np.array([len(s) for s in found])
    order, at = np.argsort(-length, kind="stable"), 0
    while at < len(order):
        most = int(length[order[at]])
        n = max(1, cells // max(1, most))
        n = min(n, int(np.searchsorted(-length[order[at:]], -(most // 2), side="right")))
        yield order[at : at + n]
        at += n


def _forward(found: list[bytes], prior: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first -> symbols, lengths, last scores, and back[k, i, state]: the state before, at line k."""
    length = np.array([len(s) for s in found])
    syms = np.zeros((len(found), length[0]), np.uint8)
    for i, s in enumerate(found):
        syms[i, : len(s)] = np.frombuffer(s, np.uint8)
    back = np.zeros((length[0], len(found), len(STATES)), np.int8)
    best = np.maximum(prior + model.emit[syms[:, 0]], NEVER)
    for k in range(1, length[0]):
        n = int(np.searchsorted(-length, -k))  # sequences with a line k
        arcs = best[:n, :, None] + model.step
        back[k, :n] = arcs.argmax(axis=1)
        best[:n] = np.maximum(np.maximum(arcs.max(axis=1), NEVER) + model.emit[syms[:n, k]], NEVER)
    return syms, length, best, back


def decode(found: list[bytes], prior: np.ndarray, last: np.ndarray, model: Model) -> list[np.ndarray]:
    """The states of each sequence; ``prior``: scores before its first line, ``last``: its last state, or -1 for the best."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(found)
    for group in _alike(found):
        syms, length, best, back = _forward([found[i] for i in group], prior[group], model)
        state = np.where(last[group] >= 0, last[group], best.argmax(axis=1))
        path = np.zeros(syms.shape, np.int8)
        for k in range(syms.shape[1] - 1, -1, -1):
            n = int(np.searchsorted(-length, -k))
            path[:n, k] = state[:n]
            state[:n] = back[k, np.arange(n), state[:n]]
        for i, p, n in zip(group, path, length):
            out[i] = p[:n]
    return out


def transfers(found: list[bytes], model: Model) -> np.ndarray:
    """(n, 6, 6): the scores before the next line, for a start in each state alone."""
    out = np.zeros((len(found), 6, 6), np.int64)
    single = np.where(np.eye(6, dtype=bool), 0, NEVER)
    for group in _alike(found):
        _, _, best, _ = _forward([found[i] for i in group for _ in range(6)], np.tile(single, (len(group), 1)), model)
        out[group] = np.maximum((best[:, :, None] + model.step).max(axis=1), NEVER).reshape(-1, 6, 6)
    return out


def turn_backs(found: list[bytes], prior: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each last state, and the first state on the best path to each last state."""
    ends, firsts = np.zeros((len(found), 6), np.int64), np.zeros((len(found), 6), np.int64)
    for group in _alike(found):
        _, length, best, back = _forward([found[i] for i in group], prior[group], model)
        state = np.tile(np.arange(6), (len(group), 1))
        for k in range(length[0] - 1, 0, -1):
            n = int(np.searchsorted(-length, -k))
            state[:n] = np.take_along_axis(back[k, :n].astype(np.int64), state[:n], axis=1)
        ends[group], firsts[group] = best, state
    return ends, firsts


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


def pieces(rows: list[tuple], path: np.ndarray) -> Iterator[tuple]:
    """(turn, text) of a block and the states of its lines -> (lead, turn, part, role, last, body).

    ``lead``: lines before the first beginning, which belong to a turn of a block before.
    """
    piece, body, k = None, [], 0
    for turn, text in rows:
        part = 0
        for line in text.split("\n"):
            role, begins = STATES[path[k]]
            if begins:
                if piece:
                    yield (*piece, False, "\n".join(body))
                piece, body, part = (False, turn, part, ROLES[role]), [], part + 1
                marked, at = marker(line)
                line = line[at:] if marked == role else line
            elif piece is None:
                piece = (True, None, 0, None)
            body.append(line)
            k += 1
    if piece:
        yield (*piece, not piece[0], "\n".join(body))


def _streamed(run: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, most: int = 2048) -> Callable:
    """Turns a function over rows (tuples) into one over Arrow batches."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in run(r for b in source for r in zip(*(c.to_pylist() for c in b.columns))):
            held.append(row)
            if len(held) >= most:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return batches


_BIG, _BIGS = pa.int64(), pa.list_(pa.int64())
_KEYS = [(k, _BIG) for k in KEY]


def _placed(rows: DataFrame) -> DataFrame:
    """Adds the block (hb, at, sub) of each row: bucket of the turn; the turn and part of it where a bucket is dense."""
    rows = rows.withColumn("hb", F.floor(F.col("turn") / BLOCK))
    dense = written(rows.groupBy("conv_id", "hb").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * BLOCK).select("conv_id", "hb"), "chat-dense")
    turns = rows.select("conv_id", "hb", "turn").join(dense, ["conv_id", "hb"], "left_semi").groupBy("conv_id", "turn").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("subs"))
    turns = written(turns, "chat-turns")  # read again, its size is known to the join
    rows = rows.join(turns, ["conv_id", "turn"], "left")
    place = F.col("h").cast("double") / float(1 << 64) + 0.5
    sub = F.least(F.col("subs") - 1, F.floor(place * F.col("subs")))
    return rows.select("conv_id", "hb", F.when(F.col("subs").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("turn")).alias("at"), F.coalesce(sub, F.lit(0)).cast("bigint").alias("sub"), "turn", "h", "t")


def _encoded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, symbols: texts stay where they are."""
    types = {"conv_id": "bigint", "hb": "bigint", "at": "bigint", "sub": "bigint", "turn": "bigint", "h": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([symbols(t) for t in b.column(len(keys)).to_pylist()], pa.binary())
            yield pa.record_batch([*b.columns[: len(keys)], found], names=[*keys, "symbols"])

    return rows.select(*keys, "t").mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "symbols binary"]))


def _joined(column: pd.Series) -> list[bytes]:
    return [b"".join(x) for x in column]


def edges(blocks: DataFrame, model: Model) -> DataFrame:
    """KEY, prior, before, last: for each block of conversations of several, its scores, the state before it and its last one."""
    spark = blocks.sparkSession
    shape = ", ".join(f"{k} bigint" for k in KEY)

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[list(KEY)].assign(m=list(transfers(_joined(b["rows"]), model).reshape(-1, 36)))

    def forward(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, prior = None, model.start
        for *key, m in rows:
            if key[0] != conv:
                conv, prior = key[0], model.start
            yield (*key, prior.tolist())
            prior = np.maximum((prior[:, None] + np.array(m, np.int64).reshape(6, 6)).max(axis=0), NEVER)
            prior = np.maximum(prior - prior.max(), NEVER)

    def backs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends, firsts = turn_backs(_joined(b["rows"]), np.array(b["prior"].tolist(), np.int64).reshape(-1, 6), model)
            yield b[[*KEY, "prior"]].assign(ends=list(ends), firsts=list(firsts))

    def backward(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, follows, held = None, -1, None
        for *key, prior, ends, firsts in rows:
            last = int(np.argmax(np.array(ends) + model.step[:, follows])) if key[0] == conv else int(np.argmax(ends))
            if held:
                yield (*held, last if key[0] == conv else -1)
            conv, follows, held = key[0], firsts[last], (*key, prior, last)
        if held:
            yield (*held, -1)

    by_conv = lambda df, order: df.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", *order)
    found = by_conv(blocks.mapInPandas(matrices, f"{shape}, m array<bigint>"), KEY[1:]).mapInArrow(_streamed(forward, pa.schema([*_KEYS, ("prior", _BIGS)])), f"{shape}, prior array<bigint>")
    priors = written(found, "chat-priors")
    found = blocks.join(priors, list(KEY)).select(*KEY, "rows", "prior").mapInPandas(backs, f"{shape}, prior array<bigint>, ends array<bigint>, firsts array<bigint>")
    back = by_conv(found, [F.desc(k) for k in KEY[1:]]).mapInArrow(_streamed(backward, pa.schema([*_KEYS, ("prior", _BIGS), ("last", _BIG), ("before", _BIG)])), f"{shape}, prior array<bigint>, last bigint, before bigint")
    return written(back, "chat-edges")


def counts(blocks: DataFrame, model: Model) -> Model:
    """(rows, prior, last, before) -> the model of the counts over the best paths of all blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(6 + 36 + 6 * SYMBOLS, np.int64)
        for b in batches:
            found = _joined(b["rows"])
            prior = np.array([model.start if p is None else p for p in b["prior"]], np.int64).reshape(-1, 6)
            last, before = (b[c].fillna(-1).to_numpy(np.int64) for c in ("last", "before"))
            for s, path, was in zip(found, decode(found, prior, last, model), before):
                path = path.astype(np.int64)
                if was < 0:
                    total[path[0]] += 1
                else:
                    total[6 + 6 * was + path[0]] += 1
                total[6:42] += np.bincount(6 * path[:-1] + path[1:], minlength=36)
                total[42:] += np.bincount(SYMBOLS * path + np.frombuffer(s, np.uint8), minlength=6 * SYMBOLS)
        yield pd.DataFrame({"k": np.arange(len(total)), "n": total})

    sums = blocks.mapInPandas(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()  # 234 rows
    n = np.zeros(6 + 36 + 6 * SYMBOLS)
    for r in sums:
        n[r["k"]] = r["n"]
    return tables(n[:6], n[6:42].reshape(6, 6), n[42:].reshape(6, SYMBOLS))


def format_turns(lines: DataFrame, *, conv: str = "conv_id", turn: str = "turn", text: str = "text", rounds: int = 2) -> DataFrame:
    """(conv_id, turn, part, role, rendered): the turns found. ``turn`` is where one begins, ``part`` counts those that begin in one row.

    Each row of ``lines`` is one or more lines of the transcript; a row's first line is a likely beginning.
    ``lines`` is read several times, so it should be a table or a plain function of one.
    """
    spark = lines.sparkSession
    rows = lines.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    alone = rows.where("conv_id is null or turn is null")
    rows = _placed(rows.where("conv_id is not null and turn is not null"))
    encoded = _encoded(rows, [*KEY, "turn", "h"]).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("turn", "h", "symbols"))).alias("rows"))
    encoded = encoded.select(*KEY, F.transform("rows", lambda r: r["symbols"]).alias("rows"))
    singles = _encoded(alone, []).select(*(F.lit(None).cast("bigint").alias(k) for k in KEY), F.array("symbols").alias("rows"))
    blocks = written(encoded.unionByName(singles), "chat-symbols")
    many = written(blocks.where("conv_id is not null").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id"), "chat-many")
    several = blocks.join(many, "conv_id", "left_semi") if not many.isEmpty() else None
    nothing = [F.lit(None).cast("array<bigint>").alias("prior"), F.lit(None).cast("bigint").alias("last"), F.lit(None).cast("bigint").alias("before")]
    model, found = DEFAULT, None
    for k in range(rounds + 1):
        found = edges(several, model) if several is not None else None
        if k < rounds:
            known = blocks.join(found, list(KEY), "left").select("rows", "prior", "last", "before") if found else blocks.select("rows", *nothing)
            model = counts(known, model)
    final = pa.schema([("conv_id", _BIG), ("turn", _BIG), ("part", _BIG), ("role", pa.string()), ("rendered", pa.string())])
    shape = "conv_id bigint, turn bigint, part bigint, role string, rendered string"

    def decoded(source: Iterator[tuple]) -> Iterator[tuple]:
        """(key..., turn, h, text, prior, last) in order -> (key, rows, path), many blocks at a time; a row without text heads its block."""
        held: list[list] = []
        n = 0

        def done() -> Iterator[tuple]:
            whole = [b for b in held if b[1]]
            paths = decode([b"".join(symbols(t) for _, t in b[1]) for b in whole], np.array([b[2] for b in whole], np.int64).reshape(-1, 6), np.array([b[3] for b in whole], np.int64), model)
            yield from ((b[0], b[1], path) for b, path in zip(whole, paths))

        for *key, at, _, t, prior, last in source:
            if not held or held[-1][0] != key or key[0] is None:
                if n >= 2048:
                    yield from done()
                    held, n = [], 0
                held.append([key, [], model.start, -1])
            if t is None:
                held[-1][2:] = [np.array(prior, np.int64), last]
            else:
                so_far = held[-1][1]
                so_far.append((at, so_far[-1][1] if so_far and so_far[-1][1] == t else t))
                n += 1
        yield from done()

    def rendered(source: Iterator[tuple]) -> Iterator[tuple]:
        for key, block, path in decoded(source):
            for _, at, part, role, _, body in pieces(block, path):
                # a row by itself carries its conversation in the place of its bucket
                yield (key[1] if key[0] is None else key[0], at, part, role, render(role, body.strip("\n")))

    def cut(source: Iterator[tuple]) -> Iterator[tuple]:
        for key, block, path in decoded(source):
            for piece in pieces(block, path):
                yield (*key, *piece)

    def dealt(texts: DataFrame) -> DataFrame:
        return texts.repartition(partitions(spark), *KEY).sortWithinPartitions(*KEY, F.col("t").isNotNull(), "turn", "h")

    text_rows = rows.select(*KEY, "turn", "h", "t", *nothing[:2])
    lone = alone.select(F.lit(None).cast("bigint").alias("conv_id"), F.col("conv_id").alias("hb"), F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("sub"), "turn", "h", "t", *nothing[:2])
    turns = lone.mapInArrow(_streamed(rendered, final), shape)
    short = text_rows if found is None else text_rows.join(many, "conv_id", "left_anti")
    turns = dealt(short).mapInArrow(_streamed(rendered, final), shape).unionByName(turns)
    if found is None:
        return turns
    heads = found.select(*KEY, F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("string").alias("t"), "prior", "last")
    types = pa.schema([*_KEYS, ("lead", pa.bool_()), ("turn", _BIG), ("part", _BIG), ("role", pa.string()), ("ends", pa.bool_()), ("body", pa.string())])
    long = dealt(text_rows.join(many, "conv_id", "left_semi").unionByName(heads)).mapInArrow(_streamed(cut, types), ", ".join(f"{k} bigint" for k in KEY) + ", lead boolean, turn bigint, part bigint, role string, ends boolean, body string")
    long = written(long, "chat-pieces")
    # at most two rows a block: its leading piece, and its last turn, which may go on in blocks after it
    order = Window.partitionBy("conv_id").orderBy(*KEY[1:], F.desc("lead"))
    open_ = long.where("lead or ends").withColumn("run", F.sum(F.col("ends").cast("int")).over(order))
    whole = open_.groupBy("conv_id", "run").agg(F.max("turn").alias("turn"), F.max("part").alias("part"), F.max("role").alias("role"), F.array_sort(F.collect_list(F.struct(*KEY[1:], "body"))).alias("all"))
    whole = whole.select("conv_id", "turn", "part", "role", F.array_join(F.transform("all", lambda x: x["body"]), "\n").alias("body"))
    both = long.where("not lead and not ends").select("conv_id", "turn", "part", "role", "body").unionByName(whole)
    return turns.unionByName(both.select("conv_id", "turn", "part", "role", F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.trim("body", F.lit("\n")), F.lit("\n<|end|>")).alias("rendered")))


def transcript(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` as lines of a transcript, markers in one of six styles for each conversation, and none for one row in nine.

    A null role has no marker.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    name = F.coalesce("role", F.lit(""))
    cap = F.initcap(name)
    marks = [F.concat(cap, F.lit(": ")), F.concat(F.lit("### "), cap, F.lit(": ")), F.concat(F.lit("["), name, F.lit("] ")), F.concat(F.lit("<|"), name, F.lit("|> ")), F.concat(F.lit("**"), cap, F.lit(":** ")), F.concat(F.replace(F.replace(F.replace(name, F.lit("user"), F.lit("Human")), F.lit("assistant"), F.lit("AI")), F.lit("system"), F.lit("System")), F.lit(": "))]
    mark = F.element_at(F.array(*marks), (F.coalesce(style, F.lit(0)) + 1).cast("int"))
    bare = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(9)) == 0) | F.col("role").isNull()
    return conversations.select("conv_id", "turn", F.concat(F.when(bare, F.lit("")).otherwise(mark), F.coalesce("text", F.lit(""))).alias("text"))


def op10_chat(spark, sf_dir):
    """All ``conversations``, written as transcripts and parsed again."""
    return format_turns(transcript(table(spark, sf_dir, "conversations")))
