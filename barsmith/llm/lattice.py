"""Near-duplicate embeddings by hashing to cells of the E8 lattice.

A random rotation cuts a unit vector into blocks of eight coordinates; each block is one hash table. A
block's coordinates, divided by a scale (by default one that leaves each block a share of SHARE
of the squared distance of a pair at the threshold), are decoded to the nearest point of E8, which is the vector's
cell. A vector also probes every cell whose lattice point lies within ``reach`` of its own coordinates.
Two vectors meet in a table if one of them probes the other's cell; each pair that meets is verified by
its cosine in double precision. As the squared distance of a pair is the sum of those of its blocks, one
block at least has no more than its share, and near pairs meet in some table.

Equal vectors are collapsed first and counted. A pair that meets in several tables is counted in the
first; that is recomputed from the two vectors, so pairs are never written out, sorted or compared with
each other: a task adds up each vector's number of links and sends the links that join classes. A cell
with over CHUNK vectors that are stored in it or probe it is dealt out in parts.

Vectors are compared with those of their own length: each length has its rotation and its cells.

Nulls: a vector that is null, all zero, of another length than ``dim`` (if that is asked for), or holds null or
non-finite components links with nothing and is a class of its own; so is a null id. Rows that repeat
count as vectors of their own. A pair at exactly the threshold is linked; there are no other ties. Vectors of any finite size are
scaled first, so none overflows. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import partitions, table, written
from barsmith.llm.components import components
from barsmith.llm.simhash import _settle

SHARE, REACH, CHUNK = 1.25, 1.25, 256


def _shells() -> np.ndarray:
    """The 1 + 240 + 2160 points of E8 with norm 0, 2 and 4."""
    points = [np.zeros(8)]
    for (i, j), (a, b) in product(combinations(range(8), 2), product((1, -1), repeat=2)):
        points.append(a * np.eye(8)[i] + b * np.eye(8)[j])
    halves = [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    points += halves
    points += [s * 2 * np.eye(8)[i] for i in range(8) for s in (1, -1)]
    for four, signs in product(combinations(range(8), 4), product((1, -1), repeat=4)):
        v = np.zeros(8)
        v[list(four)] = signs
        points.append(v)
    for i, s in product(range(8), product((1, -1), repeat=8)):
        v = np.array(s) / 2
        v[i] *= 3
        if round(v.sum()) % 2 == 0:
            points.append(v)
    return np.array(points)


SHELLS = _shells()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum (the lattice D8)."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    gap = x[odd] - near[odd]
    worst = np.abs(gap).argmax(axis=1)
    near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 moved by a half in each coordinate."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def scale_of(dim: int, cosine: float) -> float:
    """The scale at which a block's share of the squared distance of a pair at ``cosine`` is SHARE."""
    return max(1e-6, float(np.sqrt(2 * (1 - cosine) / (SHARE * -(-dim // 8)))))


@cache
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, with zero rows added up to a multiple of eight."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    turned = q * np.sign(np.diag(r))
    return np.vstack([turned.T, np.zeros((-dim % 8, dim))]).T


def _keys(points: np.ndarray, t: int, dim: int) -> np.ndarray:
    """A 64-bit number for a lattice point in a table of a length; points are half-integers, so doubled they are integers."""
    key = np.full(len(points), (dim << 20) + t + 1, np.uint64)
    with np.errstate(over="ignore"):
        for c in (2 * points).round().astype(np.int64).T:
            key = (key ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; divided by their largest component first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def tables_of(blocks: int, joint: int) -> list[tuple[int, ...]]:
    """The blocks of each hash table: every choice of ``joint`` of them."""
    return list(combinations(range(blocks), min(joint, blocks)))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for two."""
    with np.errstate(over="ignore"):
        key = (a.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
        key = (key ^ (key >> np.uint64(32))) + b.view(np.uint64)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        return (key ^ (key >> np.uint64(31))).view(np.int64)


def cells(vectors: np.ndarray, turn: np.ndarray, scale: float, reach: float, joint: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """Own cell of each vector in each table, and the cells it probes (its own among them)."""
    own, probes = block_cells(vectors, turn, scale, reach)
    if joint == 1:
        return np.stack(own, axis=1), [np.concatenate([p[i] for p in probes]) for i in range(len(vectors))]
    keys, asked = [], [[] for _ in range(len(vectors))]
    for chosen in tables_of(len(own), joint):
        key = own[chosen[0]]
        for t in chosen[1:]:
            key = _mixed(key, own[t])
        keys.append(key)
        for i, mine in enumerate(asked):
            some = probes[chosen[0]][i]
            for t in chosen[1:]:
                some = _mixed(np.repeat(some, len(probes[t][i])), np.tile(probes[t][i], len(some)))
            mine.append(some)
    return np.stack(keys, axis=1), [np.concatenate(p) for p in asked]


def block_cells(vectors: np.ndarray, turn: np.ndarray, scale: float, reach: float) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """For each block, the cell of each vector and the cells within reach of it."""
    x = _unit(vectors) @ turn / scale
    own, probes = [], []
    squares = (SHELLS**2).sum(axis=1)
    for t in range(x.shape[1] // 8):
        block = x[:, 8 * t : 8 * t + 8]
        near = decode(block)
        rest = block - near
        far = (rest**2).sum(axis=1)[:, None] - 2 * rest @ SHELLS.T + squares
        i, k = np.nonzero(far <= reach**2 + 1e-9)
        own.append(_keys(near, t, vectors.shape[1]))
        probes.append(np.split(_keys(near[i] + SHELLS[k], t, vectors.shape[1]), np.searchsorted(i, np.arange(1, len(x)))))
    return own, probes


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def by_length(rows: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """(length, rows) for vectors of each length."""
    lengths = rows["v"].map(len)
    if len(rows) and lengths.min() == lengths.max():
        return iter([(int(lengths.iloc[0]), rows)])
    return ((int(n), part) for n, part in rows.groupby(lengths, sort=True))


@dataclass
class Side:
    """Vectors of one side of a comparison: unit vectors, coordinates and lattice points of all tables, ids, copies."""

    unit: np.ndarray
    at: np.ndarray
    points: np.ndarray
    rep: np.ndarray
    copies: np.ndarray

    def take(self, i) -> Side:
        return Side(self.unit[i], self.at[i], self.points[i], self.rep[i], self.copies[i])


def side(rows: pd.DataFrame, turn: np.ndarray, scale: float) -> Side:
    unit = _unit(_stacked(rows["v"]))
    at = unit @ turn / scale
    points = np.hstack([decode(at[:, i : i + 8]) for i in range(0, at.shape[1], 8)])
    return Side(unit, at, points, rows["rep"].to_numpy(), rows["copies"].to_numpy())


def _met_before(q: Side, s: Side, table_: int, low: np.ndarray, reach: float, cross: bool, joint: int) -> np.ndarray:
    """Whether a pair, of which q probes s's cell in ``table_``, has met before that.

    Meetings are in order of tables; within one, first the vector with the smaller id probes. ``cross``:
    all pairs of q and s, else pair by pair.
    """
    limit = reach**2 + 1e-9

    def near(a: np.ndarray, p: np.ndarray, t: int) -> np.ndarray:
        x, y = a[:, 8 * t : 8 * t + 8], p[:, 8 * t : 8 * t + 8]
        if cross:
            return (x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1) <= limit
        return ((x - y) ** 2).sum(axis=1) <= limit

    def probed(a: Side, b: Side, chosen: tuple[int, ...]) -> np.ndarray:
        return np.logical_and.reduce([near(a.at, b.points, t) for t in chosen])

    turned = (lambda m: m.T) if cross else (lambda m: m)
    tables = tables_of(q.at.shape[1] // 8, joint)
    met = np.zeros(low.shape, bool)
    for chosen in tables[:table_]:
        met |= probed(q, s, chosen) | turned(probed(s, q, chosen))
    return met | (~low & turned(probed(s, q, tables[table_])))


def pair_links(q: Side, s: Side, table_: int, cosine: float, reach: float, joint: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the linked pairs of two sides that meet first here. Blocks keep the matrices small."""
    found = []
    for i in range(0, len(q.rep), 1024):
        for j in range(0, len(s.rep), 1024):
            x, y = q.take(slice(i, i + 1024)), s.take(slice(j, j + 1024))
            near = (x.unit @ y.unit.T >= cosine - 1e-9) & (x.rep[:, None] != y.rep[None])
            if not near.any():
                continue
            if near.mean() > 0.05:
                near &= ~_met_before(x, y, table_, x.rep[:, None] < y.rep[None], reach, True, joint)
                a, b = np.nonzero(near)
            else:
                a, b = np.nonzero(near)
                first = ~_met_before(x.take(a), y.take(b), table_, x.rep[a] < y.rep[b], reach, False, joint)
                a, b = a[first], b[first]
            keep = np.concatenate([np.einsum("ij,ij->i", x.unit[a[k : k + 65536]], y.unit[b[k : k + 65536]]) >= cosine for k in range(0, len(a), 65536)] or [np.zeros(0, bool)])
            found.append((a[keep] + i, b[keep] + j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def valid(column: str, dim: int | None) -> F.Column:
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.lit(True) if dim is None else F.size(x) == dim) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", dim: int | None = None, cosine: float = 0.95, scale: float | None = None, reach: float = REACH, joint: int = 1, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``vectors``.

    ``joint``: blocks whose cells make one key. Pairs that meet by chance grow with the square of the table, at
    a rate that each further block divides by some 10,000; with two there are more tables and probes, and recall
    at the threshold itself is lower. One suits some millions of vectors, two a thousand times as many.
    """
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector).alias("v"))
    every = every.withColumn("ok", valid("v", dim) & F.col("vec_id").isNotNull())
    # numbers are kept as they are stored, and made double where they are compared
    held_as = "array<float>" if dict(every.dtypes)["v"] == "array<float>" else "array<double>"
    distinct = written(every.where("ok").groupBy(F.col("v").cast(held_as).alias("v")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "lattice-distinct")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 512):
                for n, part in by_length(b.iloc[i : i + 512]):
                    own, probes = cells(_stacked(part["v"]), rotation(n, seed), scale or scale_of(n, cosine), reach, joint)
                    yield pd.DataFrame({"rep": part["rep"].to_numpy(), "own": list(own), "probes": probes})

    hashes = written(distinct.repartition(partitions(spark)).select("rep", "v").mapInPandas(hashed, "rep bigint, own array<bigint>, probes array<bigint>"), "lattice-cells")
    own = hashes.select("rep", F.posexplode("own").alias("t", "cell"))
    held = own.groupBy("cell").agg(F.count(F.lit(1)).alias("stored"), F.min("rep").alias("one"))
    probes = hashes.select("rep", F.explode("probes").alias("cell")).join(held, "cell").where("stored > 1 or one <> rep").select("cell", "rep")
    probes = written(probes, "lattice-probes")
    # a cell is a grid of parts: chunks of those stored in it by chunks of those that ask
    size = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("a")).join(held.select("cell", F.ceil(F.col("stored") / CHUNK).cast("int").alias("s")), "cell")
    chunk = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = own.join(size, "cell").withColumn("other", each("a")).select("t", "cell", "rep", (F.col("other") * F.col("s") + chunk("s")).alias("part"), F.lit(True).alias("stored"))
    asking = probes.join(size, "cell").withColumn("other", each("s")).select(F.lit(None).cast("int").alias("t"), "cell", "rep", (chunk("a") * F.col("s") + F.col("other")).alias("part"), F.lit(False).alias("stored"))
    rows = stored.unionByName(asking).join(distinct, "rep").repartition(4 * partitions(spark), "cell", "part").sortWithinPartitions("cell", "part", F.desc("stored"))

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def links(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            return (linked(part.reset_index(drop=True), n) for n, part in by_length(rows))

        def linked(rows: pd.DataFrame, n: int) -> pd.DataFrame:
            every = side(rows, rotation(n, seed), scale or scale_of(n, cosine))
            stored, tables = rows["stored"].to_numpy(), rows["t"].fillna(0).to_numpy().astype(np.int64)
            cell, part = rows["cell"].to_numpy(), rows["part"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))))
            ends = np.append(starts[1:], len(rows))
            n_stored = np.add.reduceat(stored.astype(np.int64), starts)  # the stored come first
            n_asking = ends - starts - n_stored
            a, b = [], []
            for g in np.flatnonzero((n_stored > 0) & (n_asking > 0) & (n_stored * n_asking > 256)):
                lo, mid, hi = starts[g], starts[g] + n_stored[g], ends[g]
                x, y = pair_links(every.take(slice(mid, hi)), every.take(slice(lo, mid)), int(tables[lo]), cosine, reach, joint)
                a.append(x + mid)
                b.append(y + lo)
            small = np.flatnonzero((n_stored > 0) & (n_asking > 0) & (n_stored * n_asking <= 256))
            for i in range(0, len(small), 4096):  # pairs of many small cells at once
                g = small[i : i + 4096]
                per = n_stored[g] * n_asking[g]
                which = np.repeat(g, per)
                k = np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per)
                x, y = starts[which] + n_stored[which] + k // n_stored[which], starts[which] + k % n_stored[which]
                near = (np.einsum("ij,ij->i", every.unit[x], every.unit[y]) >= cosine) & (every.rep[x] != every.rep[y])
                x, y, t = x[near], y[near], tables[starts[which[near]]]
                for one in np.unique(t):
                    p, o = x[t == one], y[t == one]
                    first = ~_met_before(every.take(p), every.take(o), int(one), every.rep[p] < every.rep[o], reach, False, joint)
                    a.append(p[first])
                    b.append(o[first])
            a, b = np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])
            ids, copies = every.rep, every.copies
            nodes, at = np.unique(ids, return_inverse=True)
            total = np.bincount(at[a], copies[b], len(nodes)) + np.bincount(at[b], copies[a], len(nodes))
            label = np.arange(len(nodes))
            _settle(label, at[a], at[b])  # a link to the first of its class for each vector joins what all links join
            some = np.flatnonzero(total > 0)
            return pd.DataFrame({"rep": nodes[some], "other": nodes[label[some]], "n": total[some].astype(np.int64)})

        for b in batches:  # whole cells at a time; the last one may go on
            held.append(b)
            if sum(map(len, held)) >= 20_000:
                rows = pd.concat(held, ignore_index=True)
                last = (rows["cell"] == rows["cell"].iloc[-1]) & (rows["part"] == rows["part"].iloc[-1])
                held = [rows[last]]
                if not last.all():
                    yield from links(rows[~last])
        if held and sum(map(len, held)):
            yield from links(pd.concat(held, ignore_index=True))

    found = written(rows.mapInPandas(verified, "rep bigint, other bigint, n bigint"), "lattice-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("other").alias("v")))
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    of = distinct.select("v", "rep", "copies").join(counts, "rep", "left").join(roots.join(least, "root").select(F.col("node").alias("rep"), "component_id"), "rep", "left")
    of = of.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    good = every.where("ok").withColumn("v", F.col("v").cast(held_as)).join(of, "v").select("vec_id", "n_links", "component_id")
    alone = every.where("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embeddings(spark, sf_dir):
    """All rows of ``embeddings``, linked at cosine 0.95 and above."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)
