"""Near copies by SimHash tries, held to the Jaccard likeness of their shingles.

Words and shingles are those of ``shingles``, each shingle counted once. Two documents are linked if their
sets of shingles have a Jaccard likeness of ``least`` or more, and documents of one connected component
are one class. One fingerprint of 64 bits is not enough for that: at a likeness of 0.8 two of them differ in
9.7 bits on average, and a walk whose budget finds nearly all such pairs visits most pairs of nodes. So each set
has several fingerprints, under hashes of their own, and each of them a trie.

1. Documents of one set of shingles are one node; the node is a hash of the set.
2. Each set has ``tries`` SimHash fingerprints. In the trie of each, sets below one node at depth ``top`` are walked as pairs of
   nodes with an error budget (``trie_join``). A pair within BUDGET bits that is within WHOLE bits with the next fingerprint
   too is a candidate. ``tries_for`` takes ``top`` and ``tries`` from the number of rows, so that a node holds some
   NODE sets and a pair at ``least`` is missed by all tries with probability MISS at most.
3. Nodes with over MEET sets are dealt in chunks that meet each other, so no task holds more than two chunks of one.
4. Candidates are gathered to components. In one of at most CHUNK sets every pair whose fingerprints differ in at most a
   quarter of their bits is compared shingle by shingle, unless both are of one class already. In a larger one each set is first
   compared with the one that the trie joined it to; then its sets meet in chunks that leave out pairs of one
   class, so what is sent grows with the sets times the chunks of those still apart.

So no link is made below ``least``. MISS is by calculation with the angle between two sets, which a likeness bounds; sets of four
and five shingles differ in more bits, as ties are zero, and are missed with probability 0.01. Links, not pairs of documents,
leave the tasks. Nothing is capped.

Nulls: a null text is the empty text; texts without words are one class. A null id is an id like any other.
Rows that repeat are in one class. An empty table gives an empty result. Only the named columns are read. Rows are counted, which runs a job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import partitions, written
from barsmith.llm.components import components
from barsmith.llm.dealing import meetings
from barsmith.llm.shingles import hashes, majority
from barsmith.llm.trie import settle, trie_join

LEAST, MISS = 0.8, 1e-4
#: Most differing bits of one fingerprint, and of two; sets below a node, and the least depth of such nodes.
BUDGET, WHOLE, NODE, TOP = 12, 32, 512, 4
#: Most sets of one component in a chunk, and of one node; rows walked together.
CHUNK, MEET, ROWS = 512, 2048, 50_000

#: The lowest bits of counters of two, four and eight bits, all of them set.
_EVERY = {2: np.uint64(0x5555555555555555), 4: np.uint64(0x3333333333333333), 8: np.uint64(0x0F0F0F0F0F0F0F0F)}


def tries_for(rows: int, least: float = LEAST) -> tuple[int, int]:
    """(top, tries): the depth at which nodes of ``rows`` sets hold NODE of them, and how many tries miss a pair at ``least`` with MISS."""
    top = min(40, max(TOP, math.ceil(math.log2(max(rows, 1) / NODE))))
    # of two sets with likeness J the cosine is 2 J / (1 + J) at least; a bit differs with their angle over pi
    differ = math.acos(2 * least / (1 + least)) / math.pi
    below = 64 - top
    found = (1 - differ) ** top * sum(math.comb(below, k) * differ**k * (1 - differ) ** (below - k) for k in range(BUDGET + 1))
    return top, max(2, math.ceil(math.log(MISS) / math.log(1 - found))) if found < 1 else 2


@cache
def _orders(tries: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and terms of the hashes of each fingerprint."""
    random = np.random.default_rng(11).integers(0, 1 << 63, (tries, 2), dtype=np.uint64)
    return random[:, :1] * np.uint64(2) + np.uint64(1), random[:, 1:]


def fingerprints(found: np.ndarray, tries: int) -> np.ndarray:
    """``tries`` SimHash fingerprints (uint64) of a set of hashes that is not empty: a bit is set if it is set in over half of its hashes."""
    factor, term = _orders(tries)
    counts = np.zeros((tries, 8, 8), np.int64)
    for i in range(0, len(found), 255):
        part = found[None, i : i + 255]
        x = np.zeros((tries, part.shape[1] + -part.shape[1] % 15), np.uint64)
        y = x[:, : part.shape[1]]
        np.multiply(factor, part, out=y)
        y += term
        y ^= y >> np.uint64(32)
        y *= np.uint64(0xD6E8FEB86659FD93)
        y ^= y >> np.uint64(32)
        # counters of two bits for three hashes, of four for fifteen, of eight for all of the part
        for one in (0, 1):
            two = ((x >> np.uint64(one)) & _EVERY[2]).reshape(tries, 3, -1).sum(axis=1)
            for pair in (0, 2):
                four = ((two >> np.uint64(pair)) & _EVERY[4]).reshape(tries, 5, -1).sum(axis=1)
                for half in (0, 4):
                    counts[:, :, one + pair + half] += ((four >> np.uint64(half)) & _EVERY[8]).sum(axis=1).view(np.uint8).reshape(tries, 8)
    return np.packbits((2 * counts > len(found)).reshape(tries, 64), axis=1, bitorder="little").view(np.uint64).reshape(tries)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard of two sorted arrays of different values."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return both / (len(x) + len(y) - both)


def linked(texts: list[str], width: int, least: float, tries: int, classes: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that join all texts with a path of links among those with fingerprints a quarter of their bits apart.

    Texts of equal ``classes`` are joined already.
    """
    sets = [np.unique(hashes(t, width)) for t in texts]
    prints = np.array([fingerprints(s, tries) for s in sets])
    sizes = np.array([len(s) for s in sets], np.int64)
    label = np.arange(len(sets)) if classes is None else np.unique(np.array(classes), return_inverse=True)[1]
    close: list[np.ndarray] = []
    for k in range(1, len(sets)):
        apart = np.bitwise_count(prints[:k] ^ prints[k]).sum(axis=1, dtype=np.int64)
        # a likeness cannot be more than the smaller size divided by the larger
        near = np.flatnonzero((label[:k] != label[k]) & (apart <= 16 * tries) & (np.minimum(sizes[:k], sizes[k]) >= least * np.maximum(sizes[:k], sizes[k])))
        if len(near):
            close.append(np.stack((apart[near], near, np.full(len(near), k)), axis=1))
    if not close:
        return []
    pairs = np.concatenate(close)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    out = []
    for _, a, b in pairs.tolist():
        if label[a] != label[b] and likeness(sets[a], sets[b]) >= least:
            label[label == label[b]] = label[a]
            out.append((a, b))
    return out


def keyed(docs: DataFrame, id_col: str, text: str, width: int, tries: int) -> DataFrame:
    """(doc_id, h, fp, node, prints array<bigint>): the hash of the text, its SimHash, the hash of its set; prints is empty for the empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps, nodes, prints = [], [], []
            for t in b["t"]:
                every = hashes(t, width)
                found = np.unique(every)
                fps.append(majority(every))
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), 7))
                prints.append(fingerprints(found, tries).view(np.int64) if len(found) else np.zeros(0, np.int64))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "h": b["h"], "fp": np.array(fps, np.uint64).view(np.int64), "node": np.array(nodes, np.uint64).view(np.int64), "prints": prints})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    return rows.mapInPandas(run, "doc_id bigint, h bigint, fp bigint, node bigint, prints array<bigint>")


def trie_links(sets: DataFrame, top: int, tries: int) -> DataFrame:
    """(node, prints) -> (u, v): links that join all candidates of each trie."""
    spark = sets.sparkSession
    each = F.transform("prints", lambda x, k: F.struct(k.alias("k"), x.alias("value"), F.get("prints", (k + 1) % tries).alias("other")))
    rows = sets.select("node", F.explode(each).alias("x")).select("node", "x.*")
    spot = F.shiftleft(F.col("k").cast("bigint"), top).bitwiseOR(F.shiftrightunsigned("value", 64 - top))
    rows = rows.select(spot.alias("spot"), "value", "other", "node")
    heavy = written(rows.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MEET).select("spot"), "likeness-heavy")
    dealt = rows.withColumn("meet", F.lit(0).cast("bigint"))
    if not heavy.isEmpty():
        parts = meetings(rows.join(heavy, "spot", "left_semi").withColumn("class", F.col("node")), ["spot"], "node", MEET)
        dealt = dealt.join(heavy, "spot", "left_anti").unionByName(parts.select(*dealt.columns))
    dealt = dealt.repartition(4 * partitions(spark), "spot", "meet").sortWithinPartitions("spot", "meet")

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        value, other = rows["value"].to_numpy().view(np.uint64), rows["other"].to_numpy().view(np.uint64)
        group = rows.groupby(["spot", "meet"], sort=False).ngroup().to_numpy()
        order = np.lexsort((value, group))
        value, other, group, node = value[order], other[order], group[order], rows["node"].to_numpy()[order]
        edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        label = np.arange(len(node))

        def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.bitwise_count(value[x] ^ value[y]).astype(np.int64) + np.bitwise_count(other[x] ^ other[y]) <= WHOLE

        # neighbours in the order of the trie first: a dense group is one class before it is walked
        x = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(value[1:] ^ value[:-1]) <= BUDGET))
        x = x[near(x, x + 1)]
        settle(label, x, x + 1)
        trie_join(value, list(zip(edge[:-1].tolist(), edge[1:].tolist())), top, BUDGET, label, near)
        moved = label != np.arange(len(node))
        return pd.DataFrame({"u": node[moved], "v": node[label[moved]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:  # whole nodes at a time; the last one may go on
            held.append(b)
            if sum(map(len, held)) >= ROWS:
                rows = pd.concat(held, ignore_index=True)
                on = (rows["spot"] == rows["spot"].iloc[-1]) & (rows["meet"] == rows["meet"].iloc[-1])
                held = [rows[on]]
                if not on.all():
                    yield links(rows[~on])
        if held:
            yield links(pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(run, "u bigint, v bigint")


def compared(rows: DataFrame, group: list[str], width: int, least: float, tries: int) -> DataFrame:
    """(group, node, class, t), sorted by group within partitions -> (u, v): links that join what is linked in each group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def found() -> pd.DataFrame:
            nodes, classes, texts = zip(*held)
            pairs = np.array(linked(list(texts), width, least, tries, list(classes)), np.int64).reshape(-1, 2)
            of = np.array(nodes, np.int64)
            return pd.DataFrame({"u": of[pairs[:, 0]], "v": of[pairs[:, 1]]})

        for b in batches:
            for *at, node, cls, t in zip(*(b[c].tolist() for c in (*group, "node", "class", "t"))):
                if at != key:
                    if len(held) > 1:
                        yield found()
                    key, held = at, []
                held.append((node, cls, t))
        if len(held) > 1:
            yield found()

    spark = rows.sparkSession
    dealt = rows.repartition(4 * partitions(spark), *group).sortWithinPartitions(*group)
    return dealt.select(*group, "node", "class", "t").mapInPandas(run, "u bigint, v bigint")


def stars(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """(u, v) -> those that are linked. Pairs are dealt by v in parts, each with the text of v at its head."""
    spark = pairs.sparkSession
    parts = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    members = pairs.join(parts, "v").select("v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("place"), F.col("u").alias("node")).join(texts, "node")
    heads = parts.select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("place"), F.col("v").alias("node")).join(texts, "node")
    rows = members.select("v", "part", "place", "node", "t").unionByName(heads.select("v", "part", "place", "node", "t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = None
        for b in batches:
            out = []
            for v, place, node, t in zip(b["v"].tolist(), b["place"].tolist(), b["node"].tolist(), b["t"]):
                found = np.unique(hashes(t, width))
                if place == 0:
                    head = found
                elif likeness(found, head) >= least:
                    out.append((node, v))
            yield pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    return rows.repartition(4 * partitions(spark), "v", "part").sortWithinPartitions("v", "part", "place").mapInPandas(run, "u bigint, v bigint")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 5, least: float = LEAST) -> DataFrame:
    """(doc_id, h, fp, class bigint): one row for each row of ``docs``; h is the XXH64 of the text, fp its SimHash, class a node of the class."""
    top, tries = tries_for(docs.count(), least)  # one number
    each = written(keyed(docs, id_col, text, width, tries), "likeness")
    # one text for each set; any text of a set has the same shingles
    sets = each.where(F.size("prints") > 0).groupBy("node").agg(F.min("h").alias("h"), F.first("prints").alias("prints"))
    sets = written(sets, "likeness-sets")
    near = written(trie_links(sets, top, tries).distinct(), "likeness-near")
    candidates = components(near)
    size = candidates.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    candidates = written(candidates.join(size, "root").join(sets.select("node", "h"), "node"), "likeness-candidates")
    texts = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("t")).join(candidates, "h").groupBy("root", "n", "node").agg(F.first("t").alias("t"))
    small = compared(texts.where(F.col("n") <= CHUNK).withColumn("class", F.col("node")), ["root"], width, least, tries)
    large = candidates.where(F.col("n") > CHUNK)
    if large.isEmpty():
        found = small
    else:
        some = written(texts.where(F.col("n") > CHUNK).select("node", "t"), "likeness-texts")
        found = written(stars(near.join(large.select(F.col("node").alias("u")), "u", "left_semi"), some, width, least), "likeness-stars")
        class_of = components(found).withColumnRenamed("root", "class")
        open_ = written(large.select("root", "node").join(class_of, "node", "left").select("root", "node", F.coalesce("class", "node").alias("class")), "likeness-open")
        rest = meetings(open_, ["root"], "node", CHUNK).join(some, "node")
        found = small.unionByName(found).unionByName(compared(rest, ["root", "meet"], width, least, tries))
    classes = components(found).withColumnRenamed("root", "class")
    return each.select("doc_id", "h", "fp", "node").join(classes, "node", "left").select("doc_id", "h", "fp", F.coalesce("class", "node").alias("class"))
