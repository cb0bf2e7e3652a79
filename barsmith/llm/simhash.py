"""Near-duplicate documents by SimHash and a binary trie self-join.

Fingerprint: XXH64 of each shingle, repeats included (see ``shingles``); a bit is set if it is set in over
half of the hashes. A text without words, or null, has fingerprint zero.

Fingerprints that differ in at most ``budget`` bits are linked, and documents of one connected component
are one class. The join runs on distinct fingerprints:

1. Of ``budget + 1`` blocks of bits, two linked fingerprints agree in one at least. Each block in turn is
   put on top of a binary trie; the nodes below an equal block are walked as pairs, differing bits add
   up from the top, and a pair of nodes over the budget is dropped with all below it.
2. Before that, fingerprints that differ within one group of ``budget`` bits are linked by grouping alone:
   they cannot be over the budget. A dense ball of near copies so becomes one class early, and a pair of
   nodes that holds only one class is dropped too.
3. A block value with over CHUNK fingerprints is walked one level further apart from the rest: the bits
   below it are cut into ``budget + 1`` blocks again, each of which leads to a node of its own. A node that
   still has more is dealt out as pairs of chunks, so no task holds more than two chunks of it, and
   chunks of one class do not meet.

Nothing is capped: every link is found, either as a pair or as a path within a class. Links between
classes, not pairs of documents, leave the tasks.

Nulls: a null id gets a class like any other, but is never a class id unless all ids in it are null.
Rows that repeat are in one class. There are no ties to break: links are symmetric, and a class goes by its smallest id. Very long
texts are hashed whole. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.llm import likeness
from barsmith.llm.common import partitions, table, written
from barsmith.llm.components import components
from barsmith.llm.dealing import meetings
from barsmith.llm.shingles import hashes, majority
from barsmith.llm.trie import settle as _settle
from barsmith.llm.trie import trie_join

BUDGET = 4
#: Most fingerprints of one block value in a chunk.
CHUNK = 2048


def simhash(text: str | None, width: int) -> int:
    """The 64-bit fingerprint, unsigned."""
    return majority(hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, fp bigint): the fingerprint's bits as a signed number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((simhash(t, width) for t in b["t"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fps.view(np.int64)})

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("t")).mapInPandas(run, "doc_id bigint, fp bigint")


def blocks(budget: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit from the top, bits) of budget + 1 blocks."""
    cuts = [round(i * bits / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _on_top(blocks_: list[tuple[int, int]], value: Column, bits: int) -> list[Column]:
    """For each block of the lowest ``bits`` bits of a value, those bits turned so that the block comes first."""
    whole = (1 << bits) - 1
    mask = F.lit(whole - (1 << 64) if whole >> 63 else whole)
    turn = lambda first: value if first == 0 else F.shiftleft(value, first).bitwiseOR(F.shiftrightunsigned(value, bits - first)).bitwiseAND(mask)
    return [turn(first) for first, _ in blocks_]


def nodes(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, class) -> fp, class, width, path, key, turned: the trie nodes at which a fingerprint meets those within the budget.

    ``turned`` is the fingerprint in the order of bits of the trie ``path``, ``key`` its first ``width`` bits. A
    node of a first block with over CHUNK fingerprints is left for its descendants: of the bits below it, again
    one of ``budget + 1`` blocks is the same in a pair.
    """
    first = blocks(budget)
    tops = _on_top(first, F.col("fp"), 64)
    each = F.array(*(F.struct(F.lit(t).alias("path"), F.lit(w).alias("width"), top.alias("turned"), F.shiftrightunsigned(top, 64 - w).alias("key")) for t, ((_, w), top) in enumerate(zip(first, tops))))
    rows = fps.select("fp", "class", F.explode(each).alias("x")).select("fp", "class", "x.*")
    size = rows.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(size, ["path", "key"])
    light = rows.where(F.col("n") <= CHUNK).drop("n")
    deep = []
    for w in sorted({w for _, w in first}):
        bits = 64 - w
        second = blocks(budget, bits)
        rest = F.col("turned").bitwiseAND(F.lit((1 << bits) - 1))
        for s, ((_, w2), low) in enumerate(zip(second, _on_top(second, rest, bits))):
            turned = F.shiftleft(F.col("key"), bits).bitwiseOR(low)
            deep.append(F.when(F.col("width") == w, F.struct((F.col("path") * 100 + 100 + s).alias("path"), F.lit(w + w2).alias("width"), turned.alias("turned"), F.shiftrightunsigned(turned, bits - w2).alias("key"))))
    below = rows.where(F.col("n") > CHUNK).select("fp", "class", F.explode(F.filter(F.array(*deep), lambda x: x.isNotNull())).alias("x")).select("fp", "class", "x.*")
    return light.select(*below.columns).unionByName(below)


def class_links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, class) of distinct fingerprints -> (u, v): links between classes that join all that is within the budget."""
    spark = fps.sparkSession
    rows = meetings(nodes(fps, budget), ["path", "key"], "fp", CHUNK).select("path", "width", "key", "meet", "turned", "class")
    rows = rows.repartition(4 * partitions(spark), "path", "key", "meet").sortWithinPartitions("path", "key", "meet")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def links(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for width, part in rows.groupby("width"):
                turned = part["turned"].to_numpy().view(np.uint64)
                group = part.groupby(["path", "key", "meet"], sort=False).ngroup().to_numpy()
                order = np.lexsort((turned, group))
                turned, group, cls = turned[order], group[order], part["class"].to_numpy()[order]
                edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
                # equal classes start joined: label = first index of the class within the group
                key = np.lexsort((cls, group))
                new = np.concatenate(([True], (cls[key][1:] != cls[key][:-1]) | (group[key][1:] != group[key][:-1])))
                label = np.empty(len(cls), np.int64)
                label[key] = np.minimum.reduceat(key, np.flatnonzero(new))[np.cumsum(new) - 1]
                before = label.copy()
                trie_join(turned, list(zip(edge[:-1].tolist(), edge[1:].tolist())), int(width), budget, label)
                moved = label != before
                out.append(pd.DataFrame({"u": cls[moved], "v": cls[label[moved]]}).drop_duplicates())
            return pd.concat(out) if out else pd.DataFrame({"u": [], "v": []}, dtype=np.int64)

        for b in batches:  # whole groups at a time; the last one may go on
            held.append(b)
            if sum(map(len, held)) >= 50_000:
                rows = pd.concat(held, ignore_index=True)
                tail = rows.iloc[-1]
                on = (rows["path"] == tail["path"]) & (rows["key"] == tail["key"]) & (rows["meet"] == tail["meet"])
                held = [rows[on]]
                if not on.all():
                    yield links(rows[~on])
        if held:
            yield links(pd.concat(held, ignore_index=True))

    return rows.mapInPandas(run, "u bigint, v bigint")


def ball_links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(u, v): each fingerprint with the smallest that differs from it only within one group of ``budget`` bits."""
    masks = [~(((1 << budget) - 1) << s) & (1 << 64) - 1 for s in range(0, 64, budget)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("g", "masked"))
    low = keyed.groupBy("g", "masked").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keyed.join(low, ["g", "masked"]).where("fp <> v").select(F.col("fp").alias("u"), "v")


def bit_classes(docs: DataFrame, id_col: str, text: str, width: int, budget: int) -> DataFrame:
    each = written(fingerprints(docs, id_col, text, width), "simhash")
    fps = written(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    balls = components(ball_links(fps, budget))
    fps = written(fps.join(balls.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("class")), "simhash-class")
    joined = components(class_links(fps, budget))
    fps = fps.join(joined.withColumnRenamed("node", "class"), "class", "left").select("fp", "least", F.coalesce("root", "class").alias("root"))
    fps = written(fps, "simhash-root")
    ids = fps.groupBy("root").agg(F.min("least").alias("component_id"))
    known = fps.join(ids, "root").select("fp", "component_id")
    return each.join(known, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 5, budget: int = BUDGET, least: float | None = likeness.LEAST) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    With ``least``, documents are linked by the Jaccard likeness of their shingles: pairs that the tries of several
    fingerprints find are compared exactly (see :mod:`barsmith.llm.likeness`), and ``budget`` is that module's. Two more columns then tell rows without an id apart:
    ``text_hash`` (XXH64) and ``class``, the same number for all of a class. Without ``least``, by the bits alone.
    """
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    if least is None:
        return bit_classes(docs, id_col, text, width, budget).select("doc_id", shown, "component_id")
    rows = written(likeness.near_copies(docs, id_col=id_col, text=text, width=width, least=least), "simhash-near")
    ids = rows.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return rows.join(ids, "class").select("doc_id", shown, "component_id", F.col("h").alias("text_hash"), "class")


def op5_simhash(spark, sf_dir):
    """All ``documents`` with shingles of four words and at most four differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, budget=4, least=None)
