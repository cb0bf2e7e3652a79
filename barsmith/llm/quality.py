"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every whole text is reduced to the statistics of :data:`STATISTICS`. They are standardised, and random
Fourier features approximate a Gaussian kernel over them. Partitions sum their part of the normal
equations, one set for each of a few folds; the sums are small matrices, and solving them gives the ridge
weights. Leaving out one fold at a time gives scores for the calibration that the weights have not seen;
these are binned, and pool-adjacent-violators over the bins makes the score a probability.

Labels are learned from at most ``max_rows`` labelled rows, chosen by a hash of the row if there are more; rows of one id
and text count once. Everything else covers all rows, and very long texts are read whole. Inputs of a score are the text only.
A score of exactly one half predicts 1.

Nulls: a null text is the empty text and is scored like any other; a null id is never labelled nor held
out; null labels are not learned from. If an id has several labels, their mean is learned. Without labels
of both kinds every score is the share of good labels, or 0.5. Rows that repeat are scored alike. An empty table
gives an empty result. Extra columns are kept beside the score by :func:`score_rows`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import crc32_mod, partitions, table, written
from barsmith.llm.rows import with_vector

STATISTICS = (
    "log characters", "log words", "mean word length", "deviation of word length", "longest word",
    "letters", "digits", "capitals", "white space", "sentence marks", "symbols", "bytes beyond ASCII",
    "lines per word", "repeated lines", "distinct words", "commonest word", "doubled words", "distinct pairs", "words in capitals", "words ending in marks", "byte entropy",
)
#: Most labelled rows that are learned from.
MAX_ROWS = 50_000
_MARKS = b".,;:!?'\"-()"


def _classes() -> np.ndarray:
    code = np.arange(256)
    ascii_letter = ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
    digit, upper, space = (code >= 48) & (code <= 57), (code >= 65) & (code <= 90), (code == 32) | ((code >= 9) & (code <= 13))
    marks, beyond = np.isin(code, list(_MARKS)), code >= 128
    return np.array([ascii_letter, digit, upper, space, marks, ~(ascii_letter | digit | space | marks | beyond), beyond], np.float64)


CLASSES = _classes()


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, w = len(raw), len(words)
    if not w:
        return [math.log1p(n)] + [0.0] * (len(STATISTICS) - 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    part = counts[counts > 0] / n
    lengths = np.fromiter(map(len, words), np.float64, w)
    lines = [x for x in raw.split(b"\n") if x]
    seen = Counter(words)
    return [
        math.log1p(n), math.log1p(w), float(lengths.mean()), float(lengths.std()), math.log1p(float(lengths.max())),
        *(CLASSES @ counts / n).tolist(),
        len(lines) / w, 1 - len(set(lines)) / len(lines), len(seen) / w, max(seen.values()) / w,
        sum(map(eq, words, words[1:])) / w, len(set(zip(words, words[1:]))) / w, sum(map(bytes.isupper, words)) / w,
        sum(x[-1] not in b".,;:" and x[-1] < 128 and not x[-1:].isalnum() for x in words) / w, float(-(part * np.log(part)).sum()),
    ]


@dataclass
class Model:
    """Bounded: a few hundred numbers whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, *self.steps)


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` to learn from, with ``y``: each different row of an id once, and ``max_rows`` at most.

    If there are more, a hash of the row decides. Only ids and hashes are joined with the labels; the rows chosen are a
    table of bounded size, so that it may be broadcast. Counting them runs a job.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (crc32_mod(F.col(id_col), modulus) != held))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    rows = docs.withColumn("_h", F.xxhash64(*docs.columns))
    keys = rows.select(F.col(id_col).alias("_id"), "_h").join(known, "_id").groupBy("_h").agg(F.first("y").alias("y"))
    keys = written(keys, "labelled-rows")
    n = keys.count()
    if n > max_rows:
        order = F.xxhash64("_h", F.lit(5))
        # about as many as are wanted, and then no more
        keys = keys.where(F.pmod(order, F.lit(1 << 40)) < int((1 << 40) * max_rows / n)).orderBy(order, "_h").limit(max_rows)
    return rows.join(F.broadcast(keys), "_h").dropDuplicates(["_h"]).drop("_h")


def isotonic(score: np.ndarray, weight: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order of score: block centres and rates, for interpolation."""
    blocks: list[list[float]] = []
    for s, n, g in zip(score, weight, good):
        blocks.append([s * n, n, g])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label: str = "quality", modulus: int = 3, held: int = 1, max_rows: int = MAX_ROWS, size: int = 256, ridge: float = 1e-3, folds: int = 4, bins: int = 400, seed: int = 7) -> Model:
    """``stats``: (id, vector)."""
    k = len(STATISTICS)
    train = labelled(stats.select(id_col, "vector"), labels, label, modulus, held, max_rows, id_col).select("vector", "y", F.pmod(F.xxhash64(id_col), F.lit(folds)).cast("int").alias("fold"))
    train = written(train.repartition(partitions(stats.sparkSession)), "quality-train")
    moments = train.agg(F.count("y"), F.sum("y"), *(f(F.col("vector")[i]) for i in range(k) for f in (F.avg, F.stddev_pop))).first()
    n, good = moments[0], moments[1] or 0.0
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(k), np.ones(k), rng.normal(0, 1 / np.sqrt(k / 2), (k, size)), rng.uniform(0, 2 * np.pi, size), np.zeros(size + 1), (np.array([0.0]), np.array([good / n if n else 0.5])))
    if not 0 < good < n:
        return model
    model.mean = np.array(moments[2::2], np.float64)
    spread = np.array(moments[3::2], np.float64)
    model.scale = np.where(spread > 1e-9, spread, 1.0)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((folds, size + 1, size + 2))
        for b in batches:
            z, y, fold = model.features(np.stack(b["vector"].to_numpy())), b["y"].to_numpy(), b["fold"].to_numpy()
            for f in range(folds):
                zf = z[fold == f]
                total[f, :, :-1] += zf.T @ zf
                total[f, :, -1] += zf.T @ y[fold == f]
        yield pd.DataFrame({"fold": np.repeat(range(folds), size + 1), "i": list(range(size + 1)) * folds, "part": list(total.reshape(-1, size + 2))})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[tuple, np.ndarray] = {}
        for b in batches:
            for f, i, part in zip(b["fold"], b["i"], b["part"]):
                parts[f, i] = parts.get((f, i), 0) + part
        if parts:  # a partition may be empty
            yield pd.DataFrame({"fold": [f for f, _ in parts], "i": [i for _, i in parts], "part": list(parts.values())})

    shape = "fold int, i int, part array<double>"
    normal = np.zeros((folds, size + 1, size + 2))
    for r in train.mapInPandas(sums, shape).repartition(8, "i").mapInPandas(added, shape).collect():  # folds * (size + 1) rows
        normal[r["fold"], r["i"]] += np.array(r["part"])

    def solve(m: np.ndarray) -> np.ndarray:
        rows = max(1.0, m[-1, size])  # the constant feature counts the rows
        return np.linalg.solve(m[:, :-1] + ridge * rows / size * np.eye(size + 1), m[:, -1])

    everything = normal.sum(axis=0)
    model.weights = solve(everything)
    left_out = [solve(everything - normal[f]) for f in range(folds)]

    def unseen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z, fold = model.features(np.stack(b["vector"].to_numpy())), b["fold"].to_numpy()
            yield pd.DataFrame({"s": np.einsum("ij,ij->i", z, np.stack(left_out)[fold]), "y": b["y"]})

    scored = train.mapInPandas(unseen, "s double, y double")
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("s") + 0.5) / 2 * bins)))
    table_of_bins = scored.groupBy(at.alias("bin")).agg(F.avg("s").alias("s"), F.count("y").alias("n"), F.sum("y").alias("g")).orderBy("bin").collect()  # at most ``bins`` rows
    model.steps = isotonic(*(np.array([r[c] for r in table_of_bins], np.float64) for c in ("s", "n", "g")))
    return model


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, vector): the statistics of each row's whole text."""
    return with_vector(docs, text, lambda: lambda texts: [statistics(t) for t in texts])


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """(..., vector) -> (..., score); the model's few thousand numbers go along with the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["score"] = np.clip(model.score(np.stack(b["vector"].to_numpy())), 0.0, 1.0) if len(b) else []
            yield b.drop(columns="vector")

    kept = [f for f in rows.schema.fields if f.name != "vector"]
    from pyspark.sql.types import DoubleType, StructType

    return rows.mapInPandas(run, StructType(kept).add("score", DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", modulus: int = 3, held: int = 1, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``docs``."""
    stats = written(measured(docs.select(id_col, text), text).select(F.col(f"row.{id_col}").alias(id_col), "vector"), "quality-statistics")
    model = fit(stats, labels, id_col=id_col, modulus=modulus, held=held, **options)
    scored = _scored(stats, model)
    return scored.select(F.col(id_col).alias("doc_id"), F.coalesce(crc32_mod(F.col(id_col), modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(row, score): every column of ``docs`` in a struct beside its score."""
    chosen = {k: v for k, v in options.items() if k in ("label", "modulus", "held", "max_rows")}
    rows = labelled(docs.select(id_col, text), labels, id_col=id_col, **{"label": "quality", "modulus": 3, "held": 1, "max_rows": MAX_ROWS} | chosen)
    # only rows to learn from are measured twice
    stats = written(measured(rows.select(id_col, text), text).select(F.col(f"row.{id_col}").alias(id_col), "vector"), "quality-statistics")
    model = fit(stats, labels, id_col=id_col, **options)
    score = lambda: lambda texts: [[float(min(1.0, max(0.0, s)))] for s in model.score(np.array([statistics(t) for t in texts]))] if texts else []
    return with_vector(docs, text, score).select("row", F.col("vector")[0].alias("score"))


def op9_quality(spark, sf_dir):
    """All ``documents``, learned from ``labels.quality`` outside the fold crc32 mod 3 = 1."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
