"""A corpus made ready for training: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. What a stage returns is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm import mixing, packing, quality, simhash, toxicity
from barsmith.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under one half."""
    return toxicity.score_rows(docs, table(spark, sf_dir, "labels")).where("score < 0.5").select("row.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is one half or more."""
    return quality.score_rows(docs, table(spark, sf_dir, "labels")).where("score >= 0.5").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id.

    Two documents are linked if their sets of five-word shingles have a Jaccard likeness of 0.8 or more.
    A row is known by its id and its text's hash: different texts of one id, or without an id, are documents
    of their own; of rows that repeat both, one stays. A null id comes after all others.
    """
    classes = written(simhash.near_duplicates(docs, width=5, least=0.8), "near-classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = classes.groupBy("class").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_hash")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"), F.xxhash64("text").alias("h"))
    kept = rows.join(first, F.col("key").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left_semi")
    return kept.dropDuplicates(["key", "h"]).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.taken_rows(docs).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens; a document that the mix takes twice is packed twice."""
    return packing.digest(packing.pack(docs))


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("simhash", one_of_each), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Hashing, learning and tokenizing are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
