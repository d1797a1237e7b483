"""A corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents; a stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.exact import exact_duplicates
from pulsegrid.llm.minhash import near_duplicates
from pulsegrid.llm.packing import pack
from pulsegrid.llm.quality import classify
from pulsegrid.llm.queries import packing_items, table
from pulsegrid.llm.screen import screened
from pulsegrid.llm.suffixes import without_repeats
from pulsegrid.runtime import Scratch


def only(spark: SparkSession, docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, text_hash, kept) keeps; equal rows go or stay together."""
    gone = Scratch(spark, "gone").write(decided.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "gone")
    maybe, rest = screened(docs, (F.col("doc_id"), F.xxhash64("text")), gone, (F.col("_id"), F.col("_hash")))
    return maybe.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_anti").union(rest)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts: of the highest grade with a probability of at least one half.

    A null or empty text has no features and is judged by the thresholds alone; rows are
    judged one by one, so a missing or repeated doc_id changes nothing. Without usable labels
    every document stays; an empty table gives an empty result.
    """
    scored = classify(spark, docs, table(spark, sf_dir, "labels"))
    return scored.filter("kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of equal texts.

    Null and empty texts are equal; a row without doc_id stays only if its group has no id.
    """
    return only(spark, docs, exact_duplicates(spark, docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of near copies.

    A text without words stays; a row without doc_id stays only if its component has no id.
    """
    return only(spark, docs, near_duplicates(spark, docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier one holds; n_chars follows the text."""
    cut = without_repeats(spark, docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of at most 2048 tokens: one row for each part of each document."""
    return pack(spark, packing_items(docs))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("minhash near-dedup", near),
    ("suffix-array dedup", passages),
    ("best-fit packing", packed),
]

#: SQL expresses neither the classifier nor near copies; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; an empty table gives no bins."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
