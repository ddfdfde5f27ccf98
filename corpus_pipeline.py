"""From raw documents to packed training sequences.

Each stage takes the documents that the one before has kept; all but the last return the columns of
``documents``. Null and empty texts go through every stage like any other document; an empty table stays
empty; additional columns travel along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlab.llm import exact, near, packing, quality, substrings
from textlab.llm.common import table
from textlab.llm.queries import word_bpe


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact.exact_dedup(docs).where("kept").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id."""
    return near.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start in a document with a smaller doc_id; ``n_chars`` follows the text.

    Texts without such a passage stay as they are, letter for letter; rows that lose every word stay with
    an empty text.
    """
    return substrings.cut_repeats(docs, n_chars="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, packed."""
    return packing.pack_documents(docs, word_bpe())


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("substring_dedup", without_repeats),
    ("packing", packed),
]

#: Importance resampling, weighted min-hashing and tokenizing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage wrote for itself goes when its result is written, and that when the next one's is. The last
    stage's input and own folders stay, as its rows are read from them.
    """
    from textlab.plans.durable import remove_path, scratch_path, scratch_run

    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_run(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
