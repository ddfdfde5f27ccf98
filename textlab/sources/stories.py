"""The annotated story corpus: one JSON object keyed by story id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORY_JSON = """
map<string, struct<
  StoryID: bigint, Title: string, Text: string,
  HolisticData: struct<num_annotators: int, scores: map<string, double>, consensus_score: double>,
  IncrementalData: struct<sentences: array<string>, num_annotators: int, scores: map<string, double>,
    reasons: map<string, map<string, array<int>>>, consensus_score: double>>>
"""

# Columns every story DataFrame has.
STORY_COLUMNS = ("story_id", "title", "text", "holistic", "incremental")


def read_story_json(spark: SparkSession, path: str, on_missing: str = "fail", lines: bool = False) -> DataFrame:
    """One row per story. ``on_missing`` says what a story without a needed key does: fail or skip.

    A file that is one JSON object is one record and so one task. ``lines`` reads an object per line, as
    ``write_story_json`` makes them; such files are split.
    """
    if on_missing not in ("fail", "skip"):
        raise ValueError(f"unknown on_missing {on_missing!r}")
    raw = spark.read.text(path, wholetext=not lines)
    parsed = raw.select(F.from_json("value", STORY_JSON, {"mode": "FAILFAST"}).alias("stories"))
    stories = parsed.select(F.explode("stories").alias("story_key", "s")).select(
        "story_key",
        F.col("s.StoryID").alias("story_id"),
        F.col("s.Title").alias("title"),
        F.col("s.Text").alias("text"),
        F.col("s.HolisticData").alias("holistic"),
        F.col("s.IncrementalData").alias("incremental"),
    )
    complete = (
        F.col("story_id").isNotNull()
        & F.col("title").isNotNull()
        & F.col("text").isNotNull()
        & F.col("holistic.consensus_score").isNotNull()
        & F.col("incremental.sentences").isNotNull()
        & F.col("incremental.reasons").isNotNull()
        & F.col("incremental.consensus_score").isNotNull()
    )
    if on_missing == "skip":
        return stories.where(complete).select(*STORY_COLUMNS)
    checked = F.when(complete, F.col("story_id")).otherwise(
        F.raise_error(F.concat(F.lit("story lacks a needed key: "), F.col("story_key")))
    )
    return stories.withColumn("story_id", checked).select(*STORY_COLUMNS)


def write_story_json(stories: DataFrame, path: str) -> None:
    """Write (key, story) rows as JSON objects keyed by story id, one object per line."""
    stories.select(F.to_json(F.create_map("key", "story")).alias("value")).write.mode("overwrite").text(path)
