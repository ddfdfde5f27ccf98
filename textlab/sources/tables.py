"""CSV, Parquet and instruction-record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELED_SCHEMA = "text string, score int"

CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_labeled_csv(spark: SparkSession, path: str, schema: str = LABELED_SCHEMA) -> DataFrame:
    """CSV with header and quoted multi-line text, declared schema; an empty table is an error.

    A file whose texts span lines cannot be split, so it is read by one task.
    """
    df = spark.read.schema(schema).options(mode="FAILFAST", enforceSchema=False, **CSV_OPTIONS).csv(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write in parallel, one file per partition."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv":
        keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        df.write.mode(mode).options(header=True, quote='"', escape='"', **keep_spaces).csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def instruction_records(df: DataFrame, instruction: Column, output: Column, split: Column | None = None) -> DataFrame:
    """``instruction, input, output`` records, input always empty, with their ``split``."""
    return df.select(
        (F.lit("train") if split is None else split).alias("split"),
        instruction.alias("instruction"),
        F.lit("").alias("input"),
        output.alias("output"),
    )


def write_instruction_json(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one folder per split."""
    records.write.mode(mode).partitionBy("split").json(path)
