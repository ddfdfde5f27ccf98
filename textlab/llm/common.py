"""Helpers the training-data operators share."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw(text: Column | str) -> Column:
    """The UTF-8 bytes of a text; null stays null."""
    return (F.col(text) if isinstance(text, str) else text).cast("binary")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has already, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def row_hash(df: DataFrame, seed: int) -> Column:
    """Hash of all columns of a row."""
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(F.lit(seed), *columns)


def release() -> None:
    """Hand memory that this Python worker has freed back to the system, before it goes on or idles."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def blocks_for(amount: int | None, per_block: int) -> int:
    """How many blocks of at most about ``per_block`` hold ``amount``; at least one."""
    return max(1, math.ceil((amount or 0) / per_block))


def with_group_stats(
    df: DataFrame,
    keys: list[str],
    stats: dict[str, tuple[Column, Callable[[str], Column]]],
    salt_on: Column,
    salts: int = 64,
) -> DataFrame:
    """Add to every row what its whole group sums up to, without gathering a group in one task.

    ``stats`` maps a new column to (aggregate of rows, function that combines a column of partial
    aggregates). Rows are summed per (keys, salt), the sums per keys, and the total goes back to each
    salt that occurs, so a group with a third of all rows is spread over ``salts`` pairs and the
    table of totals never has more rows than the partial sums. ``keys`` must not be null.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    partial = salted.groupBy(*keys, "__salt").agg(*[c.alias(f"__{n}") for n, (c, _) in stats.items()])
    total = partial.groupBy(*keys).agg(
        *[merge(f"__{n}").alias(n) for n, (_, merge) in stats.items()], F.collect_list("__salt").alias("__salts")
    )
    spread = total.withColumn("__salt", F.explode("__salts")).drop("__salts")
    return salted.join(spread, [*keys, "__salt"]).drop("__salt")
