"""Partition layout of inputs and of joins on skewed keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TRACKED = 1 << 19


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Deal rows out over ``partitions`` by a hash of the key, where the caller asks for it.

    For a source of one or a few row groups, which would leave the other cores idle. The default leaves
    the layout of the source alone. A rerun places the rows alike.
    """
    return df if partitions is None else df.repartition(partitions, F.xxhash64(key))


def frequent_keys(rows: DataFrame, key: str, tasks: int) -> dict[int, float]:
    """Share of the rows by hash of the key, for keys with more than half of what one of ``tasks`` even tasks gets.

    One aggregate with a mergeable summary of frequent items. What it loses track of is a key of less than a
    tenth of that. Shares add up to one, so there are at most ``2 * tasks`` such keys whatever the table's size.
    """
    tracked = min(MOST_TRACKED, 1 << max(10, math.ceil(math.log2(64 * tasks))))
    summary = f"approx_top_k(xxhash64({key}), {min(2 * tasks, tracked // 2)}, {tracked})"
    found = rows.agg(F.expr(summary).alias("items"), F.count(F.lit(1)).alias("n")).first()
    return {i["item"]: i["count"] / found["n"] for i in found["items"] or [] if i["count"] * 2 * tasks > found["n"]}


def join_frequent(
    large: DataFrame, small: DataFrame, key: str, salt_on: str, how: str = "inner", measured: DataFrame | None = None
) -> DataFrame:
    """Join on ``key``, a column name, so that a frequent key's rows go to as many tasks as they would fill.

    Frequent keys are found by ``frequent_keys`` in ``measured``, by default the large side itself; any frame
    with about the same shares will do, because they decide the layout only. A key with a share s of the
    rows is cut into 2 * s * tasks parts by a hash of ``salt_on``, so none of them holds more than half of an
    even task. The small side, with a row per key, repeats those keys once per part. All other keys join as
    they are, and where there is no frequent key this is a plain join.
    """
    tasks = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts: dict[int, list[int]] = {}  # number of parts, rounded up to a power of two -> hashes of the keys
    for item, share in frequent_keys(large if measured is None else measured, key, tasks).items():
        parts.setdefault(1 << math.ceil(math.log2(2 * share * tasks)), []).append(item)
    if not parts:
        return large.join(small, key, how)
    many = F.lit(1)
    for n, items in sorted(parts.items()):
        many = F.when(F.xxhash64(key).isin(items), n).otherwise(many)
    salted = large.withColumn("_part", F.pmod(F.xxhash64(salt_on), many).cast("int"))
    repeated = small.withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1)))
    return salted.join(repeated, [key, "_part"], how).drop("_part")
