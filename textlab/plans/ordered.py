"""Exact ranks and running values without one window per whole group.

Rows are put into buckets; windows run inside a bucket, and what earlier buckets
contribute comes from a small table with one row per bucket. Ranks take about the
root of the rows as buckets, running values even ranges of a bounded number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_ROWS = 1 << 15
MOST_RANGES = 1024


def join_same(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which any may be null; null meets null."""
    renamed = other.select([F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in other.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(renamed, on).drop(*[f"_key_{k}" for k in keys])


def seeded_hash(seed: int | str, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("(null)"))))


def class_rank(
    df: DataFrame,
    keys: list[str],
    id_col: str,
    seed: int | str = 42,
    hex_digits: int | None = None,
    per_class: DataFrame | None = None,
) -> DataFrame:
    """Add ``rank`` (1..n inside a class, by seeded hash) and ``class_rows`` (n).

    The class is cut into 16**hex_digits even buckets by the head of the hash,
    so the sort of one class is spread over that many groups; by default about the root of the
    number of rows, so that buckets and the table of their sizes grow alike. Offsets come from
    a table of at most classes x buckets rows. Columns of ``per_class`` (a row
    per class) are added to that small table, so they reach the rows with it and
    the rows are never shuffled by class alone.
    """
    if hex_digits is None:
        hex_digits = max(1, math.ceil(math.log(max(1, df.count()), 16) / 2))
    hashed = df.withColumn("_h", seeded_hash(seed, id_col)).withColumn(
        "_b", F.substring("_h", 1, hex_digits)
    )
    in_class = W.partitionBy(*[F.col(k) for k in keys]) if keys else W.partitionBy(F.lit(0))
    sizes = hashed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *keys,
        "_b",
        F.coalesce(
            F.sum("_n").over(in_class.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_n").over(in_class).alias("class_rows"),
    )
    if per_class is not None:
        offsets = join_same(offsets, per_class, keys)
    in_bucket = W.partitionBy(*[F.col(k) for k in keys], "_b").orderBy("_h", id_col)
    return (
        join_same(hashed.withColumn("_r", F.row_number().over(in_bucket)), offsets, [*keys, "_b"])
        .withColumn("rank", F.col("_before") + F.col("_r"))
        .drop("_h", "_b", "_r", "_before")
    )


def _upper(position: Column, splits: Column, ranges: int) -> Column:
    """How many of the ascending ``splits`` (fewer than ``ranges``) are not above ``position``, by halving."""
    halves = F.array(*[F.lit(2**i) for i in range((ranges - 1).bit_length() - 1, -1, -1)])
    return F.aggregate(
        halves, F.lit(0), lambda at, step: F.when(F.get(splits, at + step - 1) <= position, at + step).otherwise(at)
    )


def _quantiles(position: Column, ranges: int) -> Column:
    steps = F.expr("array(" + ", ".join(f"{i / ranges}D" for i in range(1, ranges)) + ")")
    return F.percentile_approx(position, steps, F.lit(20 * ranges))


def with_order_bucket(df: DataFrame, order: str, bucket_rows: int = BUCKET_ROWS, most: int = MOST_RANGES) -> DataFrame:
    """Rows with the range of ``order`` they fall into, so that a range of distinct values holds about
    ``bucket_rows`` rows (half as many again at most) whatever the size of the table and the spacing of the values.

    The split points are quantiles of the whole table, as many as its measured rows ask for. Up to ``most``
    ranges are one level, the column ``_a``; beyond, each of about the root of the number is cut again by
    quantiles of its own, ``_b``. A table of one bucket gets no column. ``running`` and ``previous_value`` go
    by the columns that are there.
    """
    buckets = math.ceil(df.count() / bucket_rows)
    if buckets <= 1:
        return df
    position = F.col(order).cast("double")
    ranges = buckets if buckets <= most else math.ceil(math.sqrt(buckets))
    splits = df.select(_quantiles(position, ranges).alias("s")).scalar()
    cut = df.withColumn("_splits", splits).withColumn("_a", _upper(position, F.col("_splits"), ranges)).drop("_splits")
    if ranges == buckets:
        return cut
    inner = math.ceil(buckets / ranges)
    own = cut.groupBy("_a").agg(_quantiles(position, inner).alias("_splits"))
    return cut.join(own, "_a").withColumn("_b", _upper(position, F.col("_splits"), inner)).drop("_splits")


def _levels(df: DataFrame) -> list[str]:
    return [c for c in ("_a", "_b") if c in df.columns]


def _partition(columns: list[str]) -> list[Column]:
    return [F.col(c) for c in columns] or [F.lit(0)]


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum`` / ``max`` columns per group over the rows of ``with_order_bucket``.

    ``values`` maps the new column to (function, input). ``inclusive=False``
    leaves the current row out. Windows run over the rows of a bucket, over the buckets of a range, and over
    the ranges of a group.
    """
    functions = {"sum": F.sum, "max": F.max}
    levels = _levels(df)

    def joined(f: str, a: Column, b: Column) -> Column:
        return F.greatest(a, b) if f == "max" else F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))

    carried = None
    for depth, level in enumerate(levels):
        above, own = [*keys, *levels[:depth]], [*keys, *levels[: depth + 1]]
        totals = df.groupBy(*own).agg(*[functions[f](c).alias(f"_{name}") for name, (f, c) in values.items()])
        earlier = W.partitionBy(*_partition(above)).orderBy(level).rowsBetween(W.unboundedPreceding, -1)
        part = totals.select(*own, *[functions[f](f"_{name}").over(earlier).alias(f"_c_{name}") for name, (f, _) in values.items()])
        if carried is not None:
            before = carried.select(*above, *[F.col(f"_c_{name}").alias(f"_d_{name}") for name in values])
            part = join_same(part, before, above).select(
                *own, *[joined(f, F.col(f"_c_{name}"), F.col(f"_d_{name}")).alias(f"_c_{name}") for name, (f, _) in values.items()]
            )
        carried = part
    inside = (
        W.partitionBy(*_partition([*keys, *levels]))
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    )
    out = df
    for name, (f, c) in values.items():
        out = out.withColumn(f"_i_{name}", functions[f](c).over(inside))
    if carried is not None:
        out = join_same(out, carried, [*keys, *levels])
    for name, (f, _) in values.items():
        carry = F.lit(None) if carried is None else F.col(f"_c_{name}")
        whole = F.col(f"_i_{name}") if carried is None and f == "max" else joined(f, F.col(f"_i_{name}"), carry)
        out = out.withColumn(name, whole).drop(f"_i_{name}", f"_c_{name}")
    return out


def previous_value(
    df: DataFrame, keys: list[str], order: str, value: str, name: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``lag(value)`` per group by a numeric ``order`` that is unique in the group.

    The first row of a bucket takes the last value of the bucket before, and the first of a range that of the
    range before; see ``with_order_bucket`` for how many rows a bucket holds.
    """
    bucketed = with_order_bucket(df, order, bucket_rows)
    levels = _levels(bucketed)
    held = F.struct(F.col(value).alias("v"))  # tells a null value from no row
    carried = None
    for depth, level in enumerate(levels):
        above, own = [*keys, *levels[:depth]], [*keys, *levels[: depth + 1]]
        last = bucketed.groupBy(*own).agg(F.max_by(held, order).alias("_last"))
        part = last.select(*own, F.lag("_last").over(W.partitionBy(*_partition(above)).orderBy(level)).alias("_carry"))
        if carried is not None:
            before = carried.select(*above, F.col("_carry").alias("_before"))
            part = join_same(part, before, above).select(*own, F.coalesce("_carry", "_before").alias("_carry"))
        carried = part
    inside = W.partitionBy(*_partition([*keys, *levels])).orderBy(order)
    marked = bucketed.withColumn("_lag", F.lag(held).over(inside))
    if carried is None:
        return marked.withColumn(name, F.col("_lag.v")).drop("_lag")
    return (
        join_same(marked, carried, [*keys, *levels])
        .withColumn(name, F.coalesce("_lag", "_carry")["v"])
        .drop(*levels, "_lag", "_carry")
    )


def kth_smallest(values: DataFrame, column: str, k: int, accuracy: int = 10_000, few: int = 10_000) -> float:
    """The value with ``k`` others before it in ascending order, exactly; nulls do not count.

    A pass takes two values around the place from a mergeable sketch, counts what lies before, between and after
    them, and goes on in the part that holds the place: about 4 of ``accuracy`` rows. Passes grow with the
    logarithm of the rows, however the values are spread. ``few`` numbers at most reach the driver, and no task
    holds the distinct values.
    """
    x = F.col(column).cast("double")
    inside = values.where(x.isNotNull())
    n = inside.count()
    while n > few:
        around = [min(1.0, max(0.0, k / n + d / accuracy)) for d in (-2, 2)]
        a, b = inside.agg(F.percentile_approx(x, around, accuracy)).first()[0]
        part = F.when(x < a, 0).when(x == a, 1).when(x < b, 2).when(x == b, 3).otherwise(4).alias("part")
        counted = inside.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for row in sorted(counted.collect(), key=lambda r: r.part):
            if k < row.n:
                break
            k -= row.n
        if row.low == row.high:
            return row.low
        inside, n = values.where(x.between(row.low, row.high)), row.n
    return sorted(r[0] for r in inside.select(x).collect())[k]


def exact_quantile(values: DataFrame, column: str, q: float) -> float | None:
    """Quantile with linear interpolation between neighbours, from ``kth_smallest``; null without values."""
    x = F.col(column).cast("double")
    n = values.where(x.isNotNull()).count()
    if n == 0:
        return None
    at = q * (n - 1)
    lower = kth_smallest(values, column, int(at))
    up_to, beyond = values.agg(F.count(F.when(x <= lower, 1)), F.min(F.when(x > lower, x))).first()
    upper = lower if up_to > int(at) + 1 or beyond is None else beyond
    part = at - int(at)
    return lower * (1 - part) + upper * part
