"""Two-pass external shuffle into shards.

First pass: a seeded hash scatters the records uniformly into buckets that fit a task's memory. Second
pass: each bucket is put into a canonical order and Fisher-Yates shuffled with a seed of its own. One
bucket after the other is then a uniformly shuffled order of all records, which is cut into shards of
equal row counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import blocks_for, raw, row_hash, unused

BUCKET_BYTES = 16 << 20


def record_size(text_col: str = "text"):
    """Bytes of the text and one for its end; null counts as no bytes."""
    return F.coalesce(F.octet_length(raw(text_col)), F.lit(0)).cast("bigint") + 1


def scattered(rows: DataFrame, buckets: int, seed: int, bucket: str, mark: str) -> DataFrame:
    """First pass: ``rows`` with the hash of each row and the bucket it goes to."""
    placed = rows.withColumn(mark, row_hash(rows, seed))
    return placed.withColumn(bucket, F.pmod(F.col(mark), F.lit(buckets)).cast("int"))


def external_shuffle(
    docs: DataFrame,
    shards: int,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs``, shuffled, with ``shard`` (from 0) and ``slot`` (gapless from 0 in its shard).

    Shard sizes differ by one row at most. The same rows, seed and ``bucket_bytes`` give the same order
    on every run, also when a lost task is run again. Rows are scattered by a hash of all their columns, so
    rows that share an id, or all but one column, spread like any others; only rows equal in every column
    meet in one bucket, where their order makes no difference. Nulls are values like others. Columns named
    ``shard`` or ``slot`` are replaced, others keep their names whatever these are. An empty table gives no rows.
    """
    total = docs.agg(F.sum(record_size(text_col))).first()[0]
    buckets = blocks_for(total, bucket_bytes)
    rows = docs.drop("shard", "slot")
    bucket, mark, start, size = unused(rows, "bucket", "mark", "start", "rows")
    placed = scattered(rows, buckets, seed, bucket, mark)
    counts = placed.groupBy(bucket).agg(F.count(F.lit(1)).alias(size))
    # A row per bucket, that is one for each bucket_bytes of input.
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        bucket,
        F.coalesce(F.sum(size).over(before), F.lit(0)).alias(start),
        F.sum(size).over(every).alias(size),
    )
    kept = rows.columns
    out = T.StructType([placed.schema[c] for c in kept] + [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffle(key: tuple, records: pa.Table, offset: pa.Table) -> pa.Table:
        # Rows come from the shuffle in any order; a canonical one makes a repeated task agree with the first.
        order = pc.sort_indices(records, sort_keys=[(id_col, "ascending"), (text_col, "ascending"), (mark, "ascending")]).to_numpy().copy()
        np.random.Generator(np.random.PCG64([seed, key[0].as_py()])).shuffle(order)  # Fisher-Yates
        first_rank, total_rows = (offset[c][0].as_py() for c in (start, size))
        rank = first_rank + np.arange(records.num_rows, dtype=np.int64)
        shard = ((rank + 1) * shards - 1) // total_rows  # shard s holds ranks from total_rows * s // shards
        first = total_rows * shard // shards
        return (
            records.select(kept)
            .take(pa.array(order))
            .append_column("shard", pa.array(shard.astype(np.int32)))
            .append_column("slot", pa.array(rank - first))
        )

    return placed.groupBy(bucket).cogroup(offsets.groupBy(bucket)).applyInArrow(shuffle, out)


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Write the shuffled records as Parquet, a folder per shard; a task writes its bucket in shuffled order.

    Buckets follow one another in the shards, so a bucket touches two shards at most.
    """
    external_shuffle(docs, shards, **options).write.partitionBy("shard").parquet(path)
