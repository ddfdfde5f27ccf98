"""First-come acceptance of stories that keep arriving.

What has been accepted lies in ``accepted_dir/batch_id=N``. Beside it, under ``_keys``, the accepted titles and
prefixes lie in buckets by their hash, as many buckets as keep ``bucket_rows`` keys or so in each. A batch reads the
buckets of its own keys and no others, so what it reads follows the batch, not the history. When the history
has outgrown its buckets they are laid out anew from the accepted rows, with twice as many or more; a key
is rewritten about once on average however long the stream runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textlab.operators.intake import accept_keys, candidate_keys
from textlab.plans.durable import path_exists

#: Keys in a bucket, of 33 bytes or so each.
BUCKET_ROWS = 1 << 16
#: Buckets that are named one by one in a read; a batch with more of them reads all.
NAMED_BUCKETS = 4096

INDEX = "side string, key binary, bucket int, batch bigint"


def bucketed_keys(keys: DataFrame, buckets: int) -> DataFrame:
    """side, key, bucket: the title and the prefix of every row."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"_{side}").alias("key")) for side in ("title", "prefix")])
    return keys.select(F.inline(sides)).withColumn("bucket", F.pmod(F.xxhash64("side", "key"), F.lit(buckets)).cast("int"))


def buckets_for(rows: int, bucket_rows: int) -> int:
    """The power of two that leaves at most ``bucket_rows`` keys a bucket on average, two keys a row."""
    return 1 << max(0, (-(-2 * rows // bucket_rows) - 1).bit_length())


def accepted_rows(spark: SparkSession, accepted_dir: str, batch_id: int) -> int:
    """Rows accepted before ``batch_id``: a stored number, or counted where there is none."""
    total = f"{accepted_dir}/_totals/batch={batch_id - 1}"
    if path_exists(spark, total + "/_SUCCESS"):
        return spark.read.parquet(total).first()["total"]
    if not path_exists(spark, accepted_dir):
        return 0
    return spark.read.schema("batch_id bigint").parquet(accepted_dir).where(F.col("batch_id") < batch_id).count()


def earlier_keys(keys: DataFrame, batch_id: int, accepted_dir: str, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame | None, str, int]:
    """Accepted keys of earlier batches in the buckets of ``keys``, the folder of the buckets and their number."""
    spark = keys.sparkSession
    rows = accepted_rows(spark, accepted_dir, batch_id)
    buckets = buckets_for(rows, bucket_rows)
    root = f"{accepted_dir}/_keys/buckets={buckets}"
    if not rows:
        return None, root, buckets
    if not path_exists(spark, root + "/_SUCCESS"):
        schema = T.StructType([*keys.schema.fields, T.StructField("batch_id", T.LongType())])
        history = spark.read.schema(schema).parquet(accepted_dir).where(F.col("batch_id") < batch_id)
        laid = bucketed_keys(history, buckets).withColumn("batch", F.lit(batch_id - 1))
        laid.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket", "batch").parquet(root)
    wanted = bucketed_keys(keys, buckets).select("bucket").distinct().limit(NAMED_BUCKETS + 1).collect()
    paths = [root]
    if len(wanted) <= NAMED_BUCKETS:
        paths = [p for p in (f"{root}/bucket={w.bucket}" for w in wanted) if path_exists(spark, p)]
    if not paths:
        return None, root, buckets
    read = spark.read.schema(INDEX).option("basePath", root).parquet(*paths)
    return read.where(F.col("batch") < batch_id), root, buckets


def accept_batch(
    batch: DataFrame, batch_id: int, accepted_dir: str, order: str, title: Column, text: Column,
    prefix: int = 100, min_len: int = 200, bucket_rows: int = BUCKET_ROWS,
) -> None:
    """Accept the new rows of one batch and store their keys under ``batch_id``.

    Reads only what earlier batches stored and overwrites its own folders, so a batch that is run again after
    a failure gives the same result.
    """
    spark = batch.sparkSession
    keys = candidate_keys(batch, order, title, text, prefix, min_len)
    earlier, root, buckets = earlier_keys(keys, batch_id, accepted_dir, bucket_rows)
    if earlier is not None:
        for side in ("title", "prefix"):
            known = earlier.where(F.col("side") == side).select(F.col("key").alias(f"_{side}"))
            keys = keys.join(known, f"_{side}", "left_anti")
    own = f"{accepted_dir}/batch_id={batch_id}"
    accept_keys(keys, order, "_title", "_prefix").select(order, "_title", "_prefix").write.mode("overwrite").parquet(own)
    taken = spark.read.parquet(own)
    (
        bucketed_keys(taken, buckets).withColumn("batch", F.lit(batch_id)).repartition("bucket")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(root)
    )
    total = taken.agg((F.count(F.lit(1)) + accepted_rows(spark, accepted_dir, batch_id)).alias("total"))
    total.write.mode("overwrite").parquet(f"{accepted_dir}/_totals/batch={batch_id}")


def accept_unique_stream(
    stream: DataFrame, accepted_dir: str, checkpoint_dir: str, order: str, title: Column, text: Column,
    prefix: int = 100, min_len: int = 200, bucket_rows: int = BUCKET_ROWS, **trigger,
) -> StreamingQuery:
    """Run ``accept_batch`` on every micro-batch.

    Equals ``accept_unique`` when batches arrive in order; else a row of an earlier batch comes first, whatever its order value.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        accept_batch(batch, batch_id, accepted_dir, order, title, text, prefix, min_len, bucket_rows)

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
