"""Exact dedup against a minimal perfect hash of the digests seen before.

Known digests are kept as an index: buckets of bounded size, each with a minimal perfect hash whose
slots hold the full digest, the winner's id and the number of rows. A new digest is looked up in its
bucket and compared byte by byte with the slot; equal means a repeat of something known, anything
else is not a member and forms a group of its own. Levels of the hash are bit arrays: a digest that
is alone at its place sets the bit, the others go on to the next level, and the slot is the rank of
the bit (Limasset et al. 2017).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import blocks_for, raw, unused
from textlab.plans.durable import scratch_path

DIGEST = 32
KEYS_PER_BUCKET = 100_000
SALTS = 64
NO_ID = -(2**63)  # stands for a null id, which is smaller than every other
GROUPS = "text_digest binary, keep_id bigint, group_size bigint"
INDEX = "bucket int, sizes array<bigint>, bits array<binary>, digests binary, winners binary, counts binary"


@F.arrow_udf(T.BinaryType())
def _folded_sha256(text: pa.Array) -> pa.Array:
    # bytes.lower() touches A-Z only.
    return pa.array([hashlib.sha256((t or b"").lower()).digest() for t in text.to_pylist()], pa.binary())


def folded_digest(text: Column | str) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return _folded_sha256(raw(text))


def _mix(words: np.ndarray, level: int) -> np.ndarray:
    x = words[:, 1] ^ (words[:, 2] + np.uint64((level * 0x9E3779B97F4A7C15) % 2**64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct digests: levels of bits, slot = rank of the bit."""

    def __init__(self, sizes: list[int], bits: list[bytes]):
        self.levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(sizes, bits)]
        self.ranks, before = [], 0
        for level in self.levels:
            ones = np.cumsum(level)
            self.ranks.append(before + ones - 1)
            before += int(ones[-1]) if len(ones) else 0

    @staticmethod
    def build(words: np.ndarray) -> PerfectHash:
        sizes, bits, rest, level = [], [], words, 0
        while len(rest):
            size = 2 * len(rest)
            at = (_mix(rest, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone).tobytes())
            rest, level = rest[~alone[at]], level + 1
        made = PerfectHash(sizes, bits)
        made.sizes, made.bits = sizes, bits
        return made

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of every digest; -1 where no level has its bit. A foreign digest may get any slot."""
        out, open_ = np.full(len(words), -1, np.int64), np.arange(len(words))
        for number, (level, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(open_):
                break
            at = (_mix(words[open_], number) % np.uint64(len(level))).astype(np.int64)
            hit = level[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out


def _columns(groups: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    joined = b"".join(groups["text_digest"].to_pylist())
    return (
        np.frombuffer(joined, f"S{DIGEST}") if joined else np.empty(0, f"S{DIGEST}"),
        np.frombuffer(joined, "<u8").reshape(-1, DIGEST // 8),
        groups["keep_id"].fill_null(NO_ID).to_numpy().astype(np.int64),
        groups["group_size"].to_numpy().astype(np.int64),
    )


def bucket_of(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


def digest_groups(rows: DataFrame, digest_col: str, id_col: str) -> DataFrame:
    """text_digest, keep_id (largest id), group_size of the rows; repeats combine before the shuffle."""
    return rows.groupBy(F.col(digest_col).alias("text_digest")).agg(
        F.max(id_col).cast("bigint").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket of the distinct digests in ``groups`` (``GROUPS``): its perfect hash and slots."""

    def build(key: tuple, group: pa.Table) -> pa.Table:
        _, words, winners, counts = _columns(group)
        made = PerfectHash.build(words)
        slot = made.slots(words)
        place = lambda values: values[np.argsort(slot)].tobytes()
        return pa.table(
            {
                "bucket": pa.array([key[0].as_py()], pa.int32()),
                "sizes": pa.array([made.sizes], pa.list_(pa.int64())),
                "bits": pa.array([made.bits], pa.list_(pa.binary())),
                "digests": pa.array([place(words)], pa.binary()),
                "winners": pa.array([place(winners)], pa.binary()),
                "counts": pa.array([place(counts)], pa.binary()),
            }
        )

    return groups.groupBy(bucket_of(F.col("text_digest"), buckets).alias("bucket")).applyInArrow(build, INDEX)


def look_up(index: DataFrame, arrived: DataFrame, buckets: int) -> DataFrame:
    """What is known after ``arrived`` (``GROUPS``) has met the index: ``GROUPS`` and ``known``, a row per digest.

    A member adds its rows to its slot and takes the larger id; the others stay as they came.
    """

    def merge(index_rows: pa.Table, new: pa.Table) -> Iterator[pa.Table]:
        digests, words, winners, counts = _columns(new)
        known = np.zeros(len(digests), bool)
        if index_rows.num_rows:
            entry = {n: index_rows[n][0].as_py() for n in index_rows.column_names}
            at = PerfectHash(entry["sizes"], entry["bits"]).slots(words)
            full = np.frombuffer(entry["digests"], "<u8").reshape(-1, DIGEST // 8)
            win, size = np.frombuffer(entry["winners"], "<i8").copy(), np.frombuffer(entry["counts"], "<i8").copy()
            known = (at >= 0) & (full[np.maximum(at, 0)] == words).all(axis=1)  # all 32 bytes
            slot = at[known]  # distinct digests, so every slot occurs once
            win[slot] = np.maximum(win[slot], winners[known])
            size[slot] += counts[known]
            yield _groups(entry["digests"], win, size, True)
        rest = ~known
        yield _groups(words[rest].tobytes(), winners[rest], counts[rest], False)

    def merged(index_rows: pa.Table, new: pa.Table) -> pa.Table:
        return pa.concat_tables(list(merge(index_rows, new)))

    return (
        index.groupBy("bucket")
        .cogroup(arrived.withColumn("bucket", bucket_of(F.col("text_digest"), buckets)).groupBy("bucket"))
        .applyInArrow(merged, GROUPS + ", known boolean")
    )


def _groups(digests: bytes, winners: np.ndarray, counts: np.ndarray, known: bool) -> pa.Table:
    n = len(winners)
    return pa.table(
        {
            "text_digest": pa.array([digests[i * DIGEST : (i + 1) * DIGEST] for i in range(n)], pa.binary()),
            "keep_id": pa.array(winners, pa.int64(), mask=winners == NO_ID),
            "group_size": pa.array(counts, pa.int64()),
            "known": pa.array(np.full(n, known), pa.bool_()),
        }
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    arrived: Column | None = None,
    keys_per_bucket: int = KEYS_PER_BUCKET,
) -> DataFrame:
    """All rows and columns of ``docs`` with text_digest, keep_id, group_size and kept.

    ``arrived`` says which rows came after the history was indexed; by default those in the upper half
    of the id range. The answer is the same for any such split. Texts are equal when identical after
    lower-casing A-Z; a null text is an empty one. Of equal texts the row with the largest id stays; a
    null id is smaller than any; of rows equal in text and id, one stays. Columns of ``docs`` that are
    named like a result are replaced. An empty table gives no rows.
    """
    rows = docs.drop("text_digest", "keep_id", "group_size", "kept").withColumn("text_digest", folded_digest(text_col))
    if arrived is None:
        ends = docs.agg(F.min(id_col).cast("double").alias("a"), F.max(id_col).cast("double").alias("b")).first()
        middle = ((ends["a"] or 0) + (ends["b"] or 0)) / 2
        arrived = F.coalesce(F.col(id_col) > F.lit(middle), F.lit(False))
    spark = docs.sparkSession
    salt_, new_, turn_ = unused(rows, "salt", "new", "turn")
    rows = rows.withColumn(salt_, F.pmod(F.xxhash64(F.lit("spread"), F.col(id_col)), F.lit(SALTS)).cast("int"))
    # Repeats combine before the shuffle; a large group is at most SALTS rows for each half here.
    path = scratch_path(spark, "digests")
    rows.groupBy("text_digest", salt_, arrived.alias(new_)).agg(
        F.max(id_col).cast("bigint").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    ).write.parquet(path)
    partial = spark.read.parquet(path)
    grouped = partial.groupBy("text_digest", new_).agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    history, new = (grouped.where(c).drop(new_) for c in (~F.col(new_), F.col(new_)))
    buckets = blocks_for(partial.count(), keys_per_bucket)
    index_path = scratch_path(spark, "digest-index")
    build_index(history, buckets).write.parquet(index_path)
    known = look_up(spark.read.parquet(index_path), new, buckets).drop("known")
    # Every (digest, salt) that occurs gets the answer of its digest, and the rows meet it there.
    answers = partial.select("text_digest", salt_).distinct().join(known, "text_digest")
    same_row = Window.partitionBy("text_digest", salt_, id_col).orderBy("text_digest")
    return (
        rows.join(answers, ["text_digest", salt_])
        .withColumn(turn_, F.row_number().over(same_row))
        .withColumn("kept", F.col("keep_id").eqNullSafe(F.col(id_col).cast("bigint")) & (F.col(turn_) == 1))
        .drop(salt_, turn_)
    )
