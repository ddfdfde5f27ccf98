"""Centroid clustering with heap-ordered bounds.

Lloyd's rounds give the same centroids as ever, but a vector is compared with them only when it has to be. A
scan of a vector leaves the gap between its nearest and its second nearest centroid. The gap shrinks at most
by what the own centroid has moved and what the farthest-moving other one has, and that sum is the same for
all vectors of a cluster. So each cluster keeps a heap of gaps, offset by the drift accumulated when they were
made: a round pops those that the accumulated drift has reached and scans these vectors again, nothing else.

Vectors lie in blocks, cut from the partitions they are read in; each block has a heap per cluster, and every
round is one narrow stage over the blocks, without a shuffle. What moves are the sums of the vectors that
changed their cluster.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import release
from textlab.plans.durable import scratch_path

BLOCK_ROWS = 8_192
EXACT = 1 << 53
SLACK = 1e-12  # wider than what rounding does to roots and sums of a few terms
LARGEST = 1 << 27  # of integers whose squared distances, 64 terms, fit a long

BLOCK = "ids array<bigint>, vectors binary, heaps binary, sizes binary, moved array<bigint>"


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector``: floor(scale * x) of vectors with ``dims`` components, none null or not finite."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / scale))
    whole = F.transform(v, lambda x: F.floor(scale * x.cast("double")).cast("int"))
    return vectors.where((F.size(v) == dims) & fine).select(F.col(id_col).cast("bigint").alias("id"), whole.alias("vector"))


def first_centroids(rows: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The vectors of the ``k`` ids with the smallest sha256 of ``seed:id``; equal ids go by their vectors."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    chosen = rows.select(hashed.alias("h"), "vector").orderBy(F.asc_nulls_last("h"), "vector").limit(k).collect()
    return np.array([r["vector"] for r in chosen], np.int64).reshape(len(chosen), dims)


def squared_distances(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact whole numbers: by floating point where it holds every sum exactly, else by longs."""
    largest = max(int(np.abs(values).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * values.shape[1] * largest * largest < EXACT else np.int64
    x, c = values.astype(kind), centroids.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def scan(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, the smaller number of equals, and a safe lower limit of its gap."""
    squared = squared_distances(values, centroids)
    nearest = squared.argmin(axis=1)
    if squared.shape[1] == 1:
        return nearest, np.full(len(values), math.inf)
    two = np.sqrt(np.partition(squared, 1, axis=1)[:, :2].astype(np.float64))
    return nearest, two[:, 1] * (1 - SLACK) - two[:, 0] * (1 + SLACK)


def _small(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest kind that holds them."""
    largest = int(np.abs(values).max(initial=0))
    return values.astype(np.int16 if largest < 1 << 15 else np.int32)


class Block:
    """Vectors of a block and, for each cluster, the heap of (gap + drift at the time, place of the vector)."""

    def __init__(self, ids: pa.Array, values: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.ids, self.values, self.heaps = ids, values, heaps

    @staticmethod
    def read(row: pa.RecordBatch, at: int, dims: int) -> Block:
        ids = row.column(0).slice(at, 1).flatten()
        packed = row.column(1)[at].as_buffer()
        kind = np.int16 if packed.size == 2 * dims * len(ids) else np.int32
        values = np.frombuffer(packed, kind).reshape(-1, dims)
        sizes = np.frombuffer(row.column(3)[at].as_buffer(), "<i4").tolist()
        heap = np.frombuffer(row.column(2)[at].as_buffer(), [("key", "<f8"), ("place", "<i4")])
        keys, places = heap["key"].tolist(), heap["place"].tolist()
        heaps, start = [], 0
        for size in sizes:
            heaps.append(list(zip(keys[start : start + size], places[start : start + size])))
            start += size
        return Block(ids, values, heaps)

    def renew(self, centroids: np.ndarray, drift: list[float]) -> np.ndarray:
        """Pop and scan the vectors whose gap the drift has reached. What the clusters gain: number and sum."""
        popped, was = [], []
        for cluster, heap in enumerate(self.heaps):
            limit = drift[cluster] * (1 + SLACK)
            while heap and heap[0][0] <= limit:
                popped.append(heapq.heappop(heap)[1])
                was.append(cluster)
        moved = np.zeros((len(centroids), 1 + self.values.shape[1]), np.int64)
        if popped:
            values = self.values[popped].astype(np.int64)
            now, gap = scan(values, centroids)
            offset = gap + np.array(drift)[now]
            for cluster, key, place in zip(now.tolist(), offset.tolist(), popped):
                heapq.heappush(self.heaps[cluster], (key, place))
            before = np.array(was)
            changed = now != before
            counted = np.concatenate((np.ones((len(values), 1), np.int64), values), axis=1)[changed]
            np.add.at(moved, now[changed], counted)
            np.subtract.at(moved, before[changed], counted)
        return moved

    def assigned(self) -> np.ndarray:
        out = np.zeros(len(self.values), np.int32)
        for cluster, heap in enumerate(self.heaps):
            out[[place for _, place in heap]] = cluster
        return out

    def row(self, moved: np.ndarray) -> list:
        pairs = [pair for heap in self.heaps for pair in heap]
        heaps = np.array(pairs, [("key", "<f8"), ("place", "<i4")]).tobytes()
        return [self.ids, self.values.tobytes(), heaps, np.array([len(h) for h in self.heaps], "<i4").tobytes(), moved.ravel()]


def _batch(row: list) -> pa.RecordBatch:
    ids, vectors, heaps, sizes, moved = row
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [one(ids), pa.array([vectors], pa.binary()), pa.array([heaps], pa.binary()), pa.array([sizes], pa.binary()), one(pa.array(moved, pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "vectors", "heaps", "sizes", "moved"])


def _first_round(rows: DataFrame, centroids: np.ndarray, block_rows: int) -> DataFrame:
    """Cut the partitions into blocks and scan every vector once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = centroids.shape[1]
        for batch in _regrouped(batches, block_rows):
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            now, gap = scan(values, centroids)
            heaps: list[list[tuple[float, int]]] = [[] for _ in centroids]
            for cluster, key, place in zip(now.tolist(), gap.tolist(), range(len(values))):
                heaps[cluster].append((key, place))
            for heap in heaps:
                heapq.heapify(heap)
            moved = np.zeros((len(centroids), 1 + dims), np.int64)
            np.add.at(moved, now, np.concatenate((np.ones((len(values), 1), np.int64), values), axis=1))
            yield _batch(Block(batch.column(0), _small(values), heaps).row(moved))
        release()

    return rows.mapInArrow(work, BLOCK)


def _regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows; the last one of a partition holds the rest."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            wanted = rows - sum(b.num_rows for b in held)
            held.append(batch.slice(0, wanted))
            batch = batch.slice(wanted)
            if sum(b.num_rows for b in held) == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _next_round(blocks: DataFrame, centroids: np.ndarray, drift: list[float]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block.read(batch, at, centroids.shape[1])
                yield _batch(block.row(block.renew(centroids, drift)))
        release()

    return blocks.mapInArrow(work, BLOCK)


def _gained(blocks: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Number and sum that each cluster has gained, over all blocks: clusters x (dims + 1) numbers."""
    parts = blocks.select(F.posexplode("moved").alias("at", "value"))
    sums = parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    out = np.zeros(shape[0] * shape[1], object)
    for r in sums:
        out[r["at"]] = int(r["value"])
    return out.reshape(shape)


def _averages(sums: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / number); a centroid without vectors stays."""
    return np.array([[s // row[0] for s in row[1:]] if row[0] else list(old) for row, old in zip(sums, centroids)], np.int64)


def _drift(before: np.ndarray, now: np.ndarray) -> list[float]:
    """By how much a gap in each cluster can shrink: the own centroid's way and the longest of the others."""
    way = [math.sqrt(int(((a - b).astype(object) ** 2).sum())) * (1 + SLACK) for a, b in zip(before, now)]
    return [w + max([o for j, o in enumerate(way) if j != i], default=0.0) for i, w in enumerate(way)]


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    seed: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, np.ndarray]:
    """id, cluster, distance (squared, to the final centroid) of every vector that takes part; and the centroids.

    Components become floor(scale * x). Vectors that are null, have another number of components, or hold a null,
    a not finite or a very large one (``LARGEST``, whose squares no long holds) take no part. Each row counts, also
    where it repeats an id or a vector; equally near centroids go by the smaller number. Rows without id are
    assigned, and start a centroid only where ids run short. With fewer rows than ``k`` there are as many
    centroids as rows; an empty table gives no rows and no centroids.

    A round's blocks replace those of the round before on the executors' disks; a lost one is made again from
    the table by the same narrow steps. The driver sees ``k * (dims + 1)`` numbers a round.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, dims, scale, id_col, vector_col)
    centroids = first_centroids(rows, k, dims, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{id_col} bigint, cluster int, distance bigint"), centroids
    blocks = _first_round(rows, centroids, block_rows).persist(StorageLevel.DISK_ONLY)
    sums = _gained(blocks, (len(centroids), 1 + dims))
    drift = [0.0] * len(centroids)
    for _ in range(rounds):
        renewed = _averages(sums, centroids)
        drift = [a + b for a, b in zip(drift, _drift(centroids, renewed))]
        centroids = renewed
        following = _next_round(blocks, centroids, drift).persist(StorageLevel.DISK_ONLY)
        sums = sums + _gained(following, sums.shape)
        blocks.unpersist()
        blocks = following

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block.read(batch, at, dims)
                now = block.assigned()
                values = block.values.astype(np.int64)
                own = ((values - centroids[now]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([block.ids, pa.array(now, pa.int32()), pa.array(own, pa.int64())], names=[id_col, "cluster", "distance"])

    stored = scratch_path(spark, "clusters")
    blocks.mapInArrow(distances, f"{id_col} bigint, cluster int, distance bigint").write.parquet(stored)
    blocks.unpersist()
    return spark.read.parquet(stored), centroids


def digest(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster``'s rows with the inertia of their cluster and of all, and the digest of their centroid.

    An inertia beyond a long is null.
    """
    spark = assigned.sparkSession
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(total.alias("s")).collect()}  # a row per centroid
    short = lambda n: n if n < 1 << 63 else None
    everything = short(sum(inertia.values()))
    facts = [
        (c, short(inertia.get(c, 0)), everything, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
        for c, v in enumerate(centroids.tolist())
    ]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster")  # k rows
