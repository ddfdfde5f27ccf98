"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table projects a vector on Gaussian (2-stable) directions and cuts the line into cells of one width;
the cells of all directions make the bucket. A query visits the buckets around its own in the order of
their estimated success: the nearer the query lies to the borders that have to be crossed, the earlier. The
candidates of all tables are compared by their exact distance and merged.

Buckets are dealt into blocks; a bucket that is larger than a block is split over as many. A query is sent
once to each block that holds buckets it visits, and a block answers with its k best, so no pair of a query
and a candidate becomes a row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.common import blocks_for
from textlab.plans.durable import scratch_path

TABLES = 2
SAMPLE = 4_000  # vectors that width and number of probes are fitted on
SAMPLE_QUERIES = 100
TARGET_RECALL = 0.97
BLOCK_ROWS = 4_096
LARGE_BUCKETS = 1 << 18  # buckets beyond a block at most: blocks grow where there would be more
FARTHEST = 2.0**40
WIDTHS = (2.0, 3.0, 4.0)  # cells, in typical distances of a neighbour
PART = "block bigint, id bigint, key bigint, vector binary"
ASKED = "block bigint, id bigint, vector binary, keys binary"
FOUND = "query_id bigint, vec_id bigint, score double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Hashing:
    """Directions, offsets and width of all tables; how many buckets a query visits in each."""

    directions: np.ndarray  # tables, dimensions, hashes
    offsets: np.ndarray
    width: float
    probes: int

    @property
    def steps(self) -> np.ndarray:
        """Every bucket around one: -1, 0 or 1 cell in each direction."""
        return np.array(list(itertools.product((-1, 0, 1), repeat=self.offsets.shape[1])), np.int64)

    def places(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """Where vectors lie on each line, in cells; very far ones all lie at the ends."""
        with np.errstate(over="ignore", invalid="ignore"):
            place = (vectors @ self.directions[table]) / self.width + self.offsets[table]
        return np.clip(np.nan_to_num(place, nan=0.0), -FARTHEST, FARTHEST)

    @staticmethod
    def keys(cells: np.ndarray, table: int) -> np.ndarray:
        """One number for the table and the cells of a bucket."""
        key = np.full(cells.shape[:-1], table + 1, np.uint64)
        for i in range(cells.shape[-1]):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[..., i].astype(np.uint64))
        return key.view(np.int64)

    def visited(self, vector: np.ndarray, table: int, steps: np.ndarray) -> np.ndarray:
        """Keys of the buckets to visit, the most promising first."""
        place = self.places(vector, table)
        cell = np.floor(place)
        inside = place - cell
        border = np.stack((inside, np.zeros_like(inside), 1 - inside)) ** 2  # for a step of -1, 0, 1
        cost = border[steps + 1, np.arange(len(inside))].sum(axis=1)
        order = np.lexsort((np.arange(len(cost)), cost))[: self.probes]
        return self.keys(cell.astype(np.int64) + steps[order], table)


def fit(sample: np.ndarray, rows: int, k: int, tables: int = TABLES, target: float = TARGET_RECALL, seed: int = 17) -> Hashing:
    """Width and number of probes that reach the target on the sample with the fewest candidates.

    Neighbours of a sample are farther apart than those of all rows, so the recall on all rows is not lower.
    """
    random = np.random.default_rng(seed)
    hashes = min(10, max(4, round(math.log2(max(2, rows)) / 2)))
    directions = random.normal(size=(tables, sample.shape[1], hashes))
    offsets = random.uniform(size=(tables, hashes))
    asked = np.arange(min(SAMPLE_QUERIES, len(sample)))
    if len(sample) < 2:
        return Hashing(directions, offsets, 1.0, 3**hashes)
    distance = np.stack([euclidean(sample, v) for v in sample[asked]])
    order = distance.copy()
    order[asked, asked] = np.inf
    near = np.argsort(order, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    typical = float(np.median(np.take_along_axis(distance, near, axis=1))) or 1.0
    best: tuple[float, Hashing] | None = None
    for width in WIDTHS:
        probes = 1
        while True:
            made = Hashing(directions, offsets, width * typical, min(probes, 3**hashes))
            recall, share = _trial(made, sample, asked, near)
            if recall >= target:
                if best is None or share < best[0]:
                    best = share, made
                break
            if probes >= 3**hashes:
                break
            probes *= 2
    return best[1] if best else Hashing(directions, offsets, WIDTHS[-1] * typical, 3**hashes)


def _trial(hashing: Hashing, sample: np.ndarray, asked: np.ndarray, near: np.ndarray) -> tuple[float, float]:
    steps = hashing.steps
    keys = [hashing.keys(np.floor(hashing.places(sample, t)).astype(np.int64), t) for t in range(len(hashing.offsets))]
    hits = share = 0.0
    for q, wanted in zip(asked, near):
        seen = np.zeros(len(sample), bool)
        for t, key in enumerate(keys):
            seen |= np.isin(key, hashing.visited(sample[q], t, steps))
        hits += seen[wanted].mean()
        share += seen.mean()
    return hits / len(asked), share / len(asked)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``vector`` of the rows that take part: with an id, of the commonest length, finite and not zero."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("bigint").alias("id"), v.cast("array<double>").alias("vector")
    )
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (length["n"] if length else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.empty((0, 0))


def _block(keys: np.ndarray, part: np.ndarray | int, blocks: int) -> np.ndarray:
    return (_mix(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.asarray(part, np.uint64)) % np.uint64(blocks)).astype(np.int64)


def euclidean(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Distances of all rows to a vector, also where squares are too large or too small for a double.

    A distance beyond the largest double is infinite.
    """
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        squared = ((matrix - vector) ** 2).sum(axis=1)
        odd = np.flatnonzero(~((squared > 1e-280) & (squared < 1e300)))
        out = np.sqrt(squared)
        if len(odd):  # powers of two change no digit
            a = matrix[odd]
            first = np.frexp(np.maximum(np.abs(a), np.abs(vector)).max(axis=1, initial=0))[1][:, None] + 1
            gap = np.ldexp(a, -first) - np.ldexp(vector, -first)
            second = np.frexp(np.abs(gap).max(axis=1, initial=0))[1][:, None]
            root = np.sqrt((np.ldexp(gap, -second) ** 2).sum(axis=1))
            out[odd] = np.ldexp(np.ldexp(root, second[:, 0]), first[:, 0])
    return out


def _search(key: tuple, parts: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k best of a block for each query that visits it."""
    ids = parts["id"].to_numpy()
    keys = parts["key"].to_numpy()
    matrix = np.frombuffer(b"".join(parts["vector"].to_pylist()), "<f8").reshape(len(ids), -1) if len(ids) else None
    each, place = np.unique(ids, return_inverse=True)
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for query, vector, wanted in zip(asked["id"].to_pylist(), asked["vector"].to_pylist(), asked["keys"].to_pylist()):
        if not len(ids):
            break
        rows = np.flatnonzero((ids != query) if wanted is None else (np.isin(keys, np.frombuffer(wanted, "<i8")) & (ids != query)))
        score = euclidean(matrix[rows], np.frombuffer(vector, "<f8"))
        best = np.full(len(each), np.inf)  # an id counts once, whatever tables or rows brought it
        np.minimum.at(best, place[rows], score)
        here = np.unique(place[rows])
        last = np.partition(best[here], k - 1)[k - 1] if len(here) > k else np.inf
        near = here[best[here] <= last]
        near = near[np.lexsort((each[near], best[near]))][:k]
        found.append((query, each[near], best[near]))
    sizes = [len(f[1]) for f in found]
    return pa.table(
        {
            "query_id": pa.array(np.repeat(np.array([f[0] for f in found], np.int64), sizes)),
            "vec_id": pa.array(np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)),
            "score": pa.array(np.concatenate([f[2] for f in found]) if found else np.empty(0)),
        }
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, from the k nearest of each block."""
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _probe(rows: DataFrame, queries: DataFrame, hashing: Hashing, total: int, k: int, block_rows: int) -> DataFrame:
    tables = len(hashing.offsets)
    block_rows = max(block_rows, total * tables // LARGE_BUCKETS)
    blocks = blocks_for(total * tables, block_rows)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column(1))
            if not len(matrix):
                continue
            packed = pa.array([v.tobytes() for v in matrix], pa.binary())
            for t in range(tables):
                keys = hashing.keys(np.floor(hashing.places(matrix, t)).astype(np.int64), t)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), packed], names=["id", "key", "vector"])

    index = rows.mapInArrow(keyed, "id bigint, key bigint, vector binary")
    # Buckets larger than a block. Their sizes add up to all entries, so there are LARGE_BUCKETS of them at most.
    large = index.groupBy("key").count().where(F.col("count") > block_rows).orderBy("key").toArrow()
    large_keys, large_pieces = large["key"].to_numpy(), -(-large["count"].to_numpy() // block_rows)

    def pieces_of(keys: np.ndarray) -> np.ndarray:
        if not len(large_keys):
            return np.ones(len(keys), np.int64)
        at = np.minimum(np.searchsorted(large_keys, keys), len(large_keys) - 1)
        return np.where(large_keys[at] == keys, large_pieces[at], 1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy()
            pieces = pieces_of(keys).astype(np.uint64)
            part = np.zeros(len(keys), np.uint64)
            several = np.flatnonzero(pieces > 1)
            # By the whole row, so that an id with very many vectors is split too.
            rows_of = batch.column(0).to_numpy().view(np.uint64)[several], batch.column(2).take(pa.array(several)).to_pylist()
            part[several] = (_mix(rows_of[0]) ^ np.array([xxhash.xxh3_64_intdigest(v) for v in rows_of[1]], np.uint64)) % pieces[several]
            yield pa.RecordBatch.from_arrays([pa.array(_block(keys, part, blocks)), *batch.columns], names=["block", "id", "key", "vector"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = hashing.steps
        for batch in batches:
            made: list[tuple] = []
            for query, vector in zip(batch.column(0).to_pylist(), _matrix(batch.column(1))):
                keys = np.concatenate([hashing.visited(vector, t, steps) for t in range(tables)])
                pieces = pieces_of(keys)
                keys = np.repeat(keys, pieces)
                part = np.arange(len(keys)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                block = _block(keys, part, blocks)
                order = np.argsort(block, kind="stable")
                at, first = np.unique(block[order], return_index=True)
                for b, some in zip(at.tolist(), np.split(keys[order], first[1:])):
                    made.append((b, query, vector.tobytes(), some.tobytes()))
            if made:
                yield _rows(made)

    return (
        index.mapInArrow(dealt, PART).groupBy("block")
        .cogroup(queries.mapInArrow(ask, ASKED).groupBy("block"))
        .applyInArrow(lambda key, parts, asked: _search(key, parts, asked, k), FOUND)
    )


def _everything(rows: DataFrame, queries: DataFrame, total: int, k: int, block_rows: int) -> DataFrame:
    """The exact way for queries whose buckets hold too few rows: they are sent to every block of rows."""
    blocks = blocks_for(total, block_rows)
    dealt = rows.select(F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).alias("block"), "id", "vector")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(b, i, v.tobytes(), None) for b, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(batch.column(2)))]
            if made:
                yield _rows(made)

    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), "id", "vector")
    parts = dealt.mapInArrow(pack, ASKED).select("block", "id", F.lit(0).cast("bigint").alias("key"), "vector")
    return (
        parts.groupBy("block").cogroup(asked.mapInArrow(pack, ASKED).groupBy("block"))
        .applyInArrow(lambda key, part, ask: _search(key, part, ask, k), FOUND)
    )


def _rows(made: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=["block", "id", "vector", "keys"])


def nearest(
    vectors: DataFrame,
    asks: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    target: float = TARGET_RECALL,
    block_rows: int = BLOCK_ROWS,
    seed: int = 17,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each row for which ``asks`` holds.

    ``score`` is the Euclidean distance in double precision, infinite where none can hold it. Ties go to the
    smaller id. A query is no candidate of its own, nor is a row of the same id. A query whose id repeats asks with
    its smallest vector, compared component by component; of candidates that repeat an id the nearest counts. Rows
    without id, with a null, zero or not finite vector, or of another than the commonest length take no
    part. A query gets fewer than ``k`` rows only if there are fewer candidates. Width and probes are
    fitted on ``SAMPLE`` rows; every distinct row is indexed.
    """
    spark = vectors.sparkSession
    distinct = scratch_path(spark, "vectors")
    usable(vectors, id_col, vector_col).dropDuplicates(["id", "vector"]).write.parquet(distinct)
    rows = spark.read.parquet(distinct)
    queries = usable(vectors.where(asks), id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector"))
    total = rows.count()
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).toArrow()
    hashing = fit(_matrix(drawn["vector"]), total, k, target=target, seed=seed)
    stored = scratch_path(spark, "neighbours")
    _best(_probe(rows, queries, hashing, total, k, block_rows), k).write.parquet(stored)
    found = spark.read.parquet(stored)
    candidates = rows.agg(F.count_distinct("id")).first()[0] - 1
    counts = found.groupBy("query_id").count().withColumnRenamed("query_id", "id")
    short = queries.join(counts, "id", "left").where(F.coalesce("count", F.lit(0)) < min(k, candidates)).select("id", "vector")
    if short.isEmpty():
        return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    more = _everything(rows, short, total, k, block_rows)
    every = _best(found.drop("rank").unionByName(more), k)
    return every.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
