"""Hard negatives by a GNAT-style multiway hyperplane tree.

A node of the tree has a few split points; a vector belongs to the nearest one. For every split point the node
stores the range of its distances to the members of each sibling subtree. A wanted range of inner products is,
for vectors whose lengths are known to lie in a range, an annulus around the query. By the triangle inequality
the annulus has a range of distances to every split point; a subtree is left out as soon as one of its stored
ranges does not meet it. What is left are leaves, which are compared exactly, so nothing that counts is lost.

The upper tree is grown on a bounded sample, and every row goes to one of its cells. Cells are cut into blocks
of bounded size; inside a block the same kind of tree goes on down to the leaves. Ranges come from all rows. An
anchor is sent once to every block that its window reaches, and a block answers with its few best.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.common import blocks_for, release
from textlab.plans.durable import scratch_path

SAMPLE = 4_096  # rows that the upper tree is grown on
CELLS = 4_096  # of the upper tree at most; larger cells are more blocks
BLOCK_ROWS = 8_192
GROUP_ROWS = 16_384  # anchors that meet a block in one task
LEAF_ROWS = 256
SPLITS = 8
CHUNK = 1_024
EXACT = 1 << 53
LARGEST = 1 << 27  # of components whose inner products, 64 terms, fit a long
NONE = -(1 << 62)  # below every score
SLACK = 1e-9  # wider than what rounding does to roots of whole numbers

ROW = "cell int, id bigint, label bigint, vector binary"
BLOCK = "block bigint, cell int, ids binary, labels binary, vectors array<binary>"
ASK = "block bigint, part int, id bigint, label bigint, vector binary, low array<bigint>, high array<bigint>"
FOUND = "id bigint, place int, other bigint, score bigint"
RANGE = "node int, point int, child int, low double, high double, least double, most double"


def _exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """Floating point where it holds every sum of products exactly, else longs."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    return np.float64 if 4 * a.shape[1] * largest < EXACT else np.int64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    squared = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    return np.sqrt(np.maximum(squared, 0))


def lengths(values: np.ndarray) -> np.ndarray:
    """Squared Euclidean lengths."""
    return (values.astype(np.float64) ** 2).sum(axis=1)


@dataclass
class Node:
    """``low`` and ``high``: distances from split point i to the members of child j; ``least`` and ``most``: their squared lengths."""

    points: np.ndarray
    children: list[Node | int | np.ndarray]  # a node, the number of a cell, or the rows of a leaf
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    most: np.ndarray
    number: int = 0
    above: tuple[Node, int] | None = field(default=None, repr=False)

    def reaches(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Query x child: may the child hold a vector whose inner product with the query is in low..high?"""
        own = lengths(queries)[:, None]
        wide = SLACK * (1 + own + self.most)
        far = self.most + own - 2 * low[:, None] + wide  # squared radii of the annulus
        near = self.least + own - 2 * high[:, None] - wide
        outer, inner = np.sqrt(np.maximum(far, 0)), np.sqrt(np.maximum(near, 0))
        fits = (far >= 0) & (low <= high)[:, None] & np.isfinite(self.least)
        for i, d in enumerate(distances(queries, self.points).T):
            d = d[:, None]
            slack = SLACK * (1 + d + outer)
            fits &= (self.low[i] <= d + outer + slack) & (self.high[i] >= np.maximum(d - outer, inner - d) - slack)
        return fits


def grow(values: np.ndarray, rows: np.ndarray, leaf_rows: int, splits: int = SPLITS) -> Node | np.ndarray:
    """The tree over these rows; a leaf where there are few of them or they cannot be told apart."""
    if len(rows) <= leaf_rows:
        return rows
    mine = values[rows]
    points, away = [0], distances(mine, mine[:1])[:, 0]
    while len(points) < splits and away.max() > 0:  # the row that is farthest from those chosen
        points.append(int(away.argmax()))
        away = np.minimum(away, distances(mine, mine[points[-1:]])[:, 0])
    if len(points) == 1:
        return rows
    apart = distances(mine, mine[points])
    nearest = apart.argmin(axis=1)
    squared = lengths(mine)
    members = [np.flatnonzero(nearest == j) for j in range(len(points))]
    ranges = [(apart[m].min(axis=0), apart[m].max(axis=0), squared[m].min(), squared[m].max()) for m in members]
    low, high, least, most = (np.array(r) for r in zip(*ranges))
    children = [grow(values, rows[m], leaf_rows, splits) for m in members]
    return Node(mine[points], children, low.T, high.T, least, most)


def visit(
    node: Node | int | np.ndarray, queries: np.ndarray, who: np.ndarray, window: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
) -> Iterator[tuple[int | np.ndarray, np.ndarray]]:
    """Leaves and the queries that reach them. ``window`` is asked anew at each node, so a narrower one takes effect."""
    if not isinstance(node, Node):
        yield node, who
        return
    order = distances(queries[who], node.points).mean(axis=0).argsort(kind="stable")
    for j in order.tolist():
        alive = who[node.reaches(queries[who], *window(who))[:, j]]
        if len(alive):
            yield from visit(node.children[j], queries, alive, window)


def cells_of(node: Node | int, values: np.ndarray) -> np.ndarray:
    """The cell of each vector: down to the nearest split point, the first of equals."""
    if not isinstance(node, Node):
        return np.full(len(values), node, np.int32)
    nearest = distances(values, node.points).argmin(axis=1)
    out = np.zeros(len(values), np.int32)
    for j, child in enumerate(node.children):
        mine = np.flatnonzero(nearest == j)
        if len(mine):
            out[mine] = cells_of(child, values[mine])
    return out


class UpperTree:
    """Tree over cells. Its ranges are empty until ``measure`` has seen all rows."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[Node] = []
        self.paths: list[tuple[Node, int] | None] = []  # of each cell: the node above it, and its place there
        leaf_rows = max(1, len(sample) // cells) if cells > 1 else len(sample)
        self.root = self._number(grow(sample, np.arange(len(sample)), max(1, leaf_rows)), None)

    def _number(self, node: Node | np.ndarray, above: tuple[Node, int] | None) -> Node | int:
        if not isinstance(node, Node):
            self.paths.append(above)
            return len(self.paths) - 1
        node.number, node.above = len(self.nodes), above
        self.nodes.append(node)
        node.low, node.high = np.full_like(node.low, np.inf), np.full_like(node.high, -np.inf)
        node.least, node.most = np.full_like(node.least, np.inf), np.full_like(node.most, -np.inf)
        node.children = [self._number(child, (node, j)) for j, child in enumerate(node.children)]
        return node

    def ranges(self, cell: int, values: np.ndarray) -> Iterator[tuple]:
        """What members of a cell add to the ranges of all nodes above it."""
        squared, above = lengths(values), self.paths[cell]
        least, most = float(squared.min()), float(squared.max())
        while above is not None:
            node, child = above
            apart = distances(values, node.points)
            for i, (a, b) in enumerate(zip(apart.min(axis=0).tolist(), apart.max(axis=0).tolist())):
                yield node.number, i, child, a, b, least, most
            above = node.above

    def measure(self, blocks: DataFrame) -> None:
        """Set all ranges: one small row per node, point and child reaches the driver."""
        tree = self

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [
                    r for cell, vectors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for r in tree.ranges(cell, _unpacked(vectors))
                ]
                if made:
                    kinds = [pa.int32()] * 3 + [pa.float64()] * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=[f.split()[0] for f in RANGE.split(", ")]
                    )

        found = blocks.select("cell", "vectors").mapInArrow(work, RANGE).groupBy("node", "point", "child").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most")
        )
        for r in found.collect():  # nodes x splits x splits, bounded by CELLS
            node = self.nodes[r["node"]]
            node.low[r["point"], r["child"]], node.high[r["point"], r["child"]] = r["low"], r["high"]
            node.least[r["child"]], node.most[r["child"]] = r["least"], r["most"]


def _unpacked(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), -1)


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in values.astype("<i4")], pa.binary())


class Search:
    """The best rows of a block for each query and window, found by the block's tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, same: bool, best: int):
        order = np.argsort(ids, kind="stable")  # so that the first of equal scores is the smaller id
        self.ids, self.labels, self.values = ids[order], labels[order], values[order]
        self.same, self.best = same, best
        self.tree = grow(self.values, np.arange(len(ids)), LEAF_ROWS)

    def run(self, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
        """Per query: id, window, and the ids and scores of at most ``best`` rows with a score in that window."""
        kind = _exact_kind(queries, self.values)
        asked = queries.astype(kind)
        low = low.copy()  # rises to the last of the best found so far
        scores = np.full((*low.shape, self.best), NONE, np.int64)
        others = np.zeros((*low.shape, self.best), np.int64)

        def window(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            open_ = low[who] <= high[who]
            return (
                np.where(open_, low[who], np.inf).min(axis=1),
                np.where(open_, high[who], -np.inf).max(axis=1),
            )

        for rows, who in visit(self.tree, queries, np.arange(len(ids)), window):
            made = (asked[who] @ self.values[rows].astype(kind).T).astype(np.int64)
            alike = labels[who][:, None] == self.labels[rows]
            fits = (alike if self.same else ~alike) & (ids[who][:, None] != self.ids[rows])
            for w in range(low.shape[1]):
                inside = fits & (made >= low[who, w][:, None]) & (made <= high[who, w][:, None])
                hit = np.flatnonzero(inside.any(axis=1))
                if not len(hit):
                    continue
                kept = np.where(inside[hit], made[hit], NONE)
                top = np.argsort(-kept, axis=1, kind="stable")[:, : self.best]
                at = who[hit]
                both = np.concatenate((scores[at, w], np.take_along_axis(kept, top, axis=1)), axis=1)
                names = np.concatenate((others[at, w], self.ids[rows][top]), axis=1)
                first = np.lexsort((names, -both), axis=1)[:, : self.best]
                scores[at, w] = np.take_along_axis(both, first, axis=1)
                others[at, w] = np.take_along_axis(names, first, axis=1)
                low[at, w] = np.maximum(low[at, w], scores[at, w, -1])
        for q, w, r in zip(*(a.tolist() for a in np.nonzero(scores > NONE))):
            yield int(ids[q]), w, int(others[q, w, r]), int(scores[q, w, r])


def _probe(blocks: DataFrame, asks: DataFrame, parts: int, same: bool, best: int) -> DataFrame:
    """Blocks meet the queries that were sent to them; ``parts`` tasks share the queries of a block."""
    if parts == 1:
        offered = blocks.withColumn("turn", F.lit(0))
    else:  # a block goes to the parts that ask it
        offered = blocks.join(asks.select("block", F.col("part").alias("turn")).distinct(), "block")

    def work(key: tuple, block: pa.Table, asked: pa.Table) -> pa.Table:
        made: list[tuple] = []
        if block.num_rows and asked.num_rows:
            search = Search(
                np.frombuffer(block["ids"][0].as_py(), "<i8"), np.frombuffer(block["labels"][0].as_py(), "<i8"),
                _unpacked(block["vectors"][0].as_py()), same, best,
            )
            for at in range(0, asked.num_rows, CHUNK):
                part = asked.slice(at, CHUNK)
                windows = [_windows(part[name]) for name in ("low", "high")]
                made += search.run(part["id"].to_numpy(), part["label"].to_numpy(), _unpacked(part["vector"].to_pylist()), *windows)
        columns = list(zip(*made)) or [()] * 4
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        release()
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "place", "other", "score"])

    return offered.groupBy("block", "turn").cogroup(asks.groupBy("block", "part")).applyInArrow(work, FOUND)


def _windows(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64)


def usable(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """id, label and ``vector`` (floor(scale * x)) of the rows that take part, one per id."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / scale))
    whole = F.transform(v, lambda x: F.floor(scale * x.cast("double")).cast("int"))
    rows = vectors.where(v.isNotNull() & fine).select(
        F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), whole.alias("vector")
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull())
    width = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("vector") == (width["n"] if width else 0))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(values), -1) if len(values) else np.empty((0, 0), np.int64)


def _blocks(rows: DataFrame, tree: UpperTree, block_rows: int) -> tuple[DataFrame, dict[int, int], int]:
    """Stored blocks of the cells, how many each cell has, and the highest such number."""
    spark = rows.sparkSession

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column(2))
            if len(values):
                cells = pa.array(cells_of(tree.root, values), pa.int32())
                yield pa.RecordBatch.from_arrays([cells, batch.column(0), batch.column(1), _packed(values)], names=["cell", "id", "label", "vector"])

    celled = rows.mapInArrow(assign, ROW)
    pieces = {r["cell"]: blocks_for(r["count"], block_rows) for r in celled.groupBy("cell").count().collect()}  # CELLS at most
    most = max(pieces.values())
    per_cell = F.element_at(F.create_map(*[F.lit(x) for pair in pieces.items() for x in pair]), F.col("cell"))
    several = [cell for cell, n in pieces.items() if n > 1]
    piece = F.when(F.col("cell").isin(several), F.pmod(F.xxhash64("id"), per_cell)).otherwise(0) if several else F.lit(0)
    dealt = celled.withColumn("block", F.col("cell").cast("bigint") * most + piece)

    def pack(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("id")  # the same block again if the task runs again
        cell = block["cell"][0].as_py()
        vectors = [block["vector"].to_pylist()]
        raw = [block[name].to_numpy().astype("<i8").tobytes() for name in ("id", "label")]
        columns = [pa.array([key[0].as_py()], pa.int64()), pa.array([cell], pa.int32()), *[pa.array([r], pa.binary()) for r in raw]]
        return pa.table([*columns, pa.array(vectors, pa.list_(pa.binary()))], names=["block", "cell", "ids", "labels", "vectors"])

    stored = scratch_path(spark, "negative-blocks")
    dealt.groupBy("block").applyInArrow(pack, BLOCK).write.parquet(stored)
    return spark.read.parquet(stored), pieces, most


def _asks(queries: DataFrame, tree: UpperTree, pieces: dict[int, int], most: int, parts: int, cells: str) -> DataFrame:
    """A row per query and block: of its ``own`` cell, of all ``other`` ones that its windows reach, or of ``any`` such."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                values = _matrix(part.column(2))
                low, high = (np.array(part.column(c).to_pylist(), np.int64) for c in (3, 4))
                open_ = low <= high
                reach = np.where(open_, low, np.inf).min(axis=1), np.where(open_, high, -np.inf).max(axis=1)
                home = cells_of(tree.root, values)
                if cells == "own":
                    found = [(cell, np.flatnonzero(home == cell)) for cell in np.unique(home).tolist()]
                else:
                    every = np.flatnonzero(open_.any(axis=1))
                    found = list(visit(tree.root, values, every, lambda who: (reach[0][who], reach[1][who])))
                    if cells == "other":
                        found = [(cell, who[home[who] != cell]) for cell, who in found]
                packed, turn = _packed(values), part.column(0).to_numpy() % 1_000_003 % parts
                for cell, who in found:
                    for piece in range(pieces.get(cell, 0)):
                        if len(who):
                            take = pa.array(who)
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(np.full(len(who), cell * most + piece), pa.int64()), pa.array(turn[who], pa.int32()),
                                    part.column(0).take(take), part.column(1).take(take), packed.take(take), part.column(3).take(take), part.column(4).take(take),
                                ],
                                names=[f.split()[0] for f in ASK.split(", ")],
                            )

    return queries.select("id", "label", "vector", "low", "high").mapInArrow(work, ASK)


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: tuple[int, int] = (50, 100),
    high: tuple[int, int] = (95, 100),
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    block_rows: int = BLOCK_ROWS,
    group_rows: int = GROUP_ROWS,
    seed: int = 11,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows for which ``anchors``, a condition on the column ``id``, holds. Their positives are the first
    ``positives`` other rows of the same label by inner product of the vectors floor(scale * x), ties by the smaller
    id; for each of them the first ``negatives`` rows of another label are given whose score lies between the
    fractions ``low`` and ``high`` of the positive's. All answers are exact.

    Rows without id, label or vector, with a null, a not finite or a very large component (``LARGEST``), or of another
    than the commonest length take no part. Of rows that repeat an id the one with the smallest label, then vector,
    counts. An anchor has fewer positives, and a positive fewer or no negatives, only where there are no more; a
    positive without negatives has no row. An empty table gives no rows. Equal vectors are rows like any other.
    """
    spark = vectors.sparkSession
    label = F.col("label") if label is None else label
    stored = scratch_path(spark, "negative-rows")
    usable(vectors, scale, id_col, vector_col, label).write.parquet(stored)
    rows = spark.read.parquet(stored)
    total = rows.count()
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not total:
        return spark.createDataFrame([], out)
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).toArrow()
    tree = UpperTree(_matrix(drawn["vector"]), min(CELLS, blocks_for(total, block_rows)))
    blocks, pieces, most = _blocks(rows, tree, block_rows)
    tree.measure(blocks)
    asking = rows.where(anchors)
    parts = blocks_for(asking.count(), group_rows)
    best = Window.partitionBy("id", "place").orderBy(F.desc("score"), "other")

    def search(queries: DataFrame, cells: str, same: bool, wanted: int) -> DataFrame:
        return _probe(blocks, _asks(queries, tree, pieces, most, parts, cells), parts, same, wanted)

    def windows(lows: Column, highs: Column) -> list[Column]:
        return [lows.cast("array<bigint>").alias("low"), highs.cast("array<bigint>").alias("high")]

    # The own cell first: what it holds narrows the window for all the others.
    everything = F.array(F.lit(-NONE))
    near_path = scratch_path(spark, "negative-near")
    search(asking.select("*", *windows(F.array(F.lit(NONE + 1)), everything)), "own", True, positives).write.parquet(near_path)
    near = spark.read.parquet(near_path)
    ranked = near.withColumn("rank", F.row_number().over(best))
    reached = ranked.where(F.col("rank") == positives).select("id", F.col("score").alias("least"))
    further = asking.join(reached, "id", "left").select(
        "id", "label", "vector", *windows(F.array(F.coalesce("least", F.lit(NONE + 1))), everything)
    )
    found = near.unionByName(search(further, "other", True, positives)).withColumn("rank", F.row_number().over(best))
    pair_path = scratch_path(spark, "negative-positives")
    found.where(F.col("rank") <= positives).select(
        "id", (F.col("rank") - 1).alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")
    ).write.parquet(pair_path)
    pairs = spark.read.parquet(pair_path)

    # Whole numbers n with low[0] * p <= low[1] * n and high[1] * n <= high[0] * p.
    p = F.col("positive_score").cast("decimal(38,0)")
    least = -F.floor(-p * low[0] / F.lit(low[1]).cast("decimal(10,0)"))
    bounds = pairs.select("id", "place", least.alias("low"), F.floor(p * high[0] / F.lit(high[1]).cast("decimal(10,0)")).alias("high"))
    given = bounds.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("low", "high").alias("w")))).alias("w"))
    places = F.sequence(F.lit(0), F.lit(positives - 1))
    side = lambda name, none: F.transform(places, lambda i: F.coalesce(F.try_element_at("w", i)[name], F.lit(none)))
    asked = asking.join(given, "id").select("id", "label", "vector", *windows(side("low", 1), side("high", 0)))
    hard = search(asked, "any", False, negatives).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return hard.join(pairs, ["id", "place"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
