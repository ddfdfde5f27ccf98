"""Exact nearest neighbours that leave out cells by the triangle inequality.

Labelled rows belong to the nearest of a few centres. A query meets its nearest cells first, as many as hold k
rows; no row nearer than the k-th found can lie in a cell whose range of distances to its centre is farther from
the query's own distance to that centre. Only the other cells are met. Queries for which this leaves out too
little are not settled by cells: they go through ``neighbors.nearest``, all blocks. The result is the same
whatever the centres are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlab.operators.neighbors import BLOCK, METRICS, _distances, _matrix, closest, nearest
from textlab.plans.durable import checkpointed
from textlab.plans.ordered import seeded_hash

#: Centres, at most; they and the range of each cell pass the driver and go to every task.
CELLS = 1024


def _search(
    train: DataFrame, test: DataFrame, k: int, metric: str, id_col: str, vec: str, label: str, seed: int, cells: int, block: int, whole: float,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neighbours found in cells, the visits (``_q``, ``rows`` met) and the queries that cells do not settle."""
    id_type, label_type = (train.schema[c].dataType.simpleString() for c in (id_col, label))
    first = train.orderBy(seeded_hash(seed, id_col), id_col).limit(min(cells, CELLS)).select(vec).collect()
    centres = _matrix([r[vec] for r in first], metric)
    space = "manhattan" if metric == "manhattan" else "euclidean"  # cosine: on unit vectors

    def gaps(vectors) -> np.ndarray:
        points = _matrix(vectors, metric)
        return np.vstack([_distances(points[i : i + 512], centres, space) for i in range(0, len(points), 512)])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = gaps(batch[vec])
                cell = d.argmin(axis=1)
                yield batch.assign(cell=cell.astype("int32"), gap=d[np.arange(len(d)), cell])

    placed = checkpointed(train.mapInPandas(place, f"{id_col} {id_type}, {vec} array<double>, {label} {label_type}, cell int, gap double"))
    counts, low, high = np.zeros(len(centres), dtype="int64"), np.zeros(len(centres)), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high")).collect():
        counts[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    parts = np.maximum(1, -(-counts // block))

    def homes(d: np.ndarray) -> np.ndarray:
        """The nearest cells that together hold k rows, a row of flags per query."""
        by = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(counts[by], axis=1) - counts[by]
        out = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(out, by, before < k, axis=1)
        return out & (counts > 0)

    def visits(batch: pd.DataFrame, met: np.ndarray) -> pd.DataFrame:
        q, c = np.nonzero(met)
        again = parts[c]
        q, c = np.repeat(q, again), np.repeat(c, again)
        part = np.arange(len(c)) - np.repeat(np.cumsum(again) - again, again)
        return pd.DataFrame({
            "_q": batch[id_col].to_numpy()[q], "_v": batch[vec].to_numpy()[q], "cell": c.astype("int32"), "part": part.astype("int32"),
            "rows": np.where(part == 0, counts[c], 0),
        })

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield visits(batch, homes(gaps(batch[vec])))

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            d = gaps(batch[vec])
            kth = batch["kth"].to_numpy(dtype="float64")[:, None]
            # Distances are compared at nine digits, so a little more than the k-th counts.
            reach = np.sqrt(2 * (kth + 1e-8)) if metric == "cosine" else kth + 1e-8
            bound = np.maximum(d - high, low - d) - 1e-12 * (d + high)
            at_first = homes(d)
            met = ~(bound > reach) & (counts > 0)  # no k-th: every cell
            unsettled = (met * counts).sum(axis=1) > whole * counts.sum()
            yield visits(batch, met & ~at_first & ~unsettled[:, None])
            far = batch[unsettled]
            yield pd.DataFrame({"_q": far[id_col], "_v": far[vec], "cell": np.int32(-1), "part": np.int32(0), "rows": 0})

    visit = f"_q {id_type}, _v array<double>, cell int, part int, rows bigint"
    slices = max(1, math.ceil(test.count() / block))
    sizes = F.array(*[F.lit(int(n)) for n in parts])
    shelved = placed.select(
        "cell", F.pmod(F.xxhash64(id_col), F.get(sizes, F.col("cell"))).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), id_col, vec, label,
    )

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"_q": [], id_col: [], label: [], "distance": []})
        a = a.sort_values(id_col)
        q, p, d = closest(_matrix(b["_v"], metric), _matrix(a[vec], metric), k, metric)
        return pd.DataFrame({"_q": b["_q"].to_numpy()[q], id_col: a[id_col].to_numpy()[p], label: a[label].to_numpy()[p], "distance": d})

    def found(met: DataFrame) -> DataFrame:
        keys = ["cell", "part", "slice"]
        met = met.withColumn("slice", F.pmod(F.xxhash64("_q"), F.lit(slices)).cast("int"))
        pairs = shelved.groupBy(*keys).cogroup(met.groupBy(*keys))
        return checkpointed(pairs.applyInPandas(meet, f"_q {id_type}, {id_col} {id_type}, {label} {label_type}, distance double"))

    near = checkpointed(test.mapInPandas(at_home, visit))
    hits = found(near)
    kth = hits.withColumn("place", F.row_number().over(W.partitionBy("_q").orderBy("distance", id_col))).where(F.col("place") == k)
    reached = test.join(kth.select(F.col("_q").alias(id_col), F.col("distance").alias("kth")), id_col, "left").select(id_col, vec, "kth")
    rest = checkpointed(reached.mapInPandas(elsewhere, visit))
    unsettled = rest.where("cell = -1").select(F.col("_q").alias(id_col), F.col("_v").alias(vec))
    more = rest.where("cell >= 0")
    hits = hits.unionByName(found(more)).join(unsettled.select(F.col(id_col).alias("_q")), "_q", "left_anti")
    return hits, near.unionByName(more).select("_q", "rows"), unsettled


def _sides(train: DataFrame, test: DataFrame, metric: str, id_col: str, vec: str, label: str) -> tuple[DataFrame, DataFrame]:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    values = F.col(vec).cast("array<double>").alias(vec)
    return train.where(F.col(vec).isNotNull()).select(id_col, values, label), test.where(F.col(vec).isNotNull()).select(id_col, values)


def nearest_in_cells(
    train: DataFrame, test: DataFrame, k: int, metric: str = "euclidean", id_col: str = "id", vec: str = "vec",
    label: str = "label", seed: int = 42, cells: int = 256, block: int = BLOCK, whole: float = 0.5,
) -> DataFrame:
    """Rows of ``neighbors.nearest``: id, neighbour, label, distance, place; ids are unique on each side.

    ``cells`` centres are drawn by a seeded hash (1,024 at most). A cell of more than ``block`` rows is met in parts.
    Queries whose cells hold more than ``whole`` of the labelled rows are answered by ``nearest``. Null vectors take no part.
    """
    train, test = _sides(train, test, metric, id_col, vec, label)
    if train.isEmpty() or test.isEmpty():
        return nearest(train, test, k, metric, id_col, vec, label, block=block)
    hits, _, unsettled = _search(train, test, k, metric, id_col, vec, label, seed, cells, block, whole)
    place = F.row_number().over(W.partitionBy("_q").orderBy("distance", id_col))
    settled = hits.withColumn("place", place).where(F.col("place") <= k).select(
        F.col("_q").alias(id_col), F.col(id_col).alias("neighbour"), label, "distance", "place"
    )
    return settled.unionByName(nearest(train, unsettled, k, metric, id_col, vec, label, block=block))


def compared_rows(
    train: DataFrame, test: DataFrame, k: int, metric: str = "euclidean", id_col: str = "id", vec: str = "vec",
    label: str = "label", seed: int = 42, cells: int = 256, block: int = BLOCK, whole: float = 0.5,
) -> DataFrame:
    """id, compared: labelled rows whose distance ``nearest_in_cells`` takes for each query."""
    train, test = _sides(train, test, metric, id_col, vec, label)
    _, met, unsettled = _search(train, test, k, metric, id_col, vec, label, seed, cells, block, whole)
    every = unsettled.select(F.col(id_col).alias("_q"), F.lit(train.count()).alias("rows"))
    return met.unionByName(every).groupBy(F.col("_q").alias(id_col)).agg(F.sum("rows").alias("compared"))
