"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.plans.durable import checkpointed


def _united(links: DataFrame) -> DataFrame:
    """(_from, _to) for the ends of few links: every end to the smallest of its component, found in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for u, v in zip(batch["_u"].tolist(), batch["_v"].tolist()):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        ends = list(parent)
        yield pd.DataFrame({"_from": ends, "_to": [root(x) for x in ends]}, dtype="int64")

    return links.coalesce(1).mapInPandas(run, "_from bigint, _to bigint")


def components(links: DataFrame, few: int = 1 << 17) -> DataFrame:
    """(_u, _component) for every distinct ``_u`` of the links (``_u``, ``_v``), all of type bigint and not null.

    In a round every end joins the end of the smallest seeded hash among itself and its neighbours, and links run
    between what they have joined. A path loses about half of its ends a round whatever their order, so rounds
    follow the logarithm of the links. The last ``few`` links are settled in one task. What each round joined is a
    table of its own; at the end the ends are followed through these tables.
    """
    left = checkpointed(links.select("_u", "_v").where("_u != _v").distinct())
    joined: list[DataFrame] = []
    while (n := left.count()) > few:
        both = left.unionByName(left.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(joined)), c).alias("h"), F.col(c).alias("end"))  # noqa: E731, B023
        lowest = both.groupBy("_u").agg(F.min(rank("_v")).alias("near"))
        step = checkpointed(lowest.select(F.col("_u").alias("_from"), F.least("near", rank("_u"))["end"].alias("_to")))
        joined.append(step)
        for end in ("_u", "_v"):
            left = left.join(step.withColumnRenamed("_from", end), end).drop(end).withColumnRenamed("_to", end)
        left = checkpointed(left.where("_u != _v").distinct())
    if n:
        joined.append(checkpointed(_united(left)))
    out = links.select("_u", F.col("_u").alias("_component")).distinct()
    for step in joined:
        out = out.join(step.withColumnRenamed("_from", "_component"), "_component", "left").select(
            "_u", F.coalesce("_to", "_component").alias("_component")
        )
    return out
