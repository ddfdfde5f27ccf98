"""Near-duplicates by DartMinHash.

A document is a weighted set of word shingles. Darts are thrown at the plane of weight and rank of every
element: they arrive along the rank as a hashed Poisson process, each at a hashed height and for a hashed
coordinate. Those that land below the element's weight hit the set, and each coordinate keeps its earliest
hit. Two sets share a coordinate with the probability of their weighted Jaccard similarity, and only as many
darts are thrown as it takes to fill the coordinates (Christiani 2020). Coordinates are joined in bands;
the members of a band are compared exactly.

Comparing inside a band: first every member with the smallest one. Only where members are not connected
by then do they meet one another, within a task and in groups of bounded size; larger groups are cut into
blocks, and every pair of blocks that can hold a link is a task. So n copies of one text cost n comparisons,
and no link is lost because a common member was compared first. What stays quadratic are the members of one
band that are not alike enough to be linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.bpe import slices
from textlab.llm.common import raw, release, unused, with_group_stats
from textlab.llm.substrings import Words
from textlab.plans.durable import scratch_path

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 8  # two documents of similarity 0.8 meet in a band with probability 0.9994
GROUP_MEMBERS, GROUP_ELEMENTS = 1_000, 4_000_000  # what a task compares at once; larger groups are cut into blocks
MATRIX_COLUMNS = 2_048
SALTS = 64
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed runs of ``size`` words and how often each occurs; a shorter text is one run."""
    words = Words(text)
    run = min(size, words.n)
    if not run:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    places = np.arange(words.n - run + 1)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.spans(places, run)), np.uint64, len(places))
    return np.unique(hashes, return_counts=True)


def weights_of(counts: np.ndarray, weighting: str) -> np.ndarray:
    """1 for each element of a ``set``, the number of times for ``count``."""
    return np.ones(len(counts)) if weighting == "set" else counts.astype(np.float64)


def _layers(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray):
    """Layers of weight [0, 1), [1, 2), [2, 4), ... that an element reaches into: hash, owner, bottom, width, height."""
    out, bottom, width, level = [], 0.0, 1.0, 0
    while True:
        in_it = weights > bottom
        if not in_it.any():
            break
        base = _mix(elements[in_it] + np.uint64(int(GOLD) * (level + 1) % 2**64))
        n = len(base)
        out.append((base, owner[in_it], np.full(n, bottom), np.full(n, width), weights[in_it]))
        bottom, width, level = bottom + width, (width if level == 0 else 2 * width), level + 1
    return [np.concatenate(c) for c in zip(*out)] if out else None


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, k: int) -> np.ndarray:
    """``k`` coordinates for each of ``owners`` weighted sets; owner says whose an element is. Empty sets stay 0."""
    best = np.full(owners * k, np.inf)
    value = np.zeros(owners * k, np.uint64)
    total = np.bincount(owner, weights, owners)
    layers = _layers(elements, weights, owner)
    if layers is None:
        return value.reshape(owners, k)
    reach = np.where(total > 0, k * (math.log(k) + 4) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        chosen = todo[layers[1]]
        base, own, bottom, width, height = (c[chosen] for c in layers)
        # Sets that need about as many darts for each element go together.
        expected = reach[own] * width
        kind = np.ceil(np.log2(np.maximum(expected, 0.5))).astype(np.int64)
        for c in np.unique(kind):
            at = kind == c
            mean = 2.0**c
            step = max(1, math.ceil(mean + 2 * math.sqrt(mean))) if mean > 1 else 1
            _throw(base[at], own[at], bottom[at], width[at], height[at], reach, step, k, best, value)
        empty = np.isinf(best.reshape(owners, k)).any(axis=1) & (total > 0)
        for o in np.flatnonzero(empty):
            best[o * k : (o + 1) * k], value[o * k : (o + 1) * k] = np.inf, 0
        reach, todo = np.where(empty, 2 * reach, reach), empty
    return value.reshape(owners, k)


def _throw(base, own, bottom, width, height, reach, step, k, best, value) -> None:
    """Throw darts until each element's rank is beyond the reach of its set."""
    rank, number = np.zeros(len(base)), np.uint64(0)
    while len(base):
        count = np.arange(1, step + 1, dtype=np.uint64) + number
        dart = _mix(base[:, None] + GOLD * count[None, :])
        gap = -np.log(((dart >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52) / width[:, None]
        ranks = rank[:, None] + np.cumsum(gap, axis=1)
        second = _mix(dart ^ GOLD)
        high = bottom[:, None] + width[:, None] * ((second >> np.uint64(12)).astype(np.float64) / 2.0**52)
        hit = (ranks <= reach[own][:, None]) & (high < height[:, None])
        places = (own[:, None] * k + (_mix(second + GOLD) % np.uint64(k)).astype(np.int64))[hit]
        found, darts = ranks[hit], second[hit]
        np.minimum.at(best, places, found)
        first = found == best[places]
        value[places[first]] = darts[first]
        rank = ranks[:, -1]
        on = rank <= reach[own]
        base, own, bottom, width, height, rank = base[on], own[on], bottom[on], width[on], height[on], rank[on]
        number += np.uint64(step)
        step = max(1, step // 2)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One number for each band of each signature."""
    parts = signatures.reshape(len(signatures), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(parts.shape[2]):
        key = _mix(key * GOLD + parts[:, :, r])
    return key.view(np.int64)


def sign(docs: DataFrame, shingle: int, weighting: str, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, digest of the weighted set and its band keys; none for a text without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                sets = [shingles(t, shingle) for t in part.column(2).to_pylist()]
                sizes = np.array([len(s) for s, _ in sets])
                elements = np.concatenate([s for s, _ in sets])
                weights = weights_of(np.concatenate([c for _, c in sets]), weighting)
                signed = dart_signatures(elements, weights, np.repeat(np.arange(len(sets)), sizes), len(sets), bands * rows)
                keys = band_keys(signed, bands)
                digests = [
                    xxhash.xxh3_128_digest(s.tobytes() + (b"" if weighting == "set" else c.tobytes())) for s, c in sets
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(digests, pa.binary()),
                        pa.array([k if n else [] for k, n in zip(keys.tolist(), sizes)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "digest", "bands"],
                )
        release()

    return docs.mapInArrow(work, "doc_id bigint, text_hash bigint, digest binary, bands array<bigint>")


def sets_of(docs: DataFrame, shingle: int, weighting: str) -> DataFrame:
    """digest and elements of each text; with ``count`` an element is told apart by its turn, so plain sets compare weights."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                sets = [shingles(t, shingle) for t in part.column(0).to_pylist()]
                digests = [xxhash.xxh3_128_digest(s.tobytes() + (b"" if weighting == "set" else c.tobytes())) for s, c in sets]
                if weighting != "set":
                    turn = lambda c: np.concatenate([np.arange(n, dtype=np.uint64) for n in c]) if len(c) else c.astype(np.uint64)
                    sets = [(_mix(np.repeat(s, c) + GOLD * turn(c)), c) for s, c in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array([s.view(np.int64) for s, _ in sets], pa.list_(pa.int64()))],
                    names=["digest", "elements"],
                )
        release()

    return docs.mapInArrow(work, "digest binary, elements array<bigint>")


class _Store:
    """Tables of one run in the shared folder."""

    def __init__(self, spark):
        self.spark = spark

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.parquet(path)


def similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add the exact similarity to pairs (a, b) of nodes."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("__a"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("__b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", similarity(F.col("__a"), F.col("__b")).alias("similarity"))


def _groups(store: _Store, entries: DataFrame) -> DataFrame:
    """Members (key, node) of the groups of several, with ``pivot``, their smallest node.

    Counts combine before the shuffle and are stored, so that adaptive execution can split a very large
    group where the members meet them.
    """
    several = entries.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return store.put(entries.join(store.put(several.drop("n"), "band-keys"), "key"), "bands")


def _cross_links(least: float):
    """Links between members of one group that have different labels, by exact counts of common elements.

    Where the group has two sides, only members of different sides are compared.
    """

    def compare(group: pa.Table) -> pa.Table:
        nodes, labels, side = group["node"].to_numpy(), group["label"].to_numpy(), group["side"].to_numpy()
        parts = group["elements"].combine_chunks()
        values = parts.flatten().to_numpy()
        sizes = np.diff(parts.offsets.to_numpy())
        member = np.repeat(np.arange(len(nodes)), sizes)
        _, which, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = count[which] > 1
        column = (np.cumsum(count > 1) - 1)[which[shared]]
        member = member[shared]
        one, other = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else 2 * (np.arange(len(nodes)),)
        both = np.zeros((len(one), len(other)), np.float32)
        order = np.argsort(column, kind="stable")
        column, member = column[order], member[order]
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, MATRIX_COLUMNS):
            a, b = np.searchsorted(column, [start, start + MATRIX_COLUMNS])
            holds = np.zeros((len(nodes), MATRIX_COLUMNS), np.float32)
            holds[member[a:b], column[a:b] - start] = 1
            both += holds[one] @ holds[other].T
        union = sizes[one][:, None] + sizes[other][None, :] - both
        linked = (both >= least * union) & (labels[one][:, None] != labels[other][None, :])
        left, right = np.nonzero(linked if side.any() else np.triu(linked))
        return pa.table({"a": pa.array(nodes[one[left]]), "b": pa.array(nodes[other[right]])})

    return compare


def _block_pairs(store: _Store, members: DataFrame, least: float) -> DataFrame:
    """Members (pair, side, node, label) of large groups, once for each pair of blocks that may hold a link.

    A block holds members of about one size. Sizes that differ by more than ``least`` allow no link, so a block
    meets those of its own and the next level of size. Many members that have one label already get blocks of
    their own, which do not meet each other.
    """
    most, elements = max(1, GROUP_MEMBERS // 2), max(1, GROUP_ELEMENTS // 2)
    # A little wider than the ratio of sizes, so that rounding never puts a link two levels apart.
    level = F.floor(F.log("size") / (1.001 * math.log(1 / least))) if least < 1 else F.col("size")
    counted = with_group_stats(
        members.withColumn("level", level.cast("int")), ["key", "level", "label"], {"same": (F.count(F.lit(1)), F.sum)}, F.col("node")
    ).withColumn("one", F.when(F.col("same") >= most, F.col("label")).otherwise(F.lit(-1)))
    sized = with_group_stats(
        counted, ["key", "level", "one"], {"n": (F.count(F.lit(1)), F.sum), "amount": (F.sum("size"), F.sum)}, F.col("node")
    )
    parts = F.ceil(F.greatest(F.col("n") / most, F.col("amount") / elements))
    block = ["key", "level", "one", "part"]
    placed = store.put(sized.withColumn("part", F.pmod(F.xxhash64("node"), parts)).select(*block, "node", "label"), "blocks")
    made = placed.select("key", F.struct("level", "one", "part").alias("block")).distinct()
    meet = made.withColumnRenamed("block", "left").join(made.withColumnRenamed("block", "right"), "key").where(
        (F.col("left") <= F.col("right")) & (F.abs(F.col("right.level") - F.col("left.level")) <= 1)
        & ((F.col("left.one") < 0) | (F.col("left.one") != F.col("right.one")))
    )
    pairs = store.put(meet.withColumn("pair", F.monotonically_increasing_id()), "block-pairs")  # stored, so a pair keeps its number
    sides = pairs.select("key", "pair", "left.*", F.lit(0).alias("side")).unionByName(
        pairs.where(F.col("left") != F.col("right")).select("key", "pair", "right.*", F.lit(1).alias("side"))
    )
    return placed.join(sides, block).select("pair", "side", "node", "label")


def _links(store: _Store, nodes: DataFrame, docs: DataFrame, shingle: int, weighting: str, least: float) -> DataFrame:
    """Links (a, b) of at least ``least`` that connect whatever is connected."""
    groups = _groups(store, nodes.select("node", F.explode("bands").alias("key")))
    wanted = groups.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash", "digest"), "node")
    wanted = store.put(wanted, "wanted")
    texts = docs.join(
        wanted.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")),
        F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("text_hash").eqNullSafe(F.col("__hash")),
        "left_semi",
    )
    found = sets_of(texts.select("text"), shingle, weighting)
    sets = store.put(found.join(wanted.select("digest", "node"), "digest").select("node", "elements"), "shingles")
    pairs = groups.where(F.col("node") != F.col("pivot")).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = store.put(verify(pairs, sets).where(F.col("similarity") >= least).select("a", "b"), "links")
    # The smallest has met everyone. Others need to meet only where they are not connected already.
    labels = components(store, links)
    members = groups.where(F.col("node") != F.col("pivot")).join(labels, "node", "left")
    members = store.put(members.select("key", "node", F.coalesce("label", "node").alias("label")), "members")
    sizes = sets.select("node", F.size("elements").alias("size"))
    spread = members.join(sizes, "node").groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")
    )
    large = (F.col("n") > GROUP_MEMBERS) | (F.col("size") > GROUP_ELEMENTS)
    unsettled = store.put(spread.where("low < high").select("key", large.alias("large")), "unsettled")
    members = members.join(unsettled, "key")
    small = members.where(~F.col("large")).join(sets, "node").select("key", F.lit(0).alias("side"), "node", "label", "elements")
    crossed = small.groupBy("key").applyInArrow(_cross_links(least), "a bigint, b bigint").distinct()
    links = store.put(links.unionByName(crossed), "links")
    rest = members.where("large")
    if rest.isEmpty():
        return links
    met = _block_pairs(store, rest.drop("large").join(sizes, "node"), least).join(sets, "node")
    crossed = met.select("pair", "side", "node", "label", "elements").groupBy("pair").applyInArrow(_cross_links(least), "a bigint, b bigint")
    return store.put(links.unionByName(crossed.distinct()), "links")


def components(store: _Store, links: DataFrame) -> DataFrame:
    """node, label: the smallest node of its connected component, for every node that has a link.

    Each round a node takes the smallest label among its neighbours' and then the label of that; both
    halves are joins on stored tables, which adaptive execution splits where a node has very many links.
    """
    edges = store.put(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store.put(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        offered = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        nearer = labels.join(offered, "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = store.put(
            nearer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels"
        )
        changed = new.where(F.col("old") != F.col("label")).isEmpty()
        labels = new.select("node", "label")
        if changed:
            return labels


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    least: float = SIMILARITY,
    weighting: str = "set",
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, text_hash, text_class, class_id and kept, a row per document.

    Documents whose (weighted) Jaccard similarity of ``shingle``-word runs is ``least`` or more are linked;
    linked documents, directly or in a chain, form a class, named ``class_id`` by its smallest doc_id, and
    that document stays. ``text_class`` is the smallest doc_id with the same runs. ``weighting`` is ``set``
    or ``count``. Texts shorter than a run are one run; null and empty texts and such of white space alone
    have none and form one class. A null id is smaller than any other; of rows equal in id and text one
    stays. Other columns of ``docs`` are not read.
    """
    store = _Store(docs.sparkSession)
    thin = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), raw(text_col).alias("text"))
    signed = store.put(sign(thin, shingle, weighting, bands, rows), "signed")
    first = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "text_hash")
    nodes = store.put(
        signed.groupBy("digest").agg(F.first("bands").alias("bands"), F.min(first).alias("first"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "bands", "first", "first.doc_id", "first.text_hash"),
        "nodes",
    )  # stored, so a node keeps its number
    links = _links(store, nodes, thin, shingle, weighting, least)
    labels = components(store, links)
    named = nodes.select("node", "digest", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = with_group_stats(named, ["label"], {"least": (F.min("first"), F.min)}, F.col("node"))
    classes = classes.select("digest", F.col("first.doc_id").alias("text_class"), F.col("least.doc_id").alias("class_id"), F.col("least.text_hash").alias("__stays"))
    # Every (digest, salt) that occurs gets the class, and the rows meet it there.
    salted = signed.drop("bands").withColumn("__salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)))
    answers = salted.select("digest", "__salt").distinct().join(classes, "digest")
    same_row = Window.partitionBy("digest", "__salt", "doc_id", "text_hash").orderBy("digest")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("__stays")) & (F.col("__turn") == 1)
    return (
        salted.join(answers, ["digest", "__salt"])
        .withColumn("__turn", F.row_number().over(same_row))
        .select("doc_id", "text_hash", "text_class", "class_id", kept.alias("kept"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    mark, id_, hash_, turn = unused(docs, "mark", "kept_id", "kept_hash", "turn")
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(hash_))
    once = Window.partitionBy(id_col, mark).orderBy(mark)
    return marked.join(kept, same, "left_semi").withColumn(turn, F.row_number().over(once)).where(F.col(turn) == 1).select(*docs.columns)
