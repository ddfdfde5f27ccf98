"""Substring dedup by difference-cover anchors.

A difference cover D modulo v has, for any two positions i and j, a shift d < v that brings both into D
(modulo v). So of any two equal runs of ``window`` words, some aligned pair of positions lies on the cover
in both, and the anchors of ``window - v + 1`` words that start there are equal. Only those anchors are
hashed (6 of 31 positions). Around each anchor that several documents share, the windows holding it are
the candidates; their 128-bit hashes decide.

Documents are dealt into blocks. A block sends each distinct hash once, sorted and packed, to the range of
hashes it belongs to, and gets one bit back for each. However many documents share a passage, it is one
entry per block, and no list of its places is made anywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import blocks_for, raw, release

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # every difference modulo 31 once
SMALL_BLOCK, LARGE_BLOCK, MANY_BLOCKS = 2 << 20, 64 << 20, 2000
RANGE_BYTES = 16 << 20  # of text for each range of hashes
NO_ID = -(2**63)  # stands for a null id, which is smaller than every other
MESSAGE = "block long, hash_range long, payload binary"
REPLY = "block long, step int, hash_range long, payload binary"
RESULT = [
    T.StructField("__words", T.LongType()),
    T.StructField("__removed", T.LongType()),
    T.StructField("__kept", T.BinaryType()),
    T.StructField("__spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
]


class Words:
    """The words of a text, joined by one space, with the place of each."""

    def __init__(self, text: bytes | None):
        words = (text or b"").split()  # at 0x20 and 0x09-0x0D
        self.n = len(words)
        self.joined = b" ".join(words)
        self.starts = np.zeros(self.n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, self.n) + 1, out=self.starts[1:])

    def spans(self, at: np.ndarray, size: int) -> Iterator[bytes]:
        joined = self.joined
        for a, b in zip(self.starts[at].tolist(), (self.starts[at + size] - 1).tolist()):
            yield joined[a:b]

    def keep(self, removed: np.ndarray) -> bytes:
        edges = np.flatnonzero(np.diff(np.concatenate(([True], removed, [True])).astype(np.int8)))
        cut = self.starts[edges].tolist()
        return b" ".join(self.joined[a : b - 1] for a, b in zip(cut[::2], cut[1::2]))


def _mark(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """True where one of the ranges covers a place of n."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def _ranges(high: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The runs of sorted hashes by their first bits."""
    part = high >> np.uint64(64 - bits) if bits else np.zeros(len(high), np.uint64)
    found, first = np.unique(part, return_index=True)
    for i, (value, a) in enumerate(zip(found.tolist(), first.tolist())):
        yield value, slice(a, int(first[i + 1]) if i + 1 < len(first) else len(high))


def _answers(high: np.ndarray, bits: int, replies: dict[int, bytes]) -> np.ndarray:
    """The replies' bits in the order in which the hashes were sent."""
    out = np.zeros(len(high), bool)
    for value, run in _ranges(high, bits):
        out[run] = np.unpackbits(np.frombuffer(replies[value], np.uint8), count=run.stop - run.start)
    return out


class Block:
    """What a block of documents knows; the same rows give the same hashes in the same order, however they arrive."""

    def __init__(self, rows: pa.Table, window: int, period: int, cover: tuple[int, ...]):
        self.window, self.size = window, window - period + 1
        self.ids = rows["__id"].fill_null(NO_ID).to_numpy()
        self.docs = [Words(t) for t in rows["__text"].to_pylist()]
        on_cover = np.zeros(period, bool)
        on_cover[list(cover)] = True
        self.at = [
            np.flatnonzero(np.resize(on_cover, d.n - self.size + 1)) if d.n >= window else np.empty(0, np.int64)
            for d in self.docs
        ]
        digest = xxhash.xxh3_64_intdigest
        hashes = [h for d, at in zip(self.docs, self.at) for h in map(digest, d.spans(at, self.size))]
        self.owner = np.repeat(np.arange(len(self.docs)), [len(a) for a in self.at])
        self.anchors, self.which = np.unique(np.array(hashes, np.uint64), return_inverse=True)

    def own_repeats(self) -> np.ndarray:
        """Which anchors several documents of this block hold."""
        pairs = np.unique(self.which * len(self.docs) + self.owner)
        return np.bincount(pairs // max(1, len(self.docs)), minlength=len(self.anchors)) > 1

    def windows(self, shared: np.ndarray) -> None:
        """Hash the windows that hold an anchor which ``shared`` says others hold too."""
        hit = shared[self.which]
        self.starts, owners, digests, first = [], [], [], 0
        for k, (doc, at) in enumerate(zip(self.docs, self.at)):
            mine = at[hit[first : first + len(at)]]
            first += len(at)
            last = doc.n - self.window
            if len(mine):
                reach = _mark(np.clip(mine + self.size - self.window, 0, last + 1), np.minimum(mine, last) + 1, last + 1)
                places = np.flatnonzero(reach)
                digests.extend(map(xxhash.xxh3_128_digest, doc.spans(places, self.window)))
            else:
                places = np.empty(0, np.int64)
            self.starts.append(places)
        words = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
        owners = np.repeat(self.ids, [len(s) for s in self.starts])
        self.high, self.low, self.least, self.of = smallest(words[:, 0], words[:, 1], owners)

    def covered(self, elsewhere: np.ndarray) -> Iterator[np.ndarray]:
        """For each document, which words a window covers that starts in a smaller document too."""
        before, first = elsewhere[self.of], 0
        for doc, ident, starts in zip(self.docs, self.ids, self.starts):
            mine = slice(first, first + len(starts))
            first += len(starts)
            hit = starts[before[mine] | (self.least[self.of[mine]] < ident)]
            yield _mark(hit, hit + self.window, doc.n)


def smallest(high: np.ndarray, low: np.ndarray, ids: np.ndarray):
    """Distinct hashes in order, the smallest id of each, and for every input its place among them."""
    order = np.lexsort((ids, low, high))
    high, low, ids = high[order], low[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return high[new], low[new], ids[new], of


def _table(names: str, rows: Iterable[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns)})


def find_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and the removed spans of words, a row per document.

    Words are what stands between 0x20 and 0x09-0x0D. A word is removed when a window of ``window``
    words covers it that also starts in a document with a smaller id; repeats inside one document, or in
    documents of equal id, are left. A null text has no words; a null id is smaller than any other.
    Documents shorter than the window keep everything. Other columns of ``docs`` are not read.
    """
    return _repeats(docs, id_col, text_col, [], window, period, cover).select(
        F.col("__id").alias("doc_id"),
        F.col("__words").alias("n_words"),
        F.col("__removed").alias("n_removed"),
        F.col("__kept").cast("string").alias("kept_text"),
        F.col("__spans").alias("spans"),
    )


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars: str | None = None, **options) -> DataFrame:
    """The rows and columns of ``docs``, their text without what ``find_repeats`` removes.

    A text that loses nothing stays as it is; in others the words that are left are joined by one space.
    A column named by ``n_chars`` becomes the length of a text that was cut.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    found = _repeats(docs, id_col, text_col, others, options.get("window", WINDOW), options.get("period", PERIOD), options.get("cover", COVER))
    cut = F.col("__removed") > 0
    text = F.when(cut, F.col("__kept")).otherwise(F.col("__text")).cast("string")
    values = {id_col: F.col("__id").cast(docs.schema[id_col].dataType), text_col: text}
    values |= {c: F.col(f"__other{i}") for i, c in enumerate(others)}
    if n_chars in others:
        length = F.length(F.col("__kept").cast("string")).cast(docs.schema[n_chars].dataType)
        values[n_chars] = F.when(cut, length).otherwise(values[n_chars])
    return found.select(*[values[c].alias(c) for c in docs.columns])


def _repeats(
    docs: DataFrame, id_col: str, text_col: str, others: list[str], window: int, period: int, cover: tuple[int, ...]
) -> DataFrame:
    if period > window or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("not a difference cover for this window")
    carried = [F.col(c).alias(f"__other{i}") for i, c in enumerate(others)]
    rows = docs.select(F.col(id_col).cast("bigint").alias("__id"), raw(text_col).alias("__text"), *carried)
    total = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    blocks = blocks_for(total, min(LARGE_BLOCK, max(SMALL_BLOCK, total // MANY_BLOCKS)))
    bits = (blocks_for(total, RANGE_BYTES) - 1).bit_length()
    block = F.pmod(F.xxhash64(F.coalesce("__id", F.xxhash64("__text"))), F.lit(blocks)).alias("block")
    dealt = rows.select("*", block)  # the three passes read this one exchange
    result_type, names = T.StructType([*rows.schema.fields, *RESULT]), rows.columns

    def send(key: tuple, group: pa.Table) -> pa.Table:
        release()  # of the block before
        found = Block(group, window, period, cover)
        name = key[0].as_py()
        return _table(MESSAGE, ((name, r, found.anchors[run].astype("<u8").tobytes()) for r, run in _ranges(found.anchors, bits)))

    def in_several(key: tuple, messages: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, "<u8") for p in messages["payload"].to_pylist()]
        _, which, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        return _replies(0, key, messages, count[which] > 1, [len(p) for p in parts])

    def send_windows(key: tuple, group: pa.Table, replies: pa.Table) -> pa.Table:
        found = _with_windows(group, replies)
        return _table(
            MESSAGE,
            (
                (key[0].as_py(), r, b"".join(x[run].tobytes() for x in (found.high, found.low, found.least)))
                for r, run in _ranges(found.high, bits)
            ),
        )

    def in_smaller(key: tuple, messages: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, "<u8").reshape(3, -1) for p in messages["payload"].to_pylist()]
        high, low, ids = np.concatenate(parts, axis=1)
        ids = ids.view(np.int64)
        _, _, least, of = smallest(high, low, ids)
        return _replies(1, key, messages, least[of] < ids, [p.shape[1] for p in parts])

    def remove(key: tuple, group: pa.Table, replies: pa.Table) -> pa.Table:
        found = _with_windows(group, replies)
        removed = list(found.covered(_answers(found.high, bits, _of_step(replies, 1))))
        edges = [np.flatnonzero(np.diff(np.concatenate(([False], r, [False])).astype(np.int8))) for r in removed]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        made = {
            "__words": pa.array([d.n for d in found.docs], pa.int64()),
            "__removed": pa.array([int(r.sum()) for r in removed], pa.int64()),
            "__kept": pa.array([d.keep(r) for d, r in zip(found.docs, removed)], pa.binary()),
            "__spans": pa.array([[{"start": a, "end": b} for a, b in e.reshape(-1, 2).tolist()] for e in edges], kind),
        }
        out = group.select(names)
        for name, column in made.items():
            out = out.append_column(name, column)
        return out

    def _with_windows(group: pa.Table, replies: pa.Table) -> Block:
        release()
        found = Block(group, window, period, cover)
        found.windows(_answers(found.anchors, bits, _of_step(replies, 0)) | found.own_repeats())
        return found

    anchors = dealt.groupBy("block").applyInArrow(send, MESSAGE)
    shared = anchors.groupBy("hash_range").applyInArrow(in_several, REPLY)
    candidates = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send_windows, MESSAGE)
    smaller = candidates.groupBy("hash_range").applyInArrow(in_smaller, REPLY)
    return dealt.groupBy("block").cogroup(shared.unionByName(smaller).groupBy("block")).applyInArrow(remove, result_type)


def _of_step(replies: pa.Table, step: int) -> dict[int, bytes]:
    rows = zip(*(replies[c].to_pylist() for c in ("step", "hash_range", "payload")))
    return {r: p for s, r, p in rows if s == step}


def _replies(step: int, key: tuple, messages: pa.Table, bits: np.ndarray, sizes: list[int]) -> pa.Table:
    """One packed answer for every message of a range."""
    ends = np.cumsum(sizes).tolist()
    name = key[0].as_py()
    return _table(
        REPLY,
        ((b, step, name, np.packbits(bits[e - n : e]).tobytes()) for b, n, e in zip(messages["block"].to_pylist(), sizes, ends)),
    )
