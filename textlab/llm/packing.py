"""Packing documents into training sequences: shortest pack first over the length histogram.

Documents become token ids and are cut into pieces of at most the sequence length. Only the histogram of
piece lengths reaches the driver. There the lengths are placed longest first, each time into the shortest
pack, and packs of equal make-up are counted, not listed. The patterns go back to the pieces by their
rank among the pieces of equal length.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.bpe import PLAIN, PLAIN_PIECE, byte_letters, definition_of, first, slices
from textlab.llm.common import release
from textlab.plans.durable import scratch_path

SEQUENCE = 4096
END_ID = 2
KNOWN_WORDS = 80_000  # encodings in a generation of a task's memory; forgetting only costs time
RESTING_WORDS = 40_000  # that an idle worker keeps
JOINED = 2_000
SLICE_BYTES = 4 << 20  # of texts that are encoded together
PLAIN_CHUNK = f"^{PLAIN.pattern}$"
PLAIN_WORDS = re.compile(PLAIN_PIECE.pattern.replace("[^", "[^\\n") + "|\n")
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Memory:
    """What was worked out lately, in two generations: what is in use survives when the older one is dropped."""

    def __init__(self, limit: int):
        self.limit = limit
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def unknown(self, wanted: set[str]) -> list[str]:
        """Those that have to be worked out; the others are in ``now`` afterwards."""
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now
        missing = wanted.difference(self.now)
        found = {w: self.before[w] for w in missing if w in self.before}
        self.now.update(found)
        return list(missing.difference(found))

    def rest(self, kept: int) -> None:
        """Keep the frequent part, what both generations have used, and as much of the rest as there is room for."""
        often = {k: v for k, v in self.now.items() if k in self.before}
        self.now, self.before = first(often | self.now, kept), {}


class LibraryEncoder:
    """The tokenizers library's model on distinct words, for a word BPE file with an end-of-word suffix.

    Texts are cut at white space, distinct chunks into words, and distinct words are encoded by the model, many in
    a call: only a word's last token has the suffix, which tells where the next one begins. Arrow arrays of packed
    ids then go back from words to chunks and from chunks to texts. Words are remembered from slice to slice.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        described = json.loads(definition)
        suffix = described["model"]["end_of_word_suffix"]
        self.definition = definition
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        bare = dict.fromkeys(("normalizer", "pre_tokenizer", "post_processor", "decoder", "truncation", "padding"))
        self.model = Tokenizer.from_str(json.dumps(described | bare | {"added_tokens": []}))
        vocab = described["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(suffix) and i not in self.special.values()]] = True
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        if any(letter not in vocab or letter + suffix not in vocab for letter in self.letters.values()):
            raise ValueError("the vocabulary does not spell every byte")
        self.words = Memory(KNOWN_WORDS)

    @cached_property
    def library(self):
        """The whole tokenizer, for normalising and cutting unusual chunks; without its vocabulary, which that does not take."""
        from tokenizers import Tokenizer

        described = json.loads(self.definition)
        letters = list(self.letters.values())
        model = {"type": "BPE", "vocab": {letter: i for i, letter in enumerate(letters)}, "merges": []}
        return Tokenizer.from_str(json.dumps(described | {"model": model, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None}))

    def _lettered(self, word: str) -> str:
        """A word in the letters that stand for its bytes."""
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def _unusual(self, chunk: str) -> list[str | int]:
        """Words of any chunk, as the library cuts it; a special token is its id."""
        if self.at_special and self.at_special.search(chunk):
            parts = self.at_special.split(chunk)
            return [w for i, p in enumerate(parts) for w in ([self.special[p]] if i % 2 else self._unusual(p))]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def _encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for at in range(0, len(words), JOINED):
            group = words[at : at + JOINED]
            (made,) = self.model.encode_batch_fast([group], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(made.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            packed = ids.tobytes()
            yield from zip(group, map(packed.__getitem__, map(slice, [0, *ends], ends)), strict=True)

    def _ids(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words, in their letters."""
        unknown = self.words.unknown(set(words))
        known = self.words.now
        known.update(self._encode_words(unknown))
        return [known[w] for w in words]

    def _plain(self, chunks: pa.Array) -> pa.Array:
        """Packed ids of chunks whose letters can all be cut in one go."""
        if not len(chunks):
            return pa.array([], pa.large_binary())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), "\n")[0].as_py()
        found = pa.array(PLAIN_WORDS.findall(joined.lower() + "\n"), pa.large_string()).dictionary_encode()
        words = found.dictionary.to_pylist()
        own = iter(self._ids([self._lettered(w) for w in words if w != "\n"]))
        packed = pa.array([b"" if w == "\n" else next(own) for w in words], pa.large_binary())
        data, ends = _flat(packed.take(found.indices))
        return _joined(data, ends[1:][found.indices.to_numpy() == words.index("\n")])

    def _rest(self, chunks: pa.Array) -> pa.Array:
        """Packed ids of all other chunks."""
        cut = [self._unusual(c) for c in chunks.to_pylist()]
        words = list({w for c in cut for w in c if isinstance(w, str)})
        ids = dict(zip(words, self._ids(words)))
        packed = [b"".join([ids[w] if isinstance(w, str) else array("I", [w]).tobytes() for w in c]) for c in cut]
        return pa.array(packed, pa.large_binary())

    def encode(self, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
        """All ids, packed, and the places in them where each text begins and the last one ends; a null text has none."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        found = cut.flatten().dictionary_encode()
        chunks = found.dictionary
        plain = pc.match_substring_regex(chunks, PLAIN_CHUNK)
        for mark in self.special:
            plain = pc.and_not(plain, pc.match_substring(chunks, mark))
        is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        rest = self._rest(chunks.filter(pc.invert(plain)))
        ids = pa.concat_arrays([self._plain(chunks.filter(plain)), rest])
        place = np.where(is_plain, np.cumsum(is_plain), len(chunks) - len(rest) + np.cumsum(~is_plain)) - 1
        data, ends = _flat(ids.take(pa.array(place[found.indices.to_numpy()])))
        return data, ends[cut.offsets.to_numpy()]


def _flat(values: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of a binary array in a row, and its offsets."""
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return values.buffers()[2] or pa.py_buffer(b""), ends


def _joined(data: pa.Buffer, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), data])


_ENCODERS: dict[int, LibraryEncoder] = {}


def _encoder(definition: str) -> LibraryEncoder:
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(definition)
    return _ENCODERS[key]


def token_pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``size`` ids of every document, its ids being those of the text and ``end_id``.

    ``with_ids`` adds the packed ids. A null text is an empty one, so each document has one piece at least.
    """
    definition = definition_of(path)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    last = array("I", [end_id]).tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches):
        encoder = _encoder(definition)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                made: list[tuple] = []
                packed, at = encoder.encode(part.column(1))
                packed = memoryview(packed)
                for doc, a, b in zip(part.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                    ids = bytes(packed[a:b]) + last
                    for at in range(0, len(ids), 4 * size):
                        piece = ids[at : at + 4 * size]
                        made.append((doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece))
                columns = list(zip(*made))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
                extra = [pa.array(columns[5], pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(arrays + extra, names=names + ["ids"] * with_ids)
                del made, columns, arrays, extra, packed
                release()
        encoder.words.rest(RESTING_WORDS)
        release()

    return rows.mapInArrow(cut, PIECES + ", ids binary" * with_ids)


@dataclass
class Placements:
    """Runs of pieces by length and rank: piece ``rank`` of a run goes to sequence ``first + rank - start`` at ``offset``."""

    length: np.ndarray
    start: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int


def pack_histogram(counts: dict[int, int], size: int = SEQUENCE) -> Placements:
    """Shortest pack first: longest lengths first, each into the pack that is shortest so far, else a new one.

    A pattern is a run of sequences of equal make-up. Placing splits one pattern at most for each length, and new
    ones are filled with as many pieces of a length as they hold, so the number of patterns follows the number of
    lengths and not that of documents.
    """
    shortest: list[tuple[int, int, int]] = []  # used, first sequence, sequences
    placed: list[tuple[int, int, int, int]] = []
    sequences = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and shortest and shortest[0][0] + length <= size:
            used, first, many = heapq.heappop(shortest)
            taken = min(left, many)
            if taken < many:
                heapq.heappush(shortest, (used, first + taken, many - taken))
            placed.append((length, rank, first, used))
            heapq.heappush(shortest, (used + length, first, taken))
            rank, left = rank + taken, left - taken
        # None fits: a new sequence is the shortest until it is full of this length.
        full, over = divmod(left, size // length)
        for many, each in ((full, size // length), (1, over)):
            if many and each:
                for turn in range(each):
                    placed.append((length, rank + turn * many, sequences, turn * length))
                heapq.heappush(shortest, (each * length, sequences, many))
                rank, sequences = rank + each * many, sequences + many
    columns = np.array(sorted(placed), np.int64).reshape(-1, 4).T
    return Placements(*columns, sequences)


def with_rank(pieces: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0) among the pieces of equal length.

    Pieces of a length are dealt into blocks, about the root of their number, ranked there, and moved on
    by what the blocks before hold. So a length that a third of all pieces share is many small sorts, and
    the table of offsets stays as small.
    """
    blocks = max(1, math.isqrt(pieces.count()))
    dealt = pieces.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "__block").count().select(
        "length", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy("length", "__block").orderBy(*order)
    return (
        dealt.withColumn("__turn", F.row_number().over(inside))
        .join(offsets, ["length", "__block"])
        .withColumn("rank", F.col("__before") + F.col("__turn") - 1)
        .drop("__block", "__before", "__turn")
    )


def pack(pieces: DataFrame, order: list[str], size: int = SEQUENCE) -> DataFrame:
    """Add sequence_id (gapless from 0) and offset to pieces that have a ``length`` of at most ``size``.

    ``pieces`` is read several times, so hand over a stored table. ``order`` tells pieces apart; equal
    ones are interchangeable.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row per length, so ``size`` at most
    made = pack_histogram(counts, size)
    longest = max(counts.values(), default=0) + 1
    keys = made.length * longest + made.start
    kind = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        ranks = rank.to_numpy(zero_copy_only=False)
        run = np.searchsorted(keys, length.to_numpy(zero_copy_only=False) * longest + ranks, "right") - 1
        return pa.StructArray.from_arrays(
            [pa.array(made.first[run] + ranks - made.start[run]), pa.array(made.offset[run])], ["sequence_id", "offset"]
        )

    place.__annotations__ = {"length": pa.Array, "rank": pa.Array, "return": pa.Array}
    placed = with_rank(pieces, order).withColumn("__place", F.arrow_udf(place, kind)("length", "rank"))
    return placed.select(*pieces.columns, "__place.sequence_id", "__place.offset")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece of a document.

    Each id of a document lies in exactly one piece. Null ids and repeated rows are packed like any other
    row; an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    stored = scratch_path(docs.sparkSession, "pieces")
    token_pieces(docs, path, id_col, text_col, size).write.parquet(stored)
    pieces = docs.sparkSession.read.parquet(stored)
    return pack(pieces, ["doc_id", "start", "ids_crc32", "doc_tokens"], size)
