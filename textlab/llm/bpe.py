"""BPE encoding and decoding by a prefix-sharing trie.

The last token of every prefix settles an encoding: the encoding of a prefix is that of a shorter prefix
and one more token, and exactly one token fits. Distinct words go into a trie, a depth-first walk carries
the last token from node to node, and prefixes that words share are worked out once.
"""

from __future__ import annotations

import itertools
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import release

KNOWN_CHUNKS = 200_000  # encodings that a task remembers; forgetting only costs time
KNOWN_WORDS = 400_000
KNOWN_PAIRS = 400_000
RESTING = 60_000  # encodings that an idle worker keeps
TRIE_BYTES = 256  # longer words are walked alone, so that the trie stays small
SLICE_BYTES = 4 << 20
END = -1
NEVER = 1 << 60
BYTES = [bytes((b,)) for b in range(256)]

PLAIN = re.compile(r"[!-~À-įı-ɏ]+")
PLAIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ɏ]+")


def first(known: dict, n: int) -> dict:
    return known if len(known) <= n else dict(itertools.islice(known.items(), n))


def chunks_of(text: str) -> list[str]:
    """Cut at white space. Never inside a token: the tokenizer drops white space and no token spans it."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # Python's white space, not the tokenizer's
        return re.findall("[^ \t\n\r]+", text)
    return text.split()


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, back to the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TrieEncoder:
    """Encodes like the tokenizer file it is given: a word BPE with an end-of-word suffix."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)  # for normalising and cutting unusual text
        described = json.loads(definition)
        model, suffix = described["model"], described["model"]["end_of_word_suffix"]
        vocab, letters = model["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # Token of a spelling inside a word; -1 where it is only the beginning of one.
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.length = [0] * (max(vocab.values()) + 1)
        for token, number in vocab.items():
            if number in self.special.values():
                continue
            ends = token.endswith(suffix)
            spelled = bytes(letters[c] for c in (token[: -len(suffix)] if ends else token))
            (self.final if ends else self.inner)[spelled] = number
            self.length[number] = len(spelled)
            for end in range(1, len(spelled)):
                self.inner.setdefault(spelled[:end], -1)
        # What each pair becomes, when, and of what each token was made.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for when, (left, right) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            if max(self.parts.get(a, (0, 0, -1))[2], self.parts.get(b, (0, 0, -1))[2]) >= when or made in self.parts:
                raise ValueError("merges are not in the order of making")
            self.rank[a, b] = when
            self.parts[made] = (a, b, when)
        self.pairs: dict[int, bool] = {}
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        named = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.names = [named.get(i, "") for i in range(max(named) + 1)]
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stood at one end while the token was being made, each with the time it was used up."""
        known = self.edges.get((token, side))
        if known is None:
            known, now, until = [], token, NEVER
            while True:
                known.append((now, until))
                if now not in self.parts:
                    break
                left, right, until = self.parts[now]
                now = right if side else left
            self.edges[token, side] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the two stay apart: no merge across their border comes before both its sides are used up.

        At the same time the pair further left goes first.
        """
        for a, until_a in self._edge(left, 1):
            for b, until_b in self._edge(right, 0):
                when = self.rank.get((a, b))
                if when is not None and when < until_a and when <= until_b:
                    return False
        return True

    def _fits(self, left: int, right: int) -> bool:
        known = self.pairs.get(left << 20 | right)
        if known is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            known = self.pairs[left << 20 | right] = self.fits(left, right)
        return known

    def _step(self, text: bytes, end: int, states: list[int], lows: list[int]) -> None:
        """Set the last token of ``text[:end]``, given that of every shorter prefix.

        ``lows`` is where the longest spelling starts that ends here and begins a token; it never moves back.
        """
        start = lows[end - 1]
        tokens, pairs = self.inner, self.pairs
        token = tokens.get(text[start:end])
        while token is None:
            start += 1
            token = tokens.get(text[start:end])
        lows[end] = start
        while token is None or token < 0 or start and not (
            pairs.get(states[start] << 20 | token) or self._fits(states[start], token)
        ):
            start += 1
            token = tokens.get(text[start:end])
        states[end] = token

    def _ids(self, word: bytes, states: list[int], lows: list[int]) -> bytes:
        """Ids of a word whose prefixes are settled."""
        end = len(word)
        start = lows[end - 1]
        token = self.final.get(word[start:end])
        while token is None or start and not self._fits(states[start], token):
            start += 1
            token = self.final.get(word[start:end])
        if not start:
            return array("I", (token,)).tobytes()
        ids = [token]
        while start:
            token = states[start]
            ids.append(token)
            start -= self.length[token]
        ids.reverse()
        return array("I", ids).tobytes()

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of each distinct word, as unsigned 32-bit integers."""
        out: dict[bytes, bytes] = {}
        root: dict = {}
        for word in words:
            if len(word) > TRIE_BYTES:
                states, lows = [0] * len(word), [0] * len(word)
                for end in range(1, len(word)):
                    self._step(word, end, states, lows)
                out[word] = self._ids(word, states, lows)
                continue
            node = root
            for byte in word:
                below = node.get(byte)
                if below is None:
                    below = node[byte] = {}
                node = below
            node[END] = word
        # Depth first: states[d] is the last token of the path's first d bytes.
        states, lows = [0] * (TRIE_BYTES + 1), [0] * (TRIE_BYTES + 1)
        stack = [(b"", root)]
        while stack:
            path, node = stack.pop()
            word = node.get(END)
            if word is not None:
                out[word] = self._ids(word, states, lows)
                if len(node) == 1:
                    continue
            if path:
                self._step(path, len(path), states, lows)
            for byte, below in node.items():
                if byte != END:
                    stack.append((path + BYTES[byte], below))
        return out

    def pieces(self, chunk: str) -> list[bytes | int]:
        """The words of a chunk, normalised; a special token is its id."""
        if self.at_special and "<" in chunk and self.at_special.search(chunk):
            parts = self.at_special.split(chunk)
            return [w for i, p in enumerate(parts) for w in ([self.special[p]] if i % 2 else self.pieces(p))]
        if PLAIN.fullmatch(chunk):
            return [p.encode() for p in PLAIN_PIECE.findall(chunk.lower())]
        letters = _LETTERS
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(letters[c] for c in p) for p, _ in cut]

    def learn(self, wanted: set[str]) -> dict[str, bytes]:
        """Encodings of at least these chunks. What is forgotten was not wanted again."""
        new = wanted.difference(self.chunks)
        if len(self.chunks) + len(new) > KNOWN_CHUNKS:
            self.chunks = {c: self.chunks[c] for c in wanted if c in self.chunks}
        cut = {c: self.pieces(c) for c in new}
        words = {w for ws in cut.values() for w in ws if isinstance(w, bytes)}
        unknown = words.difference(self.words)
        if len(self.words) + len(unknown) > KNOWN_WORDS:
            self.words = {w: self.words[w] for w in words if w in self.words}
        self.words.update(self.encode_words(unknown))
        known = self.words
        for chunk, parts in cut.items():
            self.chunks[chunk] = (
                known[parts[0]] if len(parts) == 1 and isinstance(parts[0], bytes)
                else b"".join([known[w] if isinstance(w, bytes) else array("I", [w]).tobytes() for w in parts])
            )
        return self.chunks

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        cut = [chunks_of(t or "") for t in texts]
        known = self.learn({c for t in cut for c in t})
        return [b"".join([known[c] for c in t]) for t in cut]

    def rest(self) -> None:
        """Keep what was learned first, which are the frequent chunks, for the worker's next task."""
        self.chunks = first(self.chunks, RESTING)
        self.words = first(self.words, RESTING)
        self.pairs = first(self.pairs, RESTING)
        release()

    def decode_batch(self, packed: list[bytes | None]) -> list[str | None]:
        """The tokens of packed ids joined by one space; null stays null."""
        name = self.names.__getitem__
        return [None if p is None else " ".join(map(name, memoryview(p).cast("I"))) for p in packed]


_LETTERS = byte_letters()
_ENCODERS: dict[int, TrieEncoder] = {}


def _encoder(definition: str) -> TrieEncoder:
    """One per Python worker, kept over tasks."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TrieEncoder(definition)
    return _ENCODERS[key]


def definition_of(path: str) -> str:
    """The tokenizer file, read by the driver; a few MB that go to every task."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take about ``limit`` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    part = np.cumsum(sizes) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(sizes)]):
        yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id and ``ids``: the token ids of every whole text, packed as little-endian unsigned 32-bit integers.

    ``decoded`` adds what the ids stand for, decoded in the same task. A null text has no ids and decodes to
    an empty text. Row-local, no shuffle; other columns of ``docs`` are not read.
    """
    definition = definition_of(path)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType(
        [rows.schema[id_col], T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decoded
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition)
        for batch in batches:
            for part in slices(batch, 1):
                ids = encoder.encode_batch(part.column(1).to_pylist())
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array(encoder.decode_batch(ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        encoder.rest()

    return rows.mapInArrow(work, schema)


def decode(packed: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``decoded``: the tokens, special ones too, that packed ids stand for, joined by one space. Null stays null."""
    definition = definition_of(path)
    rows = packed.select(F.col(id_col), F.col(ids_col).alias("__ids"))
    schema = T.StructType([rows.schema[id_col], T.StructField("decoded", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = pa.array(_encoder(definition).decode_batch(part.column(1).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=schema.names)

    return rows.mapInArrow(work, schema)
