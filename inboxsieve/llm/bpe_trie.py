"""Byte-level BPE encoding and decoding through a trie of distinct words.

Texts are split into pre-tokens ("words").  Each task inserts the distinct
words it meets, as bytes, into a trie whose edges are tokens: a node is a path
from the root, the beginning of some word, and holds the last token of that
path's encoding; the node above it is the path without that token.  The state
of a node is the one token that ends its path and may stand after the last
token of the node where it begins.  Two tokens may stand side by side when
merging their joined bytes gives those two tokens again.  So a prefix shared by
many words is encoded once, a node is made only where a token may end, and an
encoding is read off by walking the states back to the root.

Words of more than ``MAX_DEPTH`` bytes are not in the trie: their states stand
in a list by position while the word is encoded, so memory is linear in its
length.  What a task remembers is bounded in bytes (``MAX_NODES`` nodes and
pairs of tokens of about 160 bytes each, ``PIECE_BYTES`` of pieces, twice); what
is full is begun anew, which costs time but changes no result.

Cases: null and empty texts have no tokens and decode to the empty text; null
ids decode to the empty text; ids outside the vocabulary are left out; special
tokens in a text are encoded as such; repeated rows are encoded like any
other; other columns are kept (a column by the name of the result is
replaced).  The vocabulary is read on the driver from the given path and sent
to the tasks: its size is fixed (a few MB).
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks

#: The byte-level pre-tokenizer's pattern and its visible
#: characters for bytes (printable Latin-1 bytes stand for themselves, the
#: others follow from U+0100 on).
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

MAX_DEPTH = 48
MAX_NODES = 400_000  # of the trie, and as many pairs of tokens
PIECE_BYTES = 72 << 20
ENTRY_BYTES = 230  # of a piece and its ids, beside their characters


def _byte_of_char() -> dict[str, int]:
    table = {chr(b): b for b in PRINTABLE}
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return table | {chr(0x100 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Token bytes, ids and merges of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.digest = hashlib.sha256(raw).hexdigest()
        spec = json.loads(raw)
        of_char = _byte_of_char()
        to_bytes = lambda s: bytes(of_char[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.id_of = {to_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (order, joined token)
        for order, pair in enumerate(spec["model"]["merges"]):
            a, b = (to_bytes(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merge[self.id_of[a], self.id_of[b]] = order, self.id_of[a + b]
        #: the longest token with each ending of three bytes, and all sizes from there down
        sizes: dict[bytes, set[int]] = {}
        for b in self.id_of:
            sizes.setdefault(b[-3:], {1, 2}).add(len(b))
        self.longest = {end: max(of) for end, of in sizes.items() if len(end) > 2}
        self.sizes = {end: tuple(sorted(of, reverse=True)) for end, of in sizes.items() if len(end) > 2}
        self.size_of = {i: len(b) for b, i in self.id_of.items()}
        # how each token is made; joining in order of the merges, its parts are made before it
        self.made = {token: (order, *pair) for pair, (order, token) in self.merge.items()}
        order_of = lambda t: self.made[t][0] if t in self.made else -1
        self.plain = len(self.made) == len(self.merge) == len(self.id_of) - 256 and all(
            order > max(order_of(a), order_of(b)) for order, a, b in self.made.values())

    def stand_together(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes gives the two tokens again: no part
        at the end of ``left`` and part at the beginning of ``right`` may merge
        with each other before either is used up inside its own token."""
        if not self.plain:
            return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        a, used_a = left, 1 << 60
        while True:
            b, used_b = right, 1 << 60
            while True:
                order = self.merge.get((a, b))
                # of equal merges the left one goes first
                if order is not None and order[0] < used_a and order[0] <= used_b:
                    return False
                if b not in self.made:
                    break
                used_b, b, _ = self.made[b]
            if a not in self.made:
                return True
            used_a, _, a = self.made[a]

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, for the short strings of two tokens."""
        ids = [self.id_of[bytes([b])] for b in data]
        while len(ids) > 1:
            order, at = min((self.merge.get((ids[k], ids[k + 1]), (1 << 60, 0))[0], k) for k in range(len(ids) - 1))
            if order == 1 << 60:
                break
            ids[at:at + 2] = [self.merge[ids[at], ids[at + 1]][1]]
        return ids


class Pieces(dict):
    """Memo of pieces of text (no white space at either end, after ``before``),
    as the bytes of their 32-bit ids."""

    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before, self.size = encoder, before, 0

    def __missing__(self, piece: str) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        got = self.encoder.ids_of(self.before + piece)
        size = 4 * len(piece) + len(got) + ENTRY_BYTES
        if size < PIECE_BYTES >> 8:  # a long piece hardly comes again
            self.size += size
            if self.size > PIECE_BYTES:
                self.clear()
                self.size = size
            self[piece] = got
        return got


class Encoder:
    """The trie of one task: ``last`` has the last token of a node's path,
    ``joins`` which tokens may stand side by side."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = regex.compile(PATTERN)
        self.between = re.compile(r"(?<=\S) (?=\S)")
        self.special = (re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len)[::-1])) + ")")
                        if vocabulary.special else None)
        self.joins: dict[int, bool] = {}
        self.last = {b"": -1}  # of the root: at the beginning of a word
        self.bare, self.spaced = Pieces(self, ""), Pieces(self, " ")
        self.line_end = self.ids_of("\n")

    def may_follow(self, left: int, right: int) -> bool:
        """left -1: at the beginning of a word."""
        if left < 0:
            return self.v.plain or self.v.merged(self.v.bytes_of[right]) == [right]
        if len(self.joins) >= MAX_NODES:
            self.joins.clear()
        known = self.joins[left << 32 | right] = self.v.stand_together(left, right)
        return known

    def state(self, path: bytes) -> int:
        """The last token of a path's encoding; its node is made if it is not there."""
        id_of, last = self.v.id_of.get, self.last.get
        for size in self.v.sizes.get(path[-3:], (2, 1)):  # the longest token first
            token = id_of(path[-size:])
            if token is not None:
                above = path[:-size]
                left = last(above)
                if left is None:
                    left = self.state(above)
                fits = self.joins.get(left << 32 | token)
                if fits or (fits is None and self.may_follow(left, token)):
                    break
        self.last[path] = token
        return token

    def insert(self, data: bytes) -> list[int]:
        """Go to the word's node, make the nodes it lacks, and read the
        encoding off the states."""
        if len(data) > MAX_DEPTH:
            return self.long_word(data)
        ids, last, size_of = [], self.last.get, self.v.size_of
        while data:
            token = last(data)
            if token is None:
                token = self.state(data)
            ids.append(token)
            data = data[:-size_of[token]]
        ids.reverse()
        return ids

    def long_word(self, data: bytes) -> list[int]:
        longest, id_of, joins = self.v.longest.get, self.v.id_of.get, self.joins.get
        size, states = len(data), [-1]  # the last token by position
        for end in range(1, size + 1):
            # the longest token first
            for begin in range(max(0, end - longest(data[end - 3:end], 2)) if end > 2 else 0, end):
                token = id_of(data[begin:end])
                if token is not None:
                    left = states[begin]
                    fits = joins(left << 32 | token)
                    if fits or (fits is None and self.may_follow(left, token)):
                        break
            states.append(token)
        ids, size_of = [], self.v.size_of
        while size:
            token = states[size]
            ids.append(token)
            size -= size_of[token]
        ids.reverse()
        return ids

    def ids_of(self, text: str) -> bytes:
        if len(self.last) > MAX_NODES:
            self.last = {b"": -1}
        # letters only, or with a space before them: one word, and the pattern need not be asked
        words = [text] if text.isalpha() or text[1:].isalpha() and text[0] == " " else self.split.findall(text)
        ids = array("i")
        for word in words:
            ids.extend(self.insert(word.encode()))
        return ids.tobytes()

    def _encode(self, text: str) -> bytes:
        """A single space between other characters belongs to what follows it,
        a single line feed stands alone: there the text can be cut into pieces
        that are encoded independently.  Where a cut would touch other white
        space, only single spaces between other characters are cut at."""
        spaced, bare = self.spaced.__getitem__, self.bare.__getitem__
        try:
            lines = (line.split(" ") for line in text.split("\n"))
            return self.line_end.join([b"".join([bare(p[0]), *map(spaced, p[1:])]) for p in lines])
        except TypeError:  # a piece with white space at an end
            first, *others = self.between.split(text)
            return b"".join([self.ids_of(first), *(spaced(p) or self.ids_of(" " + p) for p in others)])

    def encode(self, text: str) -> np.ndarray:
        out = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(np.int32(self.v.special[part]).tobytes())
            elif part:
                out.append(self._encode(part))
        return np.frombuffer(b"".join(out), dtype=np.int32)


def _with(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    kept = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()))
    return kept, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids (``array<int>``) of every whole text."""
    base, schema = _with(docs, ids)
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)  # of this task: an idle worker holds nothing for it
        for batch in chunks(batches, text):
            got = [encoder.encode(t or "") for t in batch.column(text).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            flat = np.concatenate([*got, np.zeros(0, dtype=np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, ids])

    return base.mapInArrow(rows, f"{schema}, `{ids}` array<int>")


class Decoder:
    """All token bytes in one array; texts are gathered from it at once."""

    def __init__(self, bytes_of: dict[int, bytes]):
        size = np.zeros(max(bytes_of, default=-1) + 1, dtype=np.int64)
        size[list(bytes_of)] = [len(b) for b in bytes_of.values()]
        self.size, self.start = size, np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(bytes_of[k] for k in sorted(bytes_of)), dtype=np.uint8)

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of the lists that end at ``ends``."""
        known = (flat >= 0) & (flat < len(self.size))
        flat = np.where(known, flat, 0)
        n = self.size[flat] * known
        upto = np.concatenate([[0], np.cumsum(n)])
        data = self.data[np.repeat(self.start[flat] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        at = upto[np.concatenate([[0], ends])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its token ids; bytes that are not UTF-8 become
    U+FFFD."""
    base, schema = _with(df, text)
    held = df.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer).bytes_of)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(ids)
                flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                got = decoder.decode(flat, np.cumsum(n.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())],
                                                 [*part.schema.names, text])

    return base.mapInArrow(rows, f"{schema}, `{text}` string")
