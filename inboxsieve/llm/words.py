"""Words and hashes of whole Arrow text columns, vectorised with numpy.

A word is a run of bytes other than space, tab, LF, VT, FF, CR (the pattern
``[^\\x20\\x09-\\x0D]+``; UTF-8 never uses those bytes inside a character).
Null text counts as empty.  Texts are handled in chunks of about one
megabyte, so memory follows the longest document, not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
BYTE_BASE = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse mod 2^64
WORD_BASE = _U(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * BYTE_BASE)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base^i`` and ``base^-i`` mod 2^64 for i < n at least."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = _U(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base), np.full(size, inverse)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if size <= 1 << 22:  # tables for one huge text are not kept
            _powers[int(base)] = have
    return have


def prefix_hash(values: np.ndarray, base: np.uint64):
    """A function ``(starts, ends) -> hash`` of any slices of ``values``."""
    n = len(values)
    up, down = _power_tables(base, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], dtype=np.uint64, out=sums[1:])

    def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    return of


class Texts:
    """The texts of one chunk: bytes, document offsets and words.

    ``starts``/``ends`` are byte positions of the words, ``first[d]`` to
    ``first[d + 1]`` are the words of document ``d``.
    """

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "").cast(pa.large_binary())
        self.n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + self.n + 1]
        buffer = column.buffers()[2]
        data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
        self.data = data[offsets[0]:offsets[-1]]
        self.offsets = offsets - offsets[0]
        size = len(self.data)
        space = IS_SPACE[self.data]
        cut = np.zeros(size + 1, dtype=bool)  # a word cannot run over this position
        cut[self.offsets] = True
        cut[1:] |= space
        cut[:-1] |= space
        self.starts = np.flatnonzero(cut[:-1] & ~space)
        self.ends = np.flatnonzero(cut[1:] & ~space) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.first)

    def word_hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        return prefix_hash(_BYTE_VALUE[self.data], BYTE_BASE)(self.starts, self.ends)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z in UTF-8 bytes; other characters stay."""
    upper = (data >= 0x41) & (data <= 0x5A)
    return data + upper.astype(np.uint8) * np.uint8(32)


def chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that a slice holds about CHUNK_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // CHUNK_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield batch.slice(a, b - a)
