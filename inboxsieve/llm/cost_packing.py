"""Packing of token ids into sequences, balanced by their cost.

Every document's ids, closed by an end id, are laid into sequences of at most
``capacity`` tokens.  A piece of n tokens costs ``n + n^2 / (6 * hidden)`` (the
linear part of a layer of width ``hidden`` and the attention of the piece to
itself, in tokens).  Pieces are taken in descending order of cost; each goes to
the sequence of lowest cost that has room for it.  A piece that fits nowhere is
cut: the sequence with the most room takes what it can, the rest is assigned
anew.  Documents longer than a sequence fill whole ones first.

A block holds about ``block_tokens`` tokens of one input partition, so packing
needs no shuffle, memory follows the block (or the longest document), and a
lost task packs its own rows again, alike if its input comes in the same order
(a file scan does; checkpoint other inputs first).  The sequences of a block
have together exactly as many places as it has tokens: whole ones, then one for
each binary digit of what remains.  So every sequence is full or, at the end of
a block, of a power of two tokens, and none needs padding.

Cases: a null or empty text has the end id only; equal rows are packed each for
itself, a null id as any other; special tokens' strings in a text become those
tokens; very long texts are encoded slice by slice; an empty table gives no
rows; columns other than id and text are not read.  Of equal pieces the
earlier goes first, of equally cheap sequences the first made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_files import ByteLevel
from .words import chunks

CAPACITY = 2048
BLOCK_TOKENS = 1 << 20
HIDDEN = 4096
END_ID = 1
OUT_ROWS = 4096


def capacities(tokens: int, capacity: int) -> list[int]:
    """Sequences with just as many places: whole ones, then powers of two."""
    whole, rest = divmod(tokens, capacity)
    return [capacity] * whole + [1 << k for k in range(capacity.bit_length(), -1, -1) if rest >> k & 1]


def assign(lengths: np.ndarray, capacity: int, hidden: int) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of all pieces of
    documents of the given lengths."""
    places = np.array(capacities(int(lengths.sum()), capacity), dtype=np.int64)
    room, cost = places.copy(), np.zeros(len(places))
    out: list[tuple[int, int, int, int, int]] = []
    price = lambda n: n + n * n / (6.0 * hidden)
    used = 0  # whole pieces cost most, so they come first, each to an empty sequence
    for d in np.flatnonzero(lengths >= capacity).tolist():
        for start in range(0, int(lengths[d]) - capacity + 1, capacity):
            out.append((d, start, capacity, used, 0))
            used += 1
    room[:used] = 0
    tail = lengths % capacity
    for d in np.argsort(-tail, kind="stable").tolist():
        start, left = int(lengths[d] - tail[d]), int(tail[d])
        while left:
            s = int(np.where(room >= left, cost, np.inf).argmin())
            if room[s] < left:  # no room for all of it
                s = int(room.argmax())
            n = min(left, int(room[s]))
            out.append((d, start, n, s, int(places[s] - room[s])))
            room[s] -= n
            cost[s] += price(n)
            start, left = start + n, left - n
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, hidden: int = HIDDEN,
         block_tokens: int = BLOCK_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (ids of its document before
    it), ``length``, ``ids`` (binary, little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id``, ``offset`` (place in the sequence) and
    ``sequence_tokens``."""
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity: a power of two")
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(ByteLevel(tokenizer))  # a file of a few MB
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]

    def emit(keys: list[pa.Array], ids: list[np.ndarray], first: int) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        pieces = np.array(assign(lengths, capacity, hidden), dtype=np.int64).reshape(-1, 5)
        pieces = pieces[np.lexsort((pieces[:, 4], pieces[:, 3]))]
        filled = np.bincount(pieces[:, 3], weights=pieces[:, 2]).astype(np.int64)
        key = pa.concat_arrays(keys)
        for at in range(0, len(pieces), OUT_ROWS):
            d, start, n, s, offset = pieces[at:at + OUT_ROWS].T
            data = [ids[k][a:a + m].tobytes() for k, a, m in zip(d.tolist(), start.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(d)), pa.array(start), pa.array(n), pa.array(data, pa.binary()), pa.array(lengths[d]),
                 pa.array(first + s), pa.array(offset), pa.array(filled[s])], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held.value.encode
        first = TaskContext.get().partitionId() << 40  # sequences of other partitions have other numbers
        keys, ids, size = [], [], 0
        for batch in chunks(batches, "text"):
            keys.append(batch.column("doc_id"))
            for t in batch.column("text").to_pylist():
                ids.append(np.array([*encode(t or ""), end_id], dtype="<u4"))
                size += len(ids[-1])
            if size >= block_tokens:
                yield from emit(keys, ids, first)
                first += len(capacities(size, capacity))
                keys, ids, size = [], [], 0
        if ids:
            yield from emit(keys, ids, first)

    key_type = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(rows, f"doc_id {key_type}, start bigint, length bigint, ids binary, doc_tokens bigint, "
                                 "sequence_id bigint, offset bigint, sequence_tokens bigint")
