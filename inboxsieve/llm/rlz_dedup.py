"""Substring deduplication by relative Lempel-Ziv parsing.

A passage is a duplicate if ``window`` (50) or more consecutive words of it
also stand in a document with a smaller id.  Every document is a reference for
the later ones.  It is cut into overlapping *blocks* by content: each window of
50 words owns the 16-word gram in it with the least hash (its anchor), and the
consecutive windows with one anchor form a block.  Equal passages are cut
equally, whatever stands around them, so the anchor routes a document's blocks
to the reference blocks that may match, and no document meets another:

1. *Index.*  For every anchor that several documents have, and for every
   (anchor, block content) where an anchor has several contents, the smallest
   id that has it and where it stands there.
2. *Matches.*  Every block is looked up; one found under a smaller id is a
   match with a place of that reference.
3. *Boundaries.*  Where a match begins or ends, a block's content is new
   although its anchor is known, and part of its windows may still match.  Only
   there, windows are looked up one by one - and only those of a block
   content's first document, as a later document with the same content is
   covered by its block already.  Windows seen there are indexed the same way.
4. *Parse.*  The matches of a document come together; those that continue each
   other in one reference are one longer match.  The document is then factored
   greedily from left to right: at each word, the match that reaches furthest is
   the next factor (``factors``: its words, the reference and the place in it);
   words that no match covers are literals.  Every match has 50 words at least,
   and windows over factor boundaries were looked up in step 3, so the factors
   cover just the duplicate spans, which are removed.

A block is matched with the smallest id that has it, so a factor is the longest
one against the references found so, not against all that hold it; this does
not change which words are covered.

The spans are exact: each window is compared by its whole content (64-bit
hashes of the anchor and of the content), against every document.  Index
entries and windows are combined before each shuffle, so a passage that very
many documents share is one entry a task; the index is checkpointed, so that
in the joins back, which are many to one, adaptive execution can split the
documents' side.

Cases: a null or empty text has no words; a document with a null id loses
nothing and is no reference; equal ids are not smaller than each other, so
repeated rows keep their words; rows with one id but different texts are
judged separately (a factor's reference may be any of them); an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import checkpoint_dir
from .words import WORD_BASE, Texts, chunks, mix, prefix_hash

WINDOW, GRAM = 50, 16
_U = np.uint64


def least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the position of the (leftmost) least of ``width``
    values; windows are doubled until two of them overlap to the width."""
    v, at = values, np.arange(len(values))

    def joined(v, at, apart):
        take = v[apart:] < v[:-apart]
        return np.where(take, v[apart:], v[:-apart]), np.where(take, at[apart:], at[:-apart])

    have = 1
    while have * 2 <= width:
        v, at = joined(v, at, have)
        have *= 2
    if have < width:
        v, at = joined(v, at, width - have)
    return at


def blocks_of(t: Texts, hashes: np.ndarray, window: int, gram: int):
    """``(anchor, content, doc, start, n)`` of every block of a chunk: its
    windows start at word ``start`` of the document and the ``n - 1`` after it."""
    none = np.zeros(0, dtype=np.int64)
    if len(hashes) < window:
        return none, none, none, none, none
    of = prefix_hash(hashes, WORD_BASE)
    begin = np.arange(len(hashes) - gram + 1)
    grams = of(begin, begin + gram)
    doc = t.doc_of_word()
    inside = np.flatnonzero(doc[window - 1:] == doc[:len(doc) - window + 1])
    if not len(inside):
        return none, none, none, none, none
    anchor = least_positions(grams, window - gram + 1)[inside]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.concatenate([first, [len(inside)]]))
    start, anchor = inside[first], anchor[first]
    content = mix(of(start, start + n - 1 + window) + (anchor - start).astype(np.uint64) * WORD_BASE)
    owner = doc[start]
    return grams[anchor].view(np.int64), content.view(np.int64), owner, start - t.first[owner], n


def _blocks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    kind = docs.schema["_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            t = Texts(batch.column("_text"))
            anchor, content, doc, start, n = blocks_of(t, t.word_hashes(), window, gram)
            if len(anchor):
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(content), batch.column("_id").take(at), batch.column("_row").take(at),
                     pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["anchor", "content", "_id", "_row", "start", "n"])

    return docs.mapInArrow(rows, f"anchor bigint, content bigint, _id {kind}, _row int, start int, n int")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """The windows of the listed blocks, one row each."""
    kind = texts.schema["_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            t = Texts(batch.column("_text"))
            lists = batch.column("blocks")
            doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            anchor, start, n = (np.asarray(x) for x in lists.flatten().flatten())
            reps = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(reps)) - np.repeat(np.cumsum(n) - n, n)
            doc, start = doc[reps], start[reps] + within
            at = t.first[doc] + start
            seen = prefix_hash(t.word_hashes(), WORD_BASE)(at, at + window)
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[reps]), pa.array(seen.view(np.int64)), batch.column("_id").take(rows),
                 batch.column("_row").take(rows), pa.array(start.astype(np.int32))],
                ["anchor", "content", "_id", "_row", "start"])

    return texts.mapInArrow(rows, f"anchor bigint, content bigint, _id {kind}, _row int, start int")


def parse(start: np.ndarray, end: np.ndarray, refs: list, ref_start: np.ndarray) -> list[tuple[int, int, object, int]]:
    """The greedy factors ``(start, end, reference, its start)`` of a document
    with these matches (words ``start`` to ``end`` stand in ``refs`` from
    ``ref_start`` on)."""
    whole: dict[tuple, list[list[int]]] = {}  # matches by reference and displacement
    for k in np.argsort(start, kind="stable").tolist():
        a, b = int(start[k]), int(end[k])
        runs = whole.setdefault((refs[k], int(ref_start[k]) - a), [])
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    longest = sorted((a, -b, at, shift) for at, ((_, shift), runs) in enumerate(whole.items()) for a, b in runs)
    names = [ref for ref, _ in whole]
    out, here, k, best = [], 0, 0, None
    while True:
        while k < len(longest) and longest[k][0] <= here:
            if best is None or longest[k][1] < best[1]:
                best = longest[k]
            k += 1
        if best is not None and -best[1] > here:
            out.append((here, -best[1], names[best[2]][0], here + best[3]))
            here = -best[1]
        elif k < len(longest):
            here = longest[k][0]  # literals up to there
        else:
            return out


def _kept(texts: DataFrame) -> DataFrame:
    kind = texts.schema["_id"].dataType.simpleString()
    factor = f"array<struct<start:int,end:int,ref_id:{kind},ref_start:int>>"
    key_type = to_arrow_type(texts.schema["_id"].dataType)
    factor_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref_id", key_type), ("ref_start", pa.int32())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            n_words, n_removed, kept, merged, factors = [], [], [], [], []
            for text, matches in zip(batch.column("_text"), batch.column("matches"), strict=True):
                words = (text.as_py() or "").encode().split()  # ASCII white space only, as it is bytes
                parsed = []
                if matches.is_valid:
                    start, end, lo, ref = matches.values.flatten()
                    ref = np.asarray(ref)
                    parsed = parse(np.asarray(start), np.asarray(end), list(zip(lo.to_pylist(), (ref >> 32).tolist(), strict=True)),
                                   ref & 0xFFFFFFFF)
                factors.append([{"start": a, "end": b, "ref_id": r, "ref_start": q} for a, b, r, q in parsed])
                gone = np.zeros(len(words), dtype=bool)
                for a, b, _, _ in parsed:
                    gone[a:b] = True
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                merged.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                if n_removed[-1]:
                    words = [words[k] for k in np.flatnonzero(~gone)]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array(factors, factor_type), pa.array(kept, pa.string())],
                ["_id", "n_words", "n_removed", "spans", "factors", "kept"])

    return texts.mapInArrow(rows, f"_id {kind}, n_words bigint, n_removed bigint, "
                                  f"spans array<struct<start:int,end:int>>, factors {factor}, kept string")


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                     gram: int = GRAM) -> DataFrame:
    """``<doc_id>, n_words, n_removed, spans, factors, kept`` of every row:
    the removed word ranges (end exclusive), the factors that they consist of
    (``start, end, ref_id, ref_start``: words ``start`` to ``end`` stand in
    ``ref_id`` from word ``ref_start`` on), and the kept words joined by one
    space."""
    checkpoint_dir(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("_id"), F.hash(text).alias("_row"), F.col(text).cast("string").alias("_text"))
    blocks = _blocks(docs, window, gram)
    # the row and the word where a block begins, in one number
    place = F.shiftleft(F.col("_row").cast("long"), 32).bitwiseOR(F.col("start").cast("long"))
    lowest = (F.min("_id").alias("lo"), F.min_by(place, "_id").alias("ref"))

    # only anchors in several documents; where all their blocks are alike, the smallest id tells all
    several = (blocks.groupBy("anchor").agg(*lowest, F.max("_id").alias("hi"),
                                            (F.min("content") != F.max("content")).alias("edge"))
               .where("lo < hi").drop("hi").checkpoint())
    shared = blocks.join(several, "anchor").where("edge OR lo < _id").checkpoint()
    edges = shared.where("edge").drop("edge", "lo", "ref")
    index = edges.groupBy("anchor", "content").agg(*lowest).checkpoint()
    edges = edges.join(index, ["anchor", "content"])
    end = (F.col("start") + F.col("n") + (window - 1)).alias("end")
    key = F.struct("_id", "_row").alias("_k")
    matches = (shared.where("NOT edge").select(key, "start", end, "lo", "ref")
               .unionByName(edges.where("lo < _id").select(key, "start", end, "lo", "ref")))

    # the texts are dealt out once, by id and row, for the windows at the boundaries and for the result
    placed = docs.select(key, "_text").repartition("_k")
    listed = (edges.where("lo = _id").groupBy(key)
              .agg(F.collect_list(F.struct("anchor", "start", "n")).alias("blocks")))
    windows = _windows(placed.join(listed, "_k").select("_k._id", "_k._row", "_text", "blocks"), window)
    least = (windows.groupBy("anchor", "content").agg(*lowest, F.max("_id").alias("hi"))
             .where("lo < hi").drop("hi"))
    again = (windows.join(least, ["anchor", "content"]).where("lo < _id")
             .select(key, "start", (F.col("start") + window).alias("end"), "lo", "ref"))
    found = matches.unionByName(again).groupBy("_k").agg(
        F.collect_list(F.struct("start", "end", "lo", "ref")).alias("matches"))
    texts = placed.join(found, "_k", "left").select("_k._id", "_text", "matches")
    return _kept(texts).withColumnRenamed("_id", doc_id)
