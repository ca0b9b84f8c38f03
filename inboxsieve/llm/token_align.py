"""Alignment of the tokens of two tokenizers, and corpus-wide counts of the
pairs that end together.

Both tokenizers cut the same bytes (a space and the text).  Per batch, pandas'
``merge_asof``, keyed by document, finds for each token start the other side's
covering token, in both directions; the union are the overlaps.  Overlapping
tokens with equal ends are linked, and each equal end closes a group.

A link's count is the number of links of its id pair in the corpus.  The
documents of about ``BLOCK_BYTES`` of text are a block: it asks once for each
id pair that it holds, with how often.  These rows are summed to the corpus'
counts (map-side first) and joined with them; a block's documents and its
answers meet in one cogroup, whose size is that of a block.  The counts are
checkpointed, so that the join's other side can be split where a pair stands in
all blocks.  Only the highest count per id of the second vocabulary is
broadcast: one row per entry of the vocabulary file at most.

Cases: null and empty texts, and texts that the joined tokens of either side do
not give back (a text with U+2581), have no tokens: all numbers 0, ``groups``
empty.  Special tokens' strings are plain text.  Rows are aligned one by one:
equal rows count each, a null id is kept.  Very long texts are encoded slice
by slice and are a block of their own.  An empty table gives no rows; columns
other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .token_files import ByteLevel, Piece
from .words import CHUNK_BYTES, chunks

BLOCK_BYTES = 4 * CHUNK_BYTES


class Sides:
    """Both vocabularies in a task: token bytes, their sizes, and the ids
    written out with what follows them in the text of the groups."""

    def __init__(self, a: ByteLevel, b: Piece):
        self.a, self.b = a, b
        self.bytes_a, self.bytes_b = a.token_bytes(), b.token_bytes()
        self.size_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.width = max(len(self.size_a), len(self.size_b))
        self.written = [f"{i}{end}" for end in ",|;" for i in range(self.width)]

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        want = b" " + text.encode()
        a, b = self.a.encode(" " + text, special=False), self.b.encode(text)
        same = (b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b)))
        return (a, b) if same else ([], [])


def covering(left: np.ndarray, right: np.ndarray, left_doc: np.ndarray, right_doc: np.ndarray) -> np.ndarray:
    """For each token of one side, by its start: the other side's token that
    covers this place."""
    tokens = pd.DataFrame({"at": left, "doc": left_doc})
    others = pd.DataFrame({"at": right, "doc": right_doc, "other": np.arange(len(right))})
    return pd.merge_asof(tokens, others, on="at", by="doc")["other"].to_numpy(dtype=np.int64)


class Aligned:
    """The tokens of some documents, overlaps, links and groups."""

    def __init__(self, sides: Sides, texts: list[str | None]):
        both = [sides.encode(t) for t in texts]
        self.n_a = np.array([len(a) for a, _ in both], dtype=np.int64)
        self.n_b = np.array([len(b) for _, b in both], dtype=np.int64)
        self.ids_a = np.fromiter((i for a, _ in both for i in a), dtype=np.int64, count=int(self.n_a.sum()))
        self.ids_b = np.fromiter((i for _, b in both for i in b), dtype=np.int64, count=int(self.n_b.sum()))
        del both
        # both sides hold the same bytes of each document, so places agree over all of them
        end_a, end_b = np.cumsum(sides.size_a[self.ids_a]), np.cumsum(sides.size_b[self.ids_b])
        start_a, start_b = end_a - sides.size_a[self.ids_a], end_b - sides.size_b[self.ids_b]
        doc_a, doc_b = (np.repeat(np.arange(len(texts)), n) for n in (self.n_a, self.n_b))
        over_a = covering(start_a, start_b, doc_a, doc_b)
        over_b = covering(start_b, start_a, doc_b, doc_a)
        new = start_a[over_b] != start_b  # equal starts were found from the other side
        self.over = (np.concatenate([np.arange(len(end_a)), over_b[new]]),
                     np.concatenate([over_a, np.flatnonzero(new)]))
        together = end_a[self.over[0]] == end_b[self.over[1]]
        self.link_a = np.sort(self.over[0][together])  # ends rise along both sides alike
        self.link_b = np.sort(self.over[1][together])
        self.n_links = np.bincount(doc_a[self.link_a], minlength=len(texts))
        self.closes_a, self.closes_b = (np.zeros(len(x), dtype=np.int64) for x in (end_a, end_b))
        self.closes_a[self.link_a] = self.closes_b[self.link_b] = 1

    def pair_codes(self, base: int) -> np.ndarray:
        return self.ids_a[self.link_a] * base + self.ids_b[self.link_b]

    def group_texts(self, sides: Sides) -> Iterator[str]:
        """``a1,a2|b1;a3|b2,b3`` of every document."""
        group_a = np.cumsum(self.closes_a) - self.closes_a
        group_b = np.cumsum(self.closes_b) - self.closes_b
        per_a, per_b = (np.bincount(g, minlength=len(self.link_a)) for g in (group_a, group_b))
        upto_a, upto_b = np.cumsum(per_a), np.cumsum(per_b)
        codes = np.empty(len(self.ids_a) + len(self.ids_b), dtype=np.int64)
        if len(codes):
            codes[np.arange(len(self.ids_a)) + (upto_b - per_b)[group_a]] = self.ids_a + self.closes_a * sides.width
            codes[np.arange(len(self.ids_b)) + upto_a[group_b]] = self.ids_b + self.closes_b * (2 * sides.width)
        written, at = sides.written.__getitem__, 0
        for n in (self.n_a + self.n_b).tolist():
            yield "".join(map(written, codes[at:at + n].tolist()))[:-1]
            at += n


_sides: dict[str, Sides] = {}  # of this worker


def _open(a: ByteLevel, b: Piece) -> Sides:
    key = f"{a.digest} {hash(b.model)}"
    if key not in _sides:
        _sides.clear()
        _sides[key] = Sides(a, b)
    return _sides[key]


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, digest: bool = False, doc_id: str = "doc_id",
          text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups`` - tokens of either side, groups, links, links whose
    count is the highest of their second id, the links' counts summed, and the
    groups written out (``digest``: the lowercase hex SHA-256 of that text, or
    ``''`` without tokens)."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    side_a, side_b = ByteLevel(tokenizer_a), Piece(tokenizer_b)
    base = len(side_b.token_bytes())
    narrow = np.dtype("<u4") if base * len(side_a.token_bytes()) < 1 << 32 else np.dtype("<u8")
    held = spark.sparkContext.broadcast((side_a, side_b))  # two files of a few MB
    table = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    key_type = table.schema["doc_id"].dataType
    columns = ["block", "doc_id", "n_a", "n_b", "n_links", "groups", "links", "pairs", "times"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _open(*held.value)
        block, size, asked = TaskContext.get().partitionId() << 40, 0, []

        def asks() -> pa.RecordBatch:
            codes, times = np.unique(np.concatenate(asked), return_counts=True)
            nothing = [pa.nulls(1, f.type) for f in schema][1:7]
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), *nothing, pa.array([codes], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))],
                schema=schema)

        schema = None
        for batch in chunks(batches, "text"):
            done = Aligned(sides, batch.column("text").to_pylist())
            groups = done.group_texts(sides)
            if digest:
                groups = (hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups)
            codes = done.pair_codes(base)
            ends = np.cumsum(done.n_links).tolist()
            links = [codes[b - n:b].astype(narrow).tobytes() for b, n in zip(ends, done.n_links.tolist(), strict=True)]
            asked.append(codes)
            size += batch.column("text").nbytes
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, block)), batch.column("doc_id"), pa.array(done.n_a), pa.array(done.n_b),
                 pa.array(done.n_links), pa.array(list(groups), pa.string()), pa.array(links, pa.binary()),
                 pa.nulls(batch.num_rows, pa.list_(pa.int64())), pa.nulls(batch.num_rows, pa.list_(pa.int64()))], columns)
            schema = out.schema
            yield out
            if size >= block_bytes:
                yield asks()
                block, size, asked = block + 1, 0, []
        if asked:
            yield asks()

    parts = table.mapInArrow(rows, f"block bigint, doc_id {key_type.simpleString()}, n_a bigint, n_b bigint, n_links bigint, "
                                   "groups string, links binary, pairs array<bigint>, times array<bigint>").checkpoint()
    asked = parts.where("pairs IS NOT NULL").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        F.col("block").alias("asker"), F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = asked.groupBy("pair").agg(F.sum("times").alias("n")).checkpoint()
    best = counts.groupBy((F.col("pair") % base).alias("b")).agg(F.max("n").alias("most"))
    rated = counts.join(F.broadcast(best), F.col("pair") % base == F.col("b")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.select("asker", "pair").join(rated, "pair")
    documents = parts.where("pairs IS NULL").select(*columns[:7])

    def rate(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs, answers = docs.combine_chunks(), answers.sort_by("pair")
        known, n, is_best = (answers.column(c).to_numpy() for c in ("pair", "n", "best"))
        codes = np.frombuffer(b"".join(docs.column("links").to_pylist()), dtype=narrow).astype(np.int64)
        at = np.searchsorted(known, codes)
        upto = np.concatenate([[0], np.cumsum(docs.column("n_links").to_numpy())])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)])[upto])
        groups = docs.column("n_links")  # every equal end is one link
        return pa.table({"doc_id": docs.column("doc_id"), "n_a": docs.column("n_a"), "n_b": docs.column("n_b"),
                         "n_groups": groups, "n_links": groups, "n_best": total(is_best), "count_sum": total(n),
                         "groups": docs.column("groups")})

    return documents.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(
        rate, f"doc_id {key_type.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
              "count_sum bigint, groups string")
