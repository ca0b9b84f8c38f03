"""Audit of how filters interact, by truth-table survival words.

Five filters may be applied in any order.  What a document does under all of
them is one 32-bit word: bit S says whether it survives the set S of filters
(bit k of S: the k-th filter).  The positional popcount of the words - how many
have each bit - therefore holds the survivors of every set, and every number of
the audit is a difference of such counts: what an order keeps after a step is
the count of the set of its first filters.

How it runs: one pass over the texts gives a narrow row per document (part, id,
digest of the text, failures A to D), checkpointed.  The least id of each digest
is a map-side combined aggregate, joined back by (digest, id), so no group of
copies meets in one task; labels are joined by id.  Tasks add up their words
with carry-save adders, per part and label, and the counts are summed natively.

Failure conditions (words: maximal ``[^\\x20\\x09-\\x0D]+``): A, under
``MIN_WORDS`` words; B, distinct words under ``MIN_DISTINCT`` % of the words;
C, capitals A-Z over ``MAX_CAPITALS`` % of the code points; D, any of
``SYMBOLS``; E, the text stands at a smaller id.

Cases: a null text is empty, a null source the part ``''``; a null id is smaller
than none, so it neither fails E nor makes others fail, and has no label; rows
equal in id and text do not make each other fail E; a document is labelled by
any of its label rows; texts are compared by a 128-bit digest; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .words import chunks

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
CAPITALS = bytes(range(0x41, 0x5B))
#: By failures (a set of filters): the word of the sets that do not meet it.
WORD_OF = np.array([sum(1 << s for s in range(ALL + 1) if not s & fails) for fails in range(ALL + 1)], dtype=np.uint32)


def failures(text: bytes, points: int) -> int:
    """The set of the filters A to D that a text fails."""
    words = text.split()  # of bytes: at the same six characters
    n = len(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return ((n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * n) << 1
            | (100 * capitals > MAX_CAPITALS * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits.  Carry-save adders turn
    three words of one weight into one of it and one of the double weight,
    until at most two words of each weight are left."""
    total = np.zeros(32, dtype=np.int64)
    weight, level = 1, words
    while len(level):
        carries = []
        while len(level) > 2:
            n = len(level) // 3
            a, b, c = level[:n], level[n:2 * n], level[2 * n:3 * n]
            half = a ^ b
            carries.append((a & b) | (c & half))
            level = np.concatenate([half ^ c, level[3 * n:]])
        for w in level:
            total += weight * ((w >> np.arange(32, dtype=np.uint32)) & 1).astype(np.int64)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return total


def _facts(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    base = docs.select(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("part"),
                       F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            column = pc.fill_null(batch.column("text"), "")
            points = pc.utf8_length(column).to_pylist()
            texts = column.cast(pa.binary()).to_pylist()
            digest = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            fails = [failures(t, n) for t, n in zip(texts, points, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("id"), pa.array(digest, pa.binary()), pa.array(fails, pa.int32())],
                ["part", "id", "digest", "fails"])

    return base.mapInArrow(rows, f"part string, id {base.schema['id'].dataType.simpleString()}, digest binary, fails int")


def _counts(facts: DataFrame) -> DataFrame:
    """Survivors of each set by part and label: the popcounts of batches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").dictionary_encode()
            label = batch.column("label").to_numpy(zero_copy_only=False)
            group = part.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + label
            words = WORD_OF[batch.column("fails").to_numpy(zero_copy_only=False)]
            order = np.argsort(group, kind="stable")
            group, words = group[order], words[order]
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            keys = group[bounds[:-1]]
            counts = [positional_popcount(words[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [part.dictionary.take(pa.array(keys // 4)), pa.array((keys % 4).astype(np.int32)),
                 pa.array(counts, pa.list_(pa.int64()))], ["part", "label", "counts"])

    per_batch = facts.select("part", "label", "fails").mapInArrow(rows, "part string, label int, counts array<bigint>")
    each = per_batch.select("part", "label", F.posexplode("counts").alias("set_", "n"))
    labelled = lambda bit: F.sum(F.when(F.col("label").bitwiseAND(bit) != 0, F.col("n")).otherwise(0))
    return each.groupBy("part", "set_").agg(F.sum("n").alias("n"), labelled(1).alias("good"), labelled(2).alias("toxic"))


def survivors(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
              source: str = "source") -> DataFrame:
    """Per ``part`` and set of filters (``set_``, bit k: the k-th of ABCDE):
    the documents ``n`` that survive it, ``good`` and ``toxic`` ones of them."""
    checkpoint_dir(docs.sparkSession)
    facts = _facts(docs, doc_id, text, source).checkpoint()
    first = (facts.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"))
             .withColumn("first", F.lit(True)))
    flags = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                  F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    named = (facts.where("id IS NOT NULL").join(first, ["digest", "id"], "left").drop("digest").join(flags, "id", "left")
             .select("part", (F.col("fails") + F.when(F.col("first"), 0).otherwise(1 << 4)).alias("fails"),
                     (F.coalesce("good", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))).alias("label")))
    unnamed = facts.where("id IS NULL").select("part", "fails", F.lit(0).alias("label"))
    return _counts(named.unionByName(unnamed))


def _steps() -> Column:
    """Every order and step: the sets before and after it, its filter."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            out.append({"filter_order": name, "step": step, "before": before, "after": after, "k": k, "own": 1 << k})
            before = after
    # one literal, read once by constant folding
    return F.from_json(F.lit(json.dumps(out)),
                       "array<struct<filter_order:string,step:int,before:int,after:int,k:int,own:int>>")


def _shapley(counts: Column) -> Column:
    """By filter: what it removes after each set without it, times the orders
    that begin with just this set and go on with the filter."""
    n = len(FILTERS)
    terms = [[{"set_": s, "then": s | 1 << k, "orders": math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())}
              for s in range(ALL + 1) if not s >> k & 1] for k in range(n)]
    each = F.from_json(F.lit(json.dumps(terms)), "array<array<struct<set_:int,then:int,orders:bigint>>>")
    return F.transform(each, lambda of_filter: F.aggregate(
        of_filter, F.lit(0).cast("long"),
        lambda total, t: total + t["orders"] * (counts[t["set_"]]["n"] - counts[t["then"]]["n"])))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          source: str = "source") -> DataFrame:
    """Per part, order of the filters and step: documents ``kept`` after it
    and ``removed`` by it, ``redundant`` (failing its filter, gone before),
    ``unique_fails`` (failing its filter alone), ``good_lost``, ``toxic_lost``,
    and ``shapley``, its filter's ``removed`` summed over all orders."""
    counts = survivors(docs, labels, doc_id, text, source)
    # 32 entries a part
    table = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("set_", "n", "good", "toxic"))).alias("c"))
    at = lambda column, set_: F.col("c")[set_][column]
    each = table.withColumn("by_filter", _shapley(F.col("c"))).select("part", "c", "by_filter", F.explode(_steps()).alias("p"))
    own = F.col("p.own")
    before, after = F.col("p.before"), F.col("p.after")
    removed = at("n", before) - at("n", after)
    return each.select(
        "part", "p.filter_order", "p.step", at("n", after).alias("kept"), removed.alias("removed"),
        (at("n", 0) - at("n", own) - removed).alias("redundant"),
        (at("n", F.lit(ALL) - own) - at("n", ALL)).alias("unique_fails"),
        (at("good", before) - at("good", after)).alias("good_lost"),
        (at("toxic", before) - at("toxic", after)).alias("toxic_lost"),
        F.col("by_filter")[F.col("p.k")].alias("shapley"))
