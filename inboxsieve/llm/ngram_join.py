"""N-gram Jaccard join: a blocked sparse product of the document by n-gram
incidence matrix, with size-derived bounds.

A document's row of the matrix has a one for each of its distinct word n-grams
(a text with fewer words has its whole word sequence as the only one).  Rows
that are equal form one class, so copies are one row.  Overlap counts are sums
over columns, and the columns are taken in blocks, rare ones first:

1. *Rows that cannot link.*  In the order of hashes, rows with a similarity of
   t share at least ``l`` of their first ``n - ceil(t n) + l`` columns (with
   ``l`` a tenth of the row).  Counting how many of those columns a row shares
   with any other drops the rows with too few.  A column found in several rows
   of one task is sent on once, so a very common n-gram is no hot key.
2. *Rare columns.*  Among the rows left, columns are ordered by document
   frequency; two linked rows share one of the first ``n - ceil(t n) + 1``.
   Only these columns are multiplied to find pairs.  First, each column's rows
   are multiplied with two of them only (a star), and the pairs whose sizes and
   numbers of shared columns allow a link are completed over all columns and
   compared.  Links make components.
3. *Across components.*  Columns whose rows are still in several components are
   multiplied again, across components only, so a large group of near copies,
   joined by its stars, emits no pairs.  Short columns (``SHORT`` rows) are
   multiplied pair by pair; a pair whose overlap so far plus what its rows have
   left is below the size-derived bound is dropped before it is completed.
   The rows of longer columns are gathered by a component they share, those
   outside it are set against all in blocks of ``BLOCK`` rows, and a task
   multiplies two blocks: it accumulates the overlap counts over column blocks
   as dense products and emits only links that join components.
   After this round every pair that could link two components was compared.

The result is exact: bounds only drop pairs that cannot link (n-grams are
compared by 64-bit hashes).

Cases: null or empty texts, and texts without words, have an empty set and
link with nothing; a null id is not linked (its component is null); equal sets
are linked; repeated rows are equal sets; rows with one id are one node for
reachability only if their sets are equal or linked; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .components import components
from .words import WORD_BASE, Texts, chunks, lower_ascii, mix, prefix_hash

_U = np.uint64
MAX_BROADCAST_ROWS = 2_000_000  # ids of 8 bytes
FLUSH = 1_000_000  # matrix entries a task holds before it sends them on
SHORT, BLOCK, COLUMNS = 32, 128, 4096


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: the sorted distinct n-gram hashes of document ``d``
    are ``hashes[first[d]:first[d + 1]]``."""
    t = Texts(column)
    t.data = lower_ascii(t.data)
    words, doc = t.word_hashes(), t.doc_of_word()
    begin = t.first[:-1]
    short = np.flatnonzero((t.n_words > 0) & (t.n_words < width))
    at = np.flatnonzero(doc[width - 1:] == doc[:len(doc) - width + 1]) if len(doc) >= width else np.zeros(0, np.int64)
    starts = np.concatenate([at, begin[short]])
    ends = np.concatenate([at + width, t.first[1:][short]])
    grams = prefix_hash(words, WORD_BASE)(starts, ends) if len(words) else np.zeros(0, dtype=np.uint64)
    owner = doc[starts] if len(words) else starts
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        new = np.ones(len(grams), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(t.n + 1))


def class_keys(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 62-bit key of each set, as a signed number whose last two bits are 0."""
    sums = np.zeros(len(grams) + 1, dtype=np.uint64)
    np.cumsum(mix(grams), dtype=np.uint64, out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64) * WORD_BASE).view(np.int64) & -4


def _least_overlap(n, percent: int):
    """ceil(percent / 100 * n), for numbers, arrays and columns of whole numbers."""
    if isinstance(n, Column):
        return F.floor((n * percent + 99) / 100)
    return (n * percent + 99) // 100


def _sizes(docs: DataFrame, width: int) -> DataFrame:
    """``_id, cls, n`` of every row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            grams, first = shingle_sets(batch.column("_text"), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(class_keys(grams, first)), pa.array(np.diff(first).astype(np.int64))],
                ["_id", "cls", "n"])

    return docs.mapInArrow(rows, f"_id {docs.schema['_id'].dataType.simpleString()}, cls bigint, n bigint")


def _shared_counts(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``cls, shared``: at least how many of a row's first columns (in the
    order of hashes) are in other rows too - or more, never fewer."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            grams = np.concatenate([g for g, _ in held])
            cls = np.concatenate([c for _, c in held])
            held.clear()
            order = np.argsort(grams, kind="stable")
            grams, cls = grams[order], cls[order]
            new = np.ones(len(grams), dtype=bool)
            new[1:] = grams[1:] != grams[:-1]
            group = np.cumsum(new) - 1
            several = np.bincount(group) > 1
            here, times = np.unique(cls[several[group]], return_counts=True)
            # last bits 0: a column of one row; 1: of several rows of this task; 2: how many columns of a row are known
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([grams[new].view(np.int64), here])),
                 pa.array(np.concatenate([cls[new] | several, times << 2 | 2]))], ["col", "cls"])

        amount = 0
        for batch in chunks(batches, "_text"):
            grams, first = shingle_sets(batch.column("_text"), width)
            cls, n = class_keys(grams, first), np.diff(first)
            fresh = np.zeros(len(cls), dtype=bool)
            for d, key in enumerate(cls.tolist()):
                if n[d] and key not in seen:
                    seen.add(key)
                    fresh[d] = True
            take = np.minimum(n, n - _least_overlap(n, percent) + np.maximum(1, n // 10)) * fresh
            doc = np.repeat(np.arange(len(n)), n)
            early = np.arange(len(grams)) - first[doc] < take[doc]
            held.append((grams[early], cls[doc[early]]))
            amount += int(early.sum())
            if amount > FLUSH:
                yield flush()
                amount = 0
        if held:
            yield flush()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by column; a column's rows may run over batches."""
        rest: tuple[np.ndarray, ...] | None = None

        def count(col, cls) -> pa.RecordBatch:
            known = cls & 3 == 2
            out_cls, out_n = [col[known]], [cls[known] >> 2]
            col, cls = col[~known], cls[~known]
            if len(col):
                new = np.ones(len(col), dtype=bool)
                new[1:] = col[1:] != col[:-1]
                at = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                one, kind = cls & -4, cls & 3
                many = ((np.maximum.reduceat(one, at) != np.minimum.reduceat(one, at))
                        | (np.maximum.reduceat(kind, at) > 0))
                found, times = np.unique(one[many[group] & (kind == 0)], return_counts=True)
                out_cls.append(found)
                out_n.append(times)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_cls)),
                                               pa.array(np.concatenate(out_n).astype(np.int64))], ["cls", "n"])

        for batch in batches:
            now = tuple(batch.column(c).to_numpy() for c in ("col", "cls"))
            if rest is not None:
                now = tuple(np.concatenate([a, b]) for a, b in zip(rest, now, strict=True))
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            rest = tuple(a[cut:] for a in now)
            if cut:
                yield count(*(a[:cut] for a in now))
        if rest is not None and len(rest[0]):
            yield count(*rest)

    spread = (docs.mapInArrow(entries, "col bigint, cls bigint")
              .repartition("col").sortWithinPartitions("col"))
    return spread.mapInArrow(shared, "cls bigint, n bigint").groupBy("cls").agg(F.sum("n").alias("shared"))


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``cls, n, grams`` of the wanted classes (``cls, _id``: a row that has it)."""
    few = wanted.count() <= MAX_BROADCAST_ROWS
    ids = wanted.select("_id", F.col("cls").alias("_want"))
    texts = docs.join(F.broadcast(ids) if few else ids, "_id").select("_want", "_text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            grams, first = shingle_sets(batch.column("_text"), width)
            cls = class_keys(grams, first)
            right = np.flatnonzero(cls == batch.column("_want").to_numpy())
            lists = pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[right]), pa.array(np.diff(first)[right].astype(np.int64)),
                 lists.take(pa.array(right)).cast(pa.list_(pa.int64()))], ["cls", "n", "grams"])

    # a class has one wanted row; repeated input rows are dropped
    return texts.mapInArrow(rows, "cls bigint, n bigint, grams array<bigint>").dropDuplicates(["cls"])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a, b``) that link, compared over all columns."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    return (pairs.select("a", "b").join(left, "a").join(right, "b")
            .select("a", "b", "na", "nb", both.alias("both"))
            .where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both")))
            .select("a", "b"))


def _sizes_allow(percent: int) -> Column:
    """Bounds from the sizes, and from the columns each row shares with any other."""
    na, nb = F.col("na"), F.col("nb")
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb))
            & ((100 + percent) * F.least("ca", "cb") >= percent * (na + nb)))


def _count_allows(percent: int) -> Column:
    """Bound from the overlap so far: beyond the row whose rare columns end
    first, what it has left is all that can be shared."""
    most = F.col("so_far") + F.greatest("left_a", "left_b")
    return (100 + percent) * most >= percent * (F.col("na") + F.col("nb"))


def _side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select("col", *more, F.col("cls").alias(name), F.col("n").alias(f"n{name}"), F.col("c").alias(f"c{name}"),
                       F.col("left").alias(f"left_{name}"), F.col("comp").alias(f"comp_{name}"))


def _block_product(table: pa.Table, percent: int) -> pa.Table:
    """Links between two blocks of rows (``side`` 0 and 1) that join components."""
    parts = []
    for side in (0, 1):
        rows = table.filter(pc.equal(table["side"], side))
        grams = rows["grams"].combine_chunks()
        grams = grams if not isinstance(grams, pa.ChunkedArray) else grams.chunk(0)
        n = rows["n"].to_numpy()
        parts.append((rows["cls"].to_numpy(), rows["comp"].to_numpy(), n, grams.flatten().to_numpy(zero_copy_only=False),
                      np.repeat(np.arange(len(n)), n)))
    (ca, compa, na, ga, ra), (cb, compb, nb, gb, rb) = parts
    common = np.intersect1d(ga, gb)
    overlap = np.zeros((len(na), len(nb)), dtype=np.float32)
    place = []
    for g, r in ((ga, ra), (gb, rb)):
        at = np.searchsorted(common, g)
        inside = at < len(common)
        inside[inside] = common[at[inside]] == g[inside]
        order = np.argsort(at[inside], kind="stable")
        place.append((at[inside][order], r[inside][order]))
    for begin in range(0, len(common), COLUMNS):
        one = []
        for (at, r), n in zip(place, (na, nb), strict=True):
            lo, hi = np.searchsorted(at, [begin, begin + COLUMNS])
            dense = np.zeros((len(n), COLUMNS), dtype=np.float32)
            dense[r[lo:hi], at[lo:hi] - begin] = 1
            one.append(dense)
        overlap += one[0] @ one[1].T
    both = overlap.astype(np.int64)
    link = (100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (compa[:, None] != compb[None, :])
    i, j = np.nonzero(link)
    _, first = np.unique(np.stack([compa[i], compb[j]]), axis=1, return_index=True)
    return pa.table({"a": pa.array(ca[i[first]]), "b": pa.array(cb[j[first]])})


def _links_in_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components among the rows (``hub, cls, comp``) of each hub:
    rows outside the hub's own component against all its rows, block by block."""
    out = F.col("comp") != F.col("hub")
    blocks = rows.groupBy("hub").agg(F.ceil(F.count_if(out) / BLOCK).alias("nl"), F.ceil(F.count("*") / BLOCK).alias("nr"))
    rows = rows.join(blocks.where("nl > 0"), "hub")
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.where(out).select("hub", "cls", "comp", F.lit(0).alias("side"), own("nl").alias("l"), every("nr").alias("r"))
    right = rows.select("hub", "cls", "comp", F.lit(1).alias("side"), every("nl").alias("l"), own("nr").alias("r"))
    dealt = left.unionByName(right).join(sets, "cls")
    return dealt.groupBy("hub", "l", "r").applyInArrow(lambda t: _block_product(t, percent), "a bigint, b bigint")


def similarity_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                          percent: int = 80) -> DataFrame:
    """``<doc_id>, n_shingles, component_id`` of every row: the size of its
    set, and the smallest id that links of a similarity of ``percent`` / 100 or
    more lead to (its own at least)."""
    checkpoint_dir(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    sizes = _sizes(docs, width).checkpoint()
    classes = (sizes.where("n > 0 AND _id IS NOT NULL").groupBy("cls", "n").agg(F.min("_id").alias("_id")))
    present = docs.where(F.col("_id").isNotNull())
    least = _least_overlap(F.col("n"), percent)
    needed = F.greatest(F.lit(1), F.floor(least / 10))
    wanted = (classes.join(_shared_counts(present, width, percent), "cls").where(F.col("shared") >= needed)
              .select("cls", "_id").checkpoint())
    sets = _sets_of(present, wanted, width).checkpoint()

    # columns by document frequency: those of one row only come first and find nothing
    ones = sets.select("cls", F.explode("grams").alias("col"))
    often = ones.groupBy("col").agg(F.count("*").alias("df")).where("df > 1")
    per_row = ones.join(often, "col").groupBy("cls").agg(F.collect_list(F.struct("df", "col")).alias("cols"))
    first = F.size("cols") - least + 1
    rare = (per_row.join(sets.select("cls", "n"), "cls").where(first > 0)
            .select("cls", "n", F.size("cols").alias("c"), (F.size("cols") - first).alias("left"),
                    F.slice(F.sort_array("cols"), F.lit(1), F.greatest(first, F.lit(0)).cast("int")).alias("cols"))
            .select("cls", "n", "c", "left", F.explode("cols.col").alias("col"))).checkpoint()

    star = (rare.groupBy("col").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi")
            .select("col", F.explode(F.array("lo", "hi")).alias("centre")))
    sized = _sizes_allow(percent)
    width_of = rare.select("cls", "n", "c").distinct()
    pairs = (rare.join(star, "col").where("cls <> centre")
             .select(F.greatest("cls", "centre").alias("a"), F.least("cls", "centre").alias("b")).distinct())
    for name in ("a", "b"):
        pairs = pairs.join(width_of.select(F.col("cls").alias(name), F.col("n").alias(f"n{name}"),
                                           F.col("c").alias(f"c{name}")), name)
    links = _links(pairs.where(sized), sets, percent).checkpoint()
    comps = components(links)

    # columns whose rows are in several components
    placed = (rare.join(comps, rare["cls"] == comps["node"], "left")
              .select("col", "cls", "n", "c", "left", F.coalesce("comp", "cls").alias("comp")))
    several = (placed.groupBy("col").agg(F.min("comp").alias("hub"), F.max("comp").alias("last"), F.count("*").alias("m"),
                                         F.min("cls").alias("lo"), F.max("cls").alias("hi"))
               .where("hub <> last").select("col", "hub", "m", "lo", "hi"))
    placed = placed.join(several, "col").checkpoint()
    short = placed.where(F.col("m") <= SHORT)
    a = _side(short.where("comp <> hub"), "a")
    b = _side(short, "b", "hub", "lo", "hi")
    # a pair comes from either side, as each column has its own hub: put it in one order
    turn = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    across = (a.join(b, "col").where("comp_a <> comp_b AND (comp_b = hub OR a < b)").where(sized)
              .select(*(pick(x + "a", x + "b").alias(x + "a") for x in ("", "n", "left_")),
                      *(pick(x + "b", x + "a").alias(x + "b") for x in ("", "n", "left_")),
                      (F.col("a").isin(F.col("lo"), F.col("hi")) | F.col("b").isin(F.col("lo"), F.col("hi"))).alias("compared"))
              .groupBy("a", "b", "na", "nb", "left_a", "left_b")
              .agg(F.count("*").alias("so_far"), F.max("compared").alias("compared")))
    # a pair that also meets in longer columns has more overlap than was counted; the blocks compare it
    more = _links(across.where(~F.col("compared")).where(_count_allows(percent)), sets, percent)
    long = placed.where(F.col("m") > SHORT).select("hub", "cls", "comp").distinct()
    comps = components(links.unionByName(more).unionByName(_links_in_blocks(long, sets, percent))).checkpoint()

    named = (classes.join(comps, classes["cls"] == comps["node"], "left")
             .select("cls", "n", "_id", F.coalesce("comp", "cls").alias("comp")))
    least_id = named.groupBy("comp").agg(F.min("_id").alias("component_id"))
    named = named.join(least_id, "comp").select("cls", "n", "component_id").withColumnRenamed("n", "_n")
    same = (F.col("s.cls") == F.col("c.cls")) & (F.col("s.n") == F.col("c._n")) & F.col("s._id").isNotNull()
    return (sizes.alias("s").join(named.alias("c"), same, "left")
            .select(F.col("s._id").alias(doc_id), F.col("s.n").alias("n_shingles"),
                    F.coalesce("c.component_id", "s._id").alias("component_id")))
