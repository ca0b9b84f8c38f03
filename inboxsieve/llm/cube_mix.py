"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target is its share of the total by weight, at most ``cap``
times its own size (the excess is shared anew by weight).  A document is taken
floor(r) times, r = target / size of its source, and once more with the
fractional probability that is left.  Which documents get that extra copy is
decided by the cube method: in a block of a source, three undecided
documents at a time move along the one direction that keeps both the expected
number of documents and the expected number of words, until a probability
reaches 0 or 1; at most two documents of a block stay undecided.  Those of all
blocks go on as the next, thousand times smaller round, until a source fits
into one block; there the flight stops before the last dozen documents, and
those with the one or two undecided before them are the landing problem, solved
by trying every choice for the words nearest their expectation.

Sources are salted into blocks of about ``block_rows`` units, so a source with
a third of all rows is spread over many tasks, and no task or group holds
more.  Random choices come from a seeded generator per block whose rows are
sorted, so reruns agree.

Cases: a null text has size 0; a null source is a source of its own, last in
order; sources without words get target 0 and are taken 0 times; rows equal in
id, source and text are one unit whose rows are all taken equally often; an
empty table gives an empty result; other columns are ignored here (``mixed``
keeps them), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9
LANDING = 12  # units of a source's last block that the flight leaves to the landing
MAX_BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """``_source, _at, source_size, target``: one row per source.

    A source is at its cap if cap * size is at most its weight's share of what
    the sources that are not capped divide; sorted by cap * size / weight, the
    capped ones come first, so running sums find the level.  The windows run
    over one row per source."""
    src = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    src = src.select("*", at.alias("_at"))
    src = src.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_at") - 1) % len(weights) + 1)))
    src = src.withColumn("_ratio", cap * F.col("source_size") / F.col("_w"))
    upto = Window.orderBy("_ratio", "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(0))
    src = src.select("*", F.sum("_w").over(upto).alias("_w_upto"), F.sum("source_size").over(upto).alias("_s_upto"),
                     F.sum("_w").over(everything).alias("_w_all"),
                     (share * F.sum("source_size").over(everything)).alias("_total"))
    # the level per unit of weight if all sources before this one are capped
    before_w, before_s = F.col("_w_upto") - F.col("_w"), F.col("_s_upto") - F.col("source_size")
    src = src.withColumn("_level", (F.col("_total") - cap * before_s) / (F.col("_w_all") - before_w))
    first_free = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_at", "_level"))).over(everything)
    level = F.coalesce(first_free["_level"], F.lit(float("inf")))
    return src.select("_source", "_at", "source_size",
                      F.least(cap * F.col("source_size"), level * F.col("_w")).cast("double").alias("target"))


def flight(p: np.ndarray, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase for two balancing columns ``a`` (rows: documents,
    words of a unit): at most two entries of the result are undecided."""
    p = p.copy()
    x, y = a[:, 0].tolist(), a[:, 1].tolist()
    active: list[int] = []
    for unit in np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist():
        active.append(unit)
        while len(active) == 3:
            i, j, k = active
            u = (x[j] * y[k] - x[k] * y[j], x[k] * y[i] - x[i] * y[k], x[i] * y[j] - x[j] * y[i])
            if not any(u):  # all on one line: two of them are balanced already
                u = (x[j], -x[i], 0.0)
            up = down = np.inf
            for d, t in zip(u, active, strict=True):
                if d > 0:
                    up, down = min(up, (1 - p[t]) / d), min(down, p[t] / d)
                elif d < 0:
                    up, down = min(up, -p[t] / d), min(down, (p[t] - 1) / d)
            step = up if rng.random() * (up + down) < down else -down
            for d, t in zip(u, active, strict=True):
                p[t] += step * d
                p[t] = 0.0 if p[t] < EPS else 1.0 if p[t] > 1 - EPS else p[t]
            active = [t for t in active if 0 < p[t] < 1]
    return p


def land(p: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Decide the last units by trying all choices: words nearest their
    expectation, then documents."""
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    out = np.round(p)
    if len(left):
        choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
        off = np.abs((choices - p[left]) @ a[left])
        out[left] = choices[np.lexsort((off[:, 0], off[:, 1]))[0]]
    return out


def _decided(units: DataFrame, seed: int, level: int, landing: bool) -> DataFrame:
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "_id_text"], kind="stable")  # a hash: any order but size
        rng = np.random.default_rng([seed, level, int(pdf["_at"].iloc[0]), int(pdf["_block"].iloc[0])])
        a = pdf[["_rows", "_words"]].to_numpy(dtype=float)
        p = pdf["_p"].to_numpy(dtype=float, copy=True)
        flying = len(p) - LANDING if landing else len(p)
        if flying > 0:
            p[:flying] = flight(p[:flying], a[:flying], rng)
        return pdf.assign(_p=land(p, a) if landing else p)

    return units.groupBy("_at", "_block").applyInPandas(block, units.schema)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        share: float = 1.0, cap: float = 3.0, block_rows: int = 2000, seed: int = 11) -> DataFrame:
    """``_id, _source, _key, rows, size, source_size, target, copies``: how
    often each unit (rows equal in id, source and text) is taken."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    sizes = docs.select(F.col(doc_id).alias("_id"), F.col(source).cast("string").alias("_source"),
                        F.xxhash64(text).alias("_key"), word_count(F.col(text)).alias("size"))
    sizes = (sizes.groupBy("_id", "_source", "_key", "size").agg(F.count("*").alias("rows"))).checkpoint()
    totals = sizes.select("_source", (F.col("size") * F.col("rows")).alias("size"))
    targets = source_targets(totals, weights, share, cap).checkpoint()
    few = targets.count() <= MAX_BROADCAST_SOURCES
    plan = F.broadcast(targets) if few else targets
    r = F.least(F.lit(cap), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    units = (sizes.join(plan.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
             .withColumn("_r", r).withColumn("_base", F.floor(F.col("_r") + EPS).cast("long"))
             .withColumn("_p", F.greatest(F.lit(0.0), F.col("_r") - F.col("_base")))
             .withColumn("_rows", F.col("rows").cast("double"))
             .withColumn("_words", (F.col("rows") * F.col("size")).cast("double"))
             .withColumn("_id_text", F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    open_ = (F.col("_p") > EPS) & (F.col("_p") < 1 - EPS)
    done, level = [], 0
    while True:
        counts = units.where(open_).groupBy("_at").agg(F.count("*").alias("_n"))
        largest = counts.agg(F.max("_n")).first()[0] or 0
        landing = largest <= block_rows
        blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") / block_rows)).cast("long")
        here = (units.join(F.broadcast(counts) if few else counts, "_at")
                .withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + level), "_id_text", "_key"), blocks)).drop("_n"))
        done.append(units.where(~open_))
        here = _decided(here.where(open_), seed, level, landing).drop("_block")
        if landing:
            done.append(here)
            break
        units = here.checkpoint()
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("_id", "_source", "_key", "rows", "size", "source_size", "target",
                      (F.col("_base") + F.round("_p").cast("long")).alias("copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, all
    columns kept."""
    copies = (mix(docs, doc_id, text, source, **how).where(F.col("copies") > 0)
              .select(F.col("_id").alias("_i"), F.col("_source").alias("_s"), F.col("_key").alias("_k"), "copies")
              .withColumnRenamed("copies", "_copies"))
    same = (F.col(f"d.{doc_id}").eqNullSafe(F.col("c._i")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("c._k"))
            & F.col(f"d.{source}").cast("string").eqNullSafe(F.col("c._s")))
    return (docs.alias("d").join(copies.alias("c"), same)
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
            .select(*(F.col(f"d.`{c}`") for c in docs.columns)))
