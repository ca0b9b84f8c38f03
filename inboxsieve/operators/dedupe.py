"""O14 claim_deliveries: greedy time-to-live dedupe per key, with release on
failure, over a whole table of deliveries.

Semantics (per key, deliveries in (ts, tie) order):

* a delivery is *skipped* while an earlier claim still blocks the key
  (``blocked_until > ts``); ``existing_status`` is ``processing`` while that
  claim is unfinished (``ts < finished_at``), else ``processed``;
* otherwise it *claims* the key: a successful one becomes ``processed`` and
  blocks until ``finished_at + ttl``; a failed one is ``released`` and blocks
  only while it runs (until ``min(finished_at, ts + ttl)``).

Expiry is counted from the last *claimed* delivery, so this is an
order-dependent fold, not a ``lag``/``row_number`` pattern.

Physical plan (skew-safe; a single key may hold a third of all rows):

1. project only ``(key, t, tie, ok, fin)`` - the text never enters a shuffle;
2. ``repartitionByRange(key, t, tie)`` + ``sortWithinPartitions``: a hot key
   is split over many range partitions instead of landing in one task;
3. ``checkpoint()`` into the cluster's shared checkpoint folder: the passes
   below read stable partitions and lineage is cut;
4. a first pass folds each partition's rows in order as a stream of Arrow
   batches (``mapInArrow``, O(1) carried state) and reports one summary: first
   and last key, first and last time, exit state.  What a partition inherits
   can only matter beyond it if it holds a single key (else its last key begins
   inside it).  For such a partition the exit is a piecewise constant function
   of the moment at which the inherited claim ends, and the pass lists its
   pieces, over all batches.  An inherited claim ends at the latest ``ttl`` plus
   the longest run after the partition's first row, so only rows up to there
   begin a piece;
5. the driver walks over the summaries (O(partitions) numbers): a claim that
   outlives a partition passes through it.  Only where a claim ends inside a
   single-key partition the pieces are needed.  Each piece leads to the piece
   of a later partition in which its own exit ends (one lookup), and the chain
   that begins with the known claim is found by pointer doubling: a round joins
   the pieces with themselves and doubles the known part of every chain, so a
   key over p partitions takes log2(p) rounds, whatever the number of claims;
6. a last pass folds with the states found and emits one row per delivery.

No group is ever collected; the driver sees the summaries and one piece per
partition.  Rows without
a time cannot be ordered: their status is ``invalid`` and they claim nothing.
A NULL key is a key like any other.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint, checkpoint_dir

DEFAULT_TTL = _dt.timedelta(days=7)
_EPOCH = _dt.datetime(1970, 1, 1)

PROCESSED, RELEASED, SKIPPED, PROCESSING, INVALID = "processed", "released", "skipped", "processing", "invalid"
NONE = -(1 << 62)  # no claim blocks the key
LOOKUPS = 1 << 20  # exits looked up by one task; more are dealt out


def _micros(col: Column, dtype: T.DataType) -> Column:
    """Microseconds since the epoch without any time-zone conversion."""
    if isinstance(dtype, T.TimestampNTZType):
        epoch = F.lit(_EPOCH).cast("timestamp_ntz")
    else:
        epoch = F.lit(_EPOCH.replace(tzinfo=_dt.timezone.utc)).cast("timestamp")
    return F.timestamp_diff("MICROSECOND", epoch, col)


def _from_micros(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        epoch = F.lit(_EPOCH).cast("timestamp_ntz")
    else:
        epoch = F.lit(_EPOCH.replace(tzinfo=_dt.timezone.utc)).cast("timestamp")
    return F.when(col.isNotNull(), F.timestamp_add("MICROSECOND", col, epoch))


def next_candidates(run: np.ndarray, run_end: np.ndarray, t: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each row, the first later row of its run with a time of ``end`` or
    more (the run's end if there is none)."""
    low = t.min()
    span = int(t.max() - low) + 2
    rows = np.arange(len(t))
    if (int(run[-1]) + 1) * span < 1 << 62:
        place = run * span + (t - low)
        at = np.searchsorted(place, run * span + np.clip(end - low, 0, span - 1), "left")
    else:  # times too far apart for one search over all runs
        at = np.empty(len(t), dtype=np.int64)
        for s, e in zip(np.unique(run_end - np.bincount(run)[run]), np.unique(run_end), strict=True):
            at[s:e] = s + np.searchsorted(t[s:e], end[s:e], "left")
    return np.minimum(np.maximum(at, rows + 1), run_end)


class Folded:
    """The fold of sorted rows, all runs (keys) at once.

    ``until, fin, final`` hold, per run, the state it starts with.  Chains of
    claims advance together: a step moves every run from a claim to the next
    row that is not blocked by it."""

    def __init__(self, run: np.ndarray, t: np.ndarray, ok: np.ndarray, fin: np.ndarray, ttl: int,
                 until: np.ndarray, at_fin: np.ndarray, final: np.ndarray):
        fin = np.maximum(fin, t)
        self.end = np.where(ok, fin + ttl, np.minimum(fin, t + ttl))  # blocked until then if the row claims
        size = np.bincount(run)
        stop = np.cumsum(size)
        begin = stop - size
        self.next = next_candidates(run, stop[run], t, self.end)
        # the first row of each run that its starting state does not block
        opens = begin + np.bincount(run, weights=(t < until[run])).astype(np.int64)
        claimed = np.zeros(len(t), dtype=bool)
        at, limit = opens[opens < stop], stop[opens < stop]
        while len(at):
            claimed[at] = True
            at = self.next[at]
            at, limit = at[at < limit], limit[at < limit]
        last = np.maximum.accumulate(np.where(claimed, np.arange(len(t)), -1))
        own = last >= begin[run]  # the run's latest claim is one of these rows
        k = np.where(own, last, 0)
        self.post_until = np.where(own, self.end[k], until[run])
        self.post_fin = np.where(own, fin[k], at_fin[run])
        self.post_final = np.where(own, np.where(ok[k], PROCESSED, PROCESSING), final[run])
        self.status = np.where(claimed, np.where(ok, PROCESSED, RELEASED), SKIPPED)
        self.existing = np.where(t < self.post_fin, PROCESSING, self.post_final)
        self.claimed = claimed
        self.expires = np.where(claimed & ~ok, NONE, self.post_until)
        self.fin, self.ok = fin, ok


class Exits:
    """The exits of a partition of one key, as a function of the moment at
    which the claim that it inherits ends.

    A row is an entry if an inherited claim may end at its time, after that of
    the row before.  Entries whose latest claim is the same row form one chain;
    a batch moves each chain to its last claim inside the batch."""

    def __init__(self, span: int):
        self.span, self.limit = span, None
        self.times = np.zeros(0, dtype=np.int64)  # of the entries
        self.chain = np.zeros(0, dtype=np.int64)  # which chain each is in
        self.until, self.fin = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # by chain
        self.ok = np.zeros(0, dtype=bool)

    def add(self, t: np.ndarray, done: Folded) -> None:
        n = len(t)
        if self.limit is None:
            self.limit = int(t[0]) + self.span
        last, go = np.arange(n), done.next.copy()
        while (go < n).any():  # the last claim of a chain from each row, jumping twice as far each time
            inside = np.minimum(go, n - 1)
            last, go = np.where(go < n, last[inside], last), np.where(go < n, go[inside], n)
        landed = np.searchsorted(t, self.until, "left")
        # of rows at one time the first is claimed; one row beyond the limit is an entry too
        new = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        if len(self.times):
            new = new[t[new] != self.times[-1]] if self.times[-1] <= self.limit else new[:0]
        new = new[:np.searchsorted(t[new], self.limit, "right") + 1]
        # chains by their last claim: a row of this batch, or none (numbered from n on)
        at = np.concatenate([np.where(landed < n, last[np.minimum(landed, n - 1)], n + np.arange(len(landed))), last[new]])
        names, place = np.unique(at, return_inverse=True)
        here, before = names < n, names[names >= n] - n
        rows = names[here]
        self.times = np.concatenate([self.times, t[new]])
        self.chain = place[np.concatenate([self.chain, len(landed) + np.arange(len(new))])]
        self.until = np.concatenate([done.end[rows], self.until[before]])
        self.fin = np.concatenate([done.fin[rows], self.fin[before]])
        self.ok = np.concatenate([done.ok[rows], self.ok[before]])

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(time, until, fin, ok)``: the state after the last row if the
        inherited claim ends at the time or before it, but after the time of
        the piece before."""
        if not len(self.times):
            return self.times, self.until, self.fin, self.ok
        k = np.flatnonzero(np.concatenate([self.chain[1:] != self.chain[:-1], [True]]))
        c = self.chain[k]
        return self.times[k], self.until[c], self.fin[c], self.ok[c]


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """The number of the run of equal keys each row belongs to."""
    key = batch.column("_tok")
    new = np.zeros(len(key), dtype=np.int64)
    if len(key) > 1:
        new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _fold_stream(batches: Iterator[pa.RecordBatch], ttl: int, entries: dict):
    """Fold the batches of one partition: yields ``(batch, Folded)``."""
    carry = None  # (key, until, fin, final) after the batch before
    for batch in batches:
        if not batch.num_rows:
            continue
        run = _runs(batch)
        t, ok, fin, until, at_fin = _numbers(batch, "_t", "_ok", "_fin", "_su", "_sf")
        first = np.searchsorted(run, np.arange(run[-1] + 1))
        until, at_fin = until[first].copy(), at_fin[first].copy()
        final = batch.column("_sfinal").take(pa.array(first)).to_numpy(zero_copy_only=False).astype(object)
        inherited = entries.get(int(batch.column("_pid")[0].as_py())) if carry is None else (
            carry[1:] if carry[0] == batch.column("_tok")[0].as_py() else None)
        if inherited is not None:
            until[0], at_fin[0], final[0] = inherited
        done = Folded(run, t, ok, fin, ttl, until, at_fin, final)
        carry = (batch.column("_tok")[-1].as_py(), int(done.post_until[-1]), int(done.post_fin[-1]), str(done.post_final[-1]))
        yield batch, done


_FOUND = pa.schema([
    ("pid", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()), ("first_t", pa.int64()),
    ("last_t", pa.int64()), ("until", pa.int64()), ("fin", pa.int64()), ("final", pa.string()),
    ("k", pa.int32()), ("t", pa.int64())])
_FOUND_SQL = ("pid int, first_key string, last_key string, first_t bigint, last_t bigint, until bigint, fin bigint, "
              "final string, k int, t bigint")
PIECE_ROWS = 1 << 16


def _boundaries(batches: Iterator[pa.RecordBatch], ttl: int, span: int) -> Iterator[pa.RecordBatch]:
    """The summary of a partition (``k`` null) and the pieces of its exit
    function (``k`` from 0 on; ``t``, and the state it leads to)."""
    out, exits = None, Exits(span)
    for batch, done in _fold_stream(batches, ttl, {}):
        t = batch.column("_t").to_numpy(zero_copy_only=False)
        ends = (batch.column("_tok")[0].as_py(), batch.column("_tok")[-1].as_py())
        if out is None:
            out = {"pid": batch.column("_pid")[0].as_py(), "first_key": ends[0], "first_t": int(t[0])}
        out |= {"last_key": ends[1], "last_t": int(t[-1]), "until": int(done.post_until[-1]),
                "fin": int(done.post_fin[-1]), "final": str(done.post_final[-1])}
        if exits is not None and out["first_key"] == ends[1]:
            exits.add(t, done)
        else:
            exits = None
    if out is None:
        return
    yield pa.RecordBatch.from_pylist([out], schema=_FOUND)
    if exits is None:
        return
    t, until, fin, ok = exits.pieces()
    for a in range(0, len(t), PIECE_ROWS):
        part = slice(a, a + PIECE_ROWS)
        n = len(t[part])
        nothing = pa.nulls(n, pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, out["pid"], dtype=np.int32)), nothing, nothing, pa.nulls(n, pa.int64()),
             pa.nulls(n, pa.int64()), pa.array(until[part]), pa.array(fin[part]),
             pa.array(np.where(ok[part], PROCESSED, PROCESSING).astype(object), pa.string()),
             pa.array(np.arange(a, a + n, dtype=np.int32)), pa.array(t[part])], schema=_FOUND)


def _walk(summaries: list) -> tuple[dict, list]:
    """Entry states of the partitions that the summaries alone tell, and the
    runs they do not: ``(state, partitions, partition after)`` where a claim
    ends inside the first of the single-key partitions."""
    entries, runs = {}, []
    key, state, i = None, None, 0
    while i < len(summaries):
        s = summaries[i]
        alone = s["first_key"] == s["last_key"]
        entry = state if i and key == s["first_key"] else None
        exit_ = (s["until"], s["fin"], s["final"])
        if entry is not None and entry[0] != NONE:
            entries[s["pid"]] = entry
        if entry is not None and alone:
            if entry[0] > s["last_t"]:
                exit_ = entry
            elif entry[0] > s["first_t"]:
                j = i
                while j < len(summaries) and summaries[j]["first_key"] == summaries[j]["last_key"] == s["first_key"]:
                    j += 1
                runs.append((entry, summaries[i:j], summaries[j]["pid"] if j < len(summaries)
                             and summaries[j]["first_key"] == s["first_key"] else None))
                # nothing of this key reaches over the partition after the run
                key, state, i = None, None, j
                continue
        key, state, i = s["last_key"], exit_, i + 1
    return entries, runs


def _name(pid, k):
    """One number for a piece."""
    return pid * (1 << 32) + k


def _double(jumps: DataFrame) -> DataFrame:
    """Jumps twice as far."""
    further = jumps.select(F.col("name").alias("target"), F.col("target").alias("beyond"))
    return jumps.join(further, "target").select("name", F.col("beyond").alias("target"))


def _jumps(found: DataFrame, runs: list) -> DataFrame:
    """From each piece of the runs (``name``) the piece that its exit ends in
    (``target``; no row if that is beyond the run)."""
    spark = found.sparkSession
    of = {s["pid"]: r for r, (_, parts, _) in enumerate(runs) for s in parts}
    bounds = [tuple(np.array([s[c] for s in parts], dtype=np.int64) for c in ("pid", "first_t", "last_t"))
              for _, parts, _ in runs]
    known = spark.sparkContext.broadcast((of, bounds))  # three numbers a partition

    def land(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, bounds = known.value
        for batch in batches:
            pid, k, until = _numbers(batch, "pid", "k", "until")
            where, inside = np.full(len(pid), -1, dtype=np.int64), np.zeros(len(pid), dtype=bool)
            for p in np.unique(pid).tolist():
                if p not in of:
                    continue
                rows = np.flatnonzero(pid == p)
                pids, first, last = bounds[of[p]]
                # a later one: a claim that ends at once ends at the last time of its own
                q = np.maximum(np.searchsorted(last, until[rows], "left"), np.searchsorted(pids, p) + 1)
                rows, q = rows[q < len(pids)], q[q < len(pids)]
                where[rows], inside[rows] = pids[q], until[rows] > first[q]
            ours = where >= 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(_name(pid.astype(np.int64), k)[ours]), pa.array(until[ours]), pa.array(where[ours]),
                 pa.array(inside[ours])], ["name", "until", "pid", "inside"])

    pieces = found.where(F.col("k").isNotNull())
    landed = pieces.select("pid", "k", "until").mapInArrow(land, "name bigint, until bigint, pid bigint, inside boolean")
    first = landed.where("NOT inside").select("name", _name(F.col("pid"), F.lit(0)).alias("target"))
    asks = landed.where("inside").select("name", "until", "pid")
    # how many exits end inside each partition: a task looks up so many at most
    counts = {r["pid"]: r["count"] for r in asks.groupBy("pid").count().collect()}
    parts = {p: -(-n // LOOKUPS) for p, n in counts.items()}
    deal = spark.createDataFrame(list(parts.items()) or [(-1, 1)], "pid long, parts long")
    salted = asks.join(F.broadcast(deal), "pid").select(
        "name", "until", "pid", F.pmod(F.xxhash64("name"), "parts").alias("part"))
    copies = (pieces.select(F.col("pid").cast("long").alias("pid"), "k", "t").join(F.broadcast(deal), "pid")
              .select("pid", "k", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")))

    def look_up(asked: pa.Table, table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        t, k, pid = (table.column(c).to_numpy() for c in ("t", "k", "pid"))
        at = np.searchsorted(t, asked.column("until").to_numpy(), "left")
        return pa.table({"name": asked.column("name"), "target": pa.array(_name(pid[at], k[at].astype(np.int64)))})

    return first.unionByName(salted.groupBy("pid", "part").cogroup(copies.groupBy("pid", "part")).applyInArrow(
        look_up, "name bigint, target bigint"))


def _resolve_entries(prepared: DataFrame, ttl: int, span: int) -> dict:
    """The state each partition inherits."""
    spark = prepared.sparkSession
    found = checkpoint(prepared.mapInArrow(lambda it: _boundaries(it, ttl, span), _FOUND_SQL))
    summaries = sorted((r.asDict() for r in found.where("k IS NULL").collect()), key=lambda r: r["pid"])
    entries, runs = _walk(summaries)
    if not runs:
        return entries
    # the piece in which each run's first claim ends
    starts = spark.createDataFrame([(parts[0]["pid"], state[0]) for state, parts, _ in runs], "pid int, at long")
    pieces = found.where("k IS NOT NULL")
    begin = (pieces.join(F.broadcast(starts), "pid").where("t >= at").groupBy("pid").agg(F.min("k").alias("k")))
    path = {_name(r["pid"], r["k"]) for r in begin.collect()}
    jumps, longest, length = None, max(len(parts) for _, parts, _ in runs), 1
    while length < longest:
        jumps = checkpoint(_jumps(found, runs) if jumps is None else _double(jumps))
        known = spark.createDataFrame([(p,) for p in path], "name long")  # one piece a partition at most
        path |= {r["target"] for r in jumps.join(F.broadcast(known), "name").select("target").collect()}
        length *= 2
    names = spark.createDataFrame([(p >> 32, p & 0xFFFFFFFF) for p in path], "pid int, k int")
    after = {r["pid"]: (r["until"], r["fin"], r["final"])
             for r in pieces.join(F.broadcast(names), ["pid", "k"]).select("pid", "until", "fin", "final").collect()}
    for state, parts, then in runs:
        for s in parts:
            entries[s["pid"]] = state
            state = after.get(s["pid"], state)
        if then is not None:
            entries[then] = state
    return {p: e for p, e in entries.items() if e[0] != NONE}


def claim_deliveries(deliveries: DataFrame, key: str = "key", ts: str = "ts", tie: str = "delivery_id",
                     ok: str = "ok", finished_at: str | None = None,
                     ttl: _dt.timedelta = DEFAULT_TTL, num_partitions: int | None = None,
                     initial_state: DataFrame | None = None, with_state: bool = False) -> DataFrame:
    """One row per delivery with ``status`` (processed | released |
    skipped | invalid), ``existing_status`` (for skipped rows) and
    ``expires_at``.

    Output columns: ``key, ts, tie, ok, status, existing_status, expires_at``
    (named as in the input).  Join back on ``tie`` for other columns.

    ``initial_state`` (``key, until, fin, final`` with ``until``/``fin`` in
    epoch microseconds) carries claims from earlier batches (a ledger);
    ``with_state`` adds the fold state after each row (``state_until,
    state_fin, state_final``) so callers can write the next ledger.
    """
    spark = deliveries.sparkSession
    checkpoint_dir(spark)
    key_type, ts_type = deliveries.schema[key].dataType, deliveries.schema[ts].dataType
    ttl_us = int(ttl / _dt.timedelta(microseconds=1))
    fin_col = _micros(F.col(finished_at), ts_type) if finished_at else F.lit(None).cast("long")
    narrow = deliveries.select(
        # one comparable token per key, so NULLs and numbers survive Arrow unchanged
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("_tok"),
        _micros(F.col(ts), ts_type).alias("_t"),
        F.col(tie).alias("_tie"),
        F.coalesce(F.col(ok).cast("boolean"), F.lit(False)).alias("_ok"),
        fin_col.alias("_fin"),
    )
    timed = narrow.where(F.col("_t").isNotNull()).withColumn("_fin", F.coalesce("_fin", "_t"))
    if initial_state is not None:
        init = initial_state.select(
            F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("_tok"),
            F.col("until").cast("long").alias("_su"), F.col("fin").cast("long").alias("_sf"),
            F.col("final").alias("_sfinal"))
        timed = timed.join(init, "_tok", "left")
    else:
        timed = timed.withColumns({"_su": F.lit(None).cast("long"), "_sf": F.lit(None).cast("long"),
                                   "_sfinal": F.lit(None).cast("string")})
    timed = timed.withColumns({"_sf": F.coalesce("_sf", "_su", F.lit(NONE)), "_su": F.coalesce("_su", F.lit(NONE)),
                               "_sfinal": F.coalesce("_sfinal", F.lit(PROCESSED))})
    order = ["_tok", "_t", "_tie"]
    ranged = (timed.repartitionByRange(num_partitions, *order) if num_partitions
              else timed.repartitionByRange(*order))
    prepared = checkpoint(ranged.sortWithinPartitions(*order)).withColumn("_pid", F.spark_partition_id())
    span = ttl_us  # a claim lasts so long at most
    if finished_at or initial_state is not None:
        longest = F.max(F.greatest(F.col("_fin") - F.col("_t") + ttl_us, F.col("_su") - F.col("_t")))
        span = max(span, prepared.agg(longest).first()[0] or 0)
    entries = _resolve_entries(prepared, ttl_us, span)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: pa.array(v, pa.int64(), mask=v == NONE)
        for batch, f in _fold_stream(batches, ttl_us, entries):
            free = f.post_until == NONE
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_tok", "_t", "_tie", "_ok")), pa.array(f.status.astype(object), pa.string()),
                 pa.array(f.existing.astype(object), pa.string(), mask=f.claimed), number(f.expires), number(f.post_until),
                 number(np.where(free, NONE, f.post_fin)), pa.array(f.post_final.astype(object), pa.string(), mask=free)],
                names)

    names = ["_tok", "_t", "_tie", "_ok", "status", "existing_status", "_expires", "_post_until", "_post_fin", "_post_final"]
    tie_type = prepared.schema["_tie"].dataType.simpleString()
    folded = prepared.mapInArrow(rows, f"_tok string, _t bigint, _tie {tie_type}, _ok boolean, status string, "
                                       "existing_status string, _expires bigint, _post_until bigint, _post_fin bigint, "
                                       "_post_final string")
    untimed = narrow.where(F.col("_t").isNull()).select(
        "_tok", "_t", "_tie", "_ok", F.lit(INVALID).alias("status"), F.lit(None).cast("string").alias("existing_status"),
        *(F.lit(None).cast(k).alias(c) for c, k in (("_expires", "bigint"), ("_post_until", "bigint"),
                                                    ("_post_fin", "bigint"), ("_post_final", "string"))))
    state = ([F.col("_post_until").alias("state_until"), F.col("_post_fin").alias("state_fin"),
              F.col("_post_final").alias("state_final")] if with_state else [])
    return folded.unionByName(untimed).select(
        F.when(F.col("_tok") != "", F.substring("_tok", 2, 1 << 30).cast(key_type)).alias(key),
        _from_micros(F.col("_t"), ts_type).alias(ts),
        F.col("_tie").alias(tie),
        F.col("_ok").alias(ok),
        "status",
        "existing_status",
        _from_micros(F.col("_expires"), ts_type).alias("expires_at"),
        *state,
    )


def ledger_rows(claims: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The claim state of every key after its last delivery (``key, until,
    fin, final``), from ``claim_deliveries(..., with_state=True)``; a partial
    ``max_by`` aggregation, so a hot key is combined map-side."""
    last = claims.groupBy(key).agg(F.max_by(
        F.struct("state_until", "state_fin", "state_final"), F.struct(F.col(ts), F.col(tie))).alias("s"))
    return (last.select(key, F.col("s.state_until").alias("until"), F.col("s.state_fin").alias("fin"),
                        F.col("s.state_final").alias("final"))
            .filter(F.col("until").isNotNull()))
