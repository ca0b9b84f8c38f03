"""O15 claim_deliveries_stream: the TTL claim fold over an unbounded stream
of deliveries, with keyed value state.

State per key is O(1) - ``(blocked_until, finished_at, final_status)`` -
and is evicted by an event-time timer at ``blocked_until``, so the state
store holds only keys with a live claim.  Deliveries later than the
watermark are dropped by Spark: choose the watermark delay to cover the
out-of-orderness of the source.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedupe import DEFAULT_TTL, NONE, PROCESSED, Folded, _from_micros, _micros

INPUT_COLUMNS = ["_key", "_ev", "_t", "_tie", "_ok", "_fin"]
STATE_SCHEMA = T.StructType([
    T.StructField("until", T.LongType()),
    T.StructField("fin", T.LongType()),
    T.StructField("final", T.StringType()),
])


def _out_schema(key_type: T.DataType, tie_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("_key", key_type), T.StructField("_t", T.LongType()), T.StructField("_tie", tie_type),
        T.StructField("_ok", T.BooleanType()), T.StructField("status", T.StringType()),
        T.StructField("existing_status", T.StringType()), T.StructField("_expires", T.LongType()),
    ])


class ClaimProcessor(StatefulProcessor):
    """Runs :class:`~inboxsieve.operators.dedupe.Folded` per key across
    micro-batches; the fold state lives in a value state."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        if pdf.empty:
            return
        # Arrow hands the rows over with positional names; restore ours
        pdf.columns = INPUT_COLUMNS[: len(pdf.columns)]
        pdf = pdf.sort_values(["_t", "_tie"], kind="stable").reset_index(drop=True)
        before, fin, final = self.claim.get() if self.claim.exists() else (NONE, NONE, PROCESSED)
        n = len(pdf)
        done = Folded(np.zeros(n, dtype=np.int64), pdf["_t"].to_numpy(dtype=np.int64), pdf["_ok"].to_numpy(dtype=bool),
                      pdf["_fin"].to_numpy(dtype=np.int64), self.ttl_us, np.array([int(before)]), np.array([int(fin)]),
                      np.array([final], dtype=object))
        until = int(done.post_until[-1])
        if until != NONE:
            self.claim.update((until, int(done.post_fin[-1]), str(done.post_final[-1])))
            if until != before:
                # evict once the claim can no longer block anything (timers are in ms)
                self.handle.registerTimer(until // 1000 + 1)
        out = pdf[["_key", "_t", "_tie", "_ok"]].copy()
        out["status"] = done.status
        out["existing_status"] = np.where(done.claimed, None, done.existing)
        out["_expires"] = pd.array(done.expires, dtype="Int64")
        out.loc[done.expires == NONE, "_expires"] = pd.NA
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.claim.exists():
            until = self.claim.get()[0]
            if until is not None and until // 1000 < timerValues.getCurrentWatermarkInMs():
                self.claim.clear()
        return iter([])

    def close(self) -> None:
        pass


def claim_deliveries_stream(deliveries: DataFrame, key: str = "key", ts: str = "ts", tie: str = "delivery_id",
                            ok: str = "ok", finished_at: str | None = None, ttl: _dt.timedelta = DEFAULT_TTL,
                            watermark: str = "1 day") -> DataFrame:
    """A streaming DataFrame of claim statuses (same columns as
    :func:`~inboxsieve.operators.dedupe.claim_deliveries`), to be written
    with ``outputMode('append')``."""
    ts_type = deliveries.schema[ts].dataType
    ttl_us = int(ttl / _dt.timedelta(microseconds=1))
    fin = _micros(F.col(finished_at), ts_type) if finished_at else F.lit(None).cast("long")
    # watermarks need TIMESTAMP (not NTZ); only the ordering matters here
    narrow = (deliveries.withColumn("_ev", F.col(ts).cast("timestamp")).withWatermark("_ev", watermark).select(
        F.col(key).alias("_key"), F.col("_ev"), _micros(F.col(ts), ts_type).alias("_t"),
        F.col(tie).alias("_tie"), F.coalesce(F.col(ok).cast("boolean"), F.lit(False)).alias("_ok"),
        F.coalesce(fin, _micros(F.col(ts), ts_type)).alias("_fin"))
        .where(F.col("_t").isNotNull()))
    assert narrow.columns == INPUT_COLUMNS
    schema = _out_schema(deliveries.schema[key].dataType, deliveries.schema[tie].dataType)
    out = narrow.groupBy("_key").transformWithStateInPandas(
        statefulProcessor=ClaimProcessor(ttl_us), outputStructType=schema, outputMode="Append",
        timeMode="EventTime")
    return out.select(
        F.col("_key").alias(key), _from_micros(F.col("_t"), ts_type).alias(ts), F.col("_tie").alias(tie),
        F.col("_ok").alias(ok), "status", "existing_status",
        _from_micros(F.col("_expires"), ts_type).alias("expires_at"))
