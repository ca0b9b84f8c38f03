"""P2 triage_stream: batch triage (P1) per micro-batch with a claim ledger.

``foreachBatch`` runs :func:`~inboxsieve.plans.triage.triage_batch` on the
micro-batch with the ledger of live claims from earlier batches, then writes
every output table partitioned by ``batch_id`` with dynamic partition
overwrite (a retried batch replaces its own rows: idempotent sinks), and
the new ledger state last.  Failed mails are not written to the ledger as
claims, so a redelivery is processed again.

The ledger is a :class:`~inboxsieve.sources.keyed_log.KeyedLog`: one snapshot
and the deltas after it.  A snapshot leaves out claims that ended more than
``ledger_keep`` before the latest delivery seen, so a delivery may come so late
and still meet the claim that blocks it.  Checkpoints of a micro-batch are
deleted at its end.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dedupe
from ..operators.dedupe import DEFAULT_TTL
from ..operators.inference import Backend
from ..operators.requests import ModelConfig
from ..plans.triage import triage_batch
from ..session import checkpoints_released
from ..sources.keyed_log import KeyedLog

SINKS = ("results", "alerts", "notifications", "events", "telemetry", "quarantine", "claims")
COMPACT_EVERY = 10
DEFAULT_KEEP = _dt.timedelta(days=7)


def claim_ledger(spark: SparkSession, path: str, key: str, key_type: str, every: int = COMPACT_EVERY) -> KeyedLog:
    """The claims of a stream: until when each key is blocked, and by what."""
    return KeyedLog(spark, path, key, f"`{key}` {key_type}, until bigint, fin bigint, final string", every)


def live_claims(ledger: KeyedLog, batch_id: int, since: int | None) -> DataFrame | None:
    """The claims of earlier batches that may still block something at
    ``since`` (microseconds, the first time of the new batch).  A key's claims
    only ever end later, so older rows need not be read."""
    return None if since is None else ledger.read(batch_id, f"until > {since}")


def close_ledger(ledger: KeyedLog, rows: DataFrame, batch_id: int, latest: int | None, keep: _dt.timedelta) -> None:
    """Write the claims of a batch, and a snapshot when one is due."""
    ledger.write(rows, batch_id)
    if ledger.due(batch_id):
        bound = None if latest is None else latest - int(keep / _dt.timedelta(microseconds=1))
        ledger.compact(batch_id, lambda state: state if bound is None else state.where(F.col("until") > bound))


def time_range(batch: DataFrame, ts: str) -> tuple[int | None, int | None]:
    """First and last time of a batch in microseconds."""
    at = dedupe._micros(F.col(ts), batch.schema[ts].dataType)
    return tuple(batch.agg(F.min(at), F.max(at)).first())


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def triage_stream(deliveries: DataFrame, emails: DataFrame, backend: Backend, out_dir: str,
                  config: ModelConfig | None = None, ttl: _dt.timedelta = DEFAULT_TTL,
                  checkpoint_location: str | None = None, trigger: dict | None = None,
                  notify_timestamp: str = "1970-01-01T00:00:00.000Z",
                  claim_partitions: int | None = None, channel: str | Column = "discord",
                  service_types: list[dict] | None = None, retain_input: bool = False, version: str | None = None,
                  ledger_keep: _dt.timedelta = DEFAULT_KEEP, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Start the streaming triage; outputs go to ``out_dir/<sink>``.  The
    options are those of :func:`~inboxsieve.plans.triage.triage_batch`."""
    key_type = deliveries.schema["email_id"].dataType.simpleString()

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        ledger = claim_ledger(batch.sparkSession, f"{out_dir.rstrip('/')}/ledger", "email_id", key_type, compact_every)
        first, last = time_range(batch, "received_at")
        with checkpoints_released():
            outs = triage_batch(batch, emails, backend, config, ttl, channel=channel, notify_timestamp=notify_timestamp,
                                service_types=service_types, ledger=live_claims(ledger, batch_id, first),
                                claim_partitions=claim_partitions, retain_input=retain_input, version=version)
            for name in SINKS:
                if outs.get(name) is not None:
                    _write(outs[name], f"{out_dir.rstrip('/')}/{name}", batch_id)
            close_ledger(ledger, outs["ledger"], batch_id, last, ledger_keep)

    return _start(deliveries, run_batch, out_dir, checkpoint_location, trigger)


def claim_stream(deliveries: DataFrame, out_dir: str, key: str = "key", ts: str = "ts", tie: str = "delivery_id",
                 ok: str = "ok", finished_at: str | None = None, ttl: _dt.timedelta = DEFAULT_TTL,
                 claim_partitions: int | None = None, checkpoint_location: str | None = None,
                 trigger: dict | None = None, ledger_keep: _dt.timedelta = DEFAULT_KEEP,
                 compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """O15 for triggers in which one key may have any number of rows: each
    micro-batch goes through the batch fold (O14), which splits a key over
    range partitions and holds one Arrow batch a task, and the state between
    micro-batches is the ledger.  Statuses go to ``out_dir/claims`` (columns of
    :func:`~inboxsieve.operators.dedupe.claim_deliveries` and ``batch_id``)."""
    key_type = deliveries.schema[key].dataType.simpleString()

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        ledger = claim_ledger(batch.sparkSession, f"{out_dir.rstrip('/')}/ledger", key, key_type, compact_every)
        first, last = time_range(batch, ts)
        with checkpoints_released():
            claims = dedupe.claim_deliveries(batch, key, ts, tie, ok, finished_at, ttl, claim_partitions,
                                             initial_state=live_claims(ledger, batch_id, first), with_state=True)
            _write(claims.drop("state_until", "state_fin", "state_final"), f"{out_dir.rstrip('/')}/claims", batch_id)
            close_ledger(ledger, dedupe.ledger_rows(claims, key, ts, tie), batch_id, last, ledger_keep)

    return _start(deliveries, run_batch, out_dir, checkpoint_location, trigger)


def _start(deliveries: DataFrame, run_batch: Callable[[DataFrame, int], None], out_dir: str,
           checkpoint_location: str | None, trigger: dict | None) -> StreamingQuery:
    writer = deliveries.writeStream.foreachBatch(run_batch).option(
        "checkpointLocation", checkpoint_location or f"{out_dir.rstrip('/')}/_checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
