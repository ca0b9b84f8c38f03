"""A keyed table as a snapshot and the deltas after it.

Every batch writes its changed rows as one delta, in a folder of its own that a
retry overwrites whole, so a retried batch leaves nothing stale.  From time to
time the state is written as a new snapshot.  It becomes current by one small
manifest file, written beside and renamed, so a reader sees the old snapshot
with its deltas or the new one, never a mixture.  A reader of batch ``b`` takes
the newest snapshot of the batches before ``b``: a retry sees what the first
attempt saw.

Files read per batch are bounded by those of one snapshot and of
``every`` deltas (two intervals of deltas at most stay on disk), whatever the
number of batches.  The driver holds file names only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, file_names

BATCH = "_batch"


class KeyedLog:
    """``key`` names a row; of its rows that of the latest batch counts."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, every: int = 10):
        self.spark, self.path, self.key, self.schema, self.every = spark, path.rstrip("/"), key, schema, every

    def _names(self, folder: str) -> list[str]:
        return file_names(self.spark, f"{self.path}/{folder}")

    def _manifests(self) -> list[tuple[int, str]]:
        """``(last batch in it, snapshot folder)``, oldest first."""
        names = [n.split(".") for n in self._names("manifests") if n.startswith("upto.")]
        return sorted((int(batch), snapshot) for _, batch, snapshot in names)

    def _deltas(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._names("deltas") if n.startswith("batch="))

    def parts(self, before: int) -> list[tuple[int, str]]:
        """The folders that make up the state before a batch."""
        known = [m for m in self._manifests() if m[0] < before]
        upto, out = (known[-1][0], [(known[-1][0], f"snapshots/{known[-1][1]}")]) if known else (-1, [])
        return out + [(b, f"deltas/batch={b}") for b in self._deltas() if upto < b < before]

    def read(self, before: int, where: str | None = None) -> DataFrame | None:
        """The state before a batch.  ``where`` reaches the files' scan; if it
        holds for a row, it has to hold for the key's later rows."""
        parts = self.parts(before)
        if not parts:
            return None
        rows = None
        for batch, folder in parts:
            part = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").withColumn(BATCH, F.lit(batch))
            part = part.where(where) if where else part
            rows = part if rows is None else rows.unionByName(part)
        fields = [c for c in rows.columns if c not in (self.key, BATCH)]
        latest = rows.groupBy(self.key).agg(F.max_by(F.struct(*fields), F.col(BATCH)).alias("_r"))
        return latest.select(self.key, *[F.col(f"_r.{c}").alias(c) for c in fields])

    def write(self, rows: DataFrame, batch: int) -> None:
        """The delta of a batch, in place of what an earlier attempt left."""
        for upto, snapshot in self._manifests():
            if upto >= batch:
                delete(self.spark, f"{self.path}/manifests/upto.{upto}.{snapshot}")
        rows.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")

    def due(self, batch: int) -> bool:
        known = [m[0] for m in self._manifests() if m[0] <= batch]
        return batch - (known[-1] if known else -1) >= self.every

    def compact(self, batch: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Write the state after a batch as a snapshot, switch to it, and
        delete what neither it nor the one before needs.  ``keep`` drops rows
        for good."""
        state = self.read(batch + 1)
        if state is None:
            return
        name = uuid.uuid4().hex
        keep(state).write.parquet(f"{self.path}/snapshots/{name}")
        old = self._manifests()
        self._switch(batch, name)
        held = [m for m in old if m[0] < batch][-1:]  # for a retry of this batch
        for upto, snapshot in old:
            if (upto, snapshot) not in held:
                delete(self.spark, f"{self.path}/manifests/upto.{upto}.{snapshot}")
        stay = {name, *(s for _, s in held)}
        for snapshot in self._names("snapshots"):
            if snapshot not in stay:
                delete(self.spark, f"{self.path}/snapshots/{snapshot}")
        for b in self._deltas():
            if b <= (held[0][0] if held else -1):
                delete(self.spark, f"{self.path}/deltas/batch={b}")

    def _switch(self, batch: int, snapshot: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path
        beside = path(f"{self.path}/manifests/new.{batch}.{snapshot}")
        fs = beside.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.create(beside, True).close()
        if not fs.rename(beside, path(f"{self.path}/manifests/upto.{batch}.{snapshot}")):
            raise OSError(f"{self.path}: the snapshot of batch {batch} could not be made current")
