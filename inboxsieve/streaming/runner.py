"""Run a streaming query to completion (``availableNow``) into parquet in the
shared checkpoint folder, and read the result back as a batch DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import checkpoint_dir


def scratch_path(spark, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def run_available_now(stream: DataFrame, name: str, timeout_s: float | None = None) -> DataFrame:
    """Drain the stream; there is no time limit unless the caller sets one."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", f"{base}/out").option("checkpointLocation", f"{base}/chk")
             .trigger(availableNow=True).queryName(f"{name}_{uuid.uuid4().hex[:8]}").start())
    finished = query.awaitTermination(timeout_s) if timeout_s else query.awaitTermination()
    if finished is False:
        query.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout_s}s")
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
