"""Session helpers: build a session for tests/bench, and set the runtime
options the operators rely on.  Library code never creates a session."""

from __future__ import annotations

import contextlib
import contextvars
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL options the operators need; set on whatever session is given.
RUNTIME_CONF = {
    # JSON.parse keeps the last of duplicate keys; VARIANT does so only here.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from ``spark.checkpoint.dir`` (or the SparkContext).  Only when the
    session names none (a local test run) do we set one of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; set it to a shared (HDFS/S3) folder"
            )
        configured = os.path.join("/tmp", "inboxsieve-checkpoints")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder or file of the shared file system, if it is there."""
    place, fs = _file_system(spark, path)
    fs.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _file_system(spark, path)
    return fs.exists(place)


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder (none if it is not there)."""
    place, fs = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder that readers take for data."""
    return [f"{path.rstrip('/')}/{n}" for n in file_names(spark, path) if n[0] not in "._"]


def read_text(spark: SparkSession, path: str) -> str:
    """A small file (configuration), wherever Spark can read it."""
    return spark.read.text(path, wholetext=True).first()[0]


_held: contextvars.ContextVar[list | None] = contextvars.ContextVar("held", default=None)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder; inside
    :func:`checkpoints_released` its files go at the end of the block."""
    checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    held = _held.get()
    if held is not None:
        held.append(done)
    return done


@contextlib.contextmanager
def checkpoints_released() -> Iterator[None]:
    """Delete the files of all checkpoints made inside the block at its end,
    whether or not the session cleans them up: a stream makes some in every
    micro-batch.  Nothing that reads them may outlive the block."""
    token = _held.set([])
    try:
        yield
    finally:
        held = _held.get() or []
        _held.reset(token)
        for df in held:
            file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
            if file.isDefined():
                delete(df.sparkSession, file.get())


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "inboxsieve") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        # checkpoint files go when nothing refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    checkpoint_dir(spark)
    return spark
