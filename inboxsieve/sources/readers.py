"""Sources of the triage model: webhook deliveries (JSON files,
batch or stream), labelled case tables (quoted CSV), the service-type
definition (JSON object of objects), recorded model completions (parquet)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.inference import RESPONSE_SCHEMA
from ..session import read_text

# The webhook event as delivered (one JSON object per line)
WEBHOOK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("data", T.StructType([T.StructField("email_id", T.StringType())])),
])

CASE_COLUMNS = ["__description", "pathType", "subject", "body", "expectedServiceTypeId",
                "expectedServiceTypeIds", "expectedShouldNotify", "minConfidence", "maxConfidence"]


def _placed(raw: DataFrame) -> DataFrame:
    """The rows with ``position``: their number in the block of the file they
    were read from.  A task reads a block from its beginning to its end, so
    the number is the same in every run that cuts the files alike."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = batch.column("_file"), batch.column("_block").to_numpy(zero_copy_only=False)
            new = np.zeros(len(block), dtype=bool)
            new[1:] = pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
            new[0] = (file[0].as_py(), int(block[0])) != place
            rows = np.arange(len(block))
            begin = np.maximum.accumulate(np.where(new, rows, -1))
            position = np.where(begin < 0, seen + rows, rows - begin)
            place, seen = (file[-1].as_py(), int(block[-1])), int(position[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(position)], [*batch.schema.names, "_position"])

    return raw.mapInArrow(count, f"{fields}, _position bigint")


def _deliveries(raw: DataFrame) -> DataFrame:
    """A delivery is received when its file arrives (the file's modification
    time), whatever time its event names (``created_at``).  An event without an
    id is named by where it stands: equal ones are deliveries of their own."""
    rows = _placed(raw.select("*", F.col("_metadata.file_path").alias("_file"),
                              F.col("_metadata.file_block_start").alias("_block"),
                              F.col("_metadata.file_modification_time").alias("_arrived")))
    place = F.sha2(F.concat_ws("#", "_file", F.col("_block").cast("string"), F.col("_position").cast("string")), 256)
    return rows.select(
        F.coalesce(F.col("id"), place).alias("delivery_id"),
        F.col("type"),
        F.col("data.email_id").alias("email_id"),
        F.col("_arrived").alias("received_at"),
        F.col("created_at"),
    )


def read_webhook_events(spark: SparkSession, path: str) -> DataFrame:
    """Webhook deliveries from JSON-lines files: ``delivery_id, type,
    email_id, received_at, created_at``."""
    return _deliveries(spark.read.schema(WEBHOOK_SCHEMA).json(path))


def stream_webhook_events(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream (new files in ``path``)."""
    reader = spark.readStream.schema(WEBHOOK_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _deliveries(reader.json(path))


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases from a header CSV with double-quoted fields (commas
    inside quotes), all columns as STRING (empty cell -> NULL), renamed to
    snake case, plus ``case_no`` increasing in file order."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in CASE_COLUMNS])
    raw = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
           .option("multiLine", True).schema(schema).csv(path))
    return raw.select(
        F.monotonically_increasing_id().alias("case_no"),
        F.col("__description").alias("description"),
        F.col("pathType").alias("path_type"),
        "subject", "body",
        F.col("expectedServiceTypeId").alias("expected_service_type_id"),
        F.col("expectedServiceTypeIds").alias("expected_service_type_ids"),
        F.col("expectedShouldNotify").alias("expected_should_notify"),
        F.col("minConfidence").alias("min_confidence"),
        F.col("maxConfidence").alias("max_confidence"),
    )


def load_service_types(spark: SparkSession, path: str) -> list[dict]:
    """A JSON object of objects ``{id: {label, description}}`` as the ordered
    list the operators take (definition order is significant).  This is
    configuration of a handful of rows; it may lie on any path Spark reads."""
    defs = json.loads(read_text(spark, path))
    return [{"id": k, "label": v["label"], "description": v["description"]} for k, v in defs.items()]


def read_recorded_completions(spark: SparkSession, path: str) -> DataFrame:
    """Recorded model responses keyed by ``request_hash`` (parquet)."""
    return spark.read.schema(RESPONSE_SCHEMA).parquet(path)
