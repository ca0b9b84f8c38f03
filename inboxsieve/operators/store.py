"""O27 result_store: persist categorization results, redacted, with a
retention switch (the design asks for a non-retention flow).

The store is a parquet table partitioned by day, keyed by mail and claim time.
Writing is an upsert of the days that the new rows touch, so a batch that is
written again, by a retry for instance, stays one copy.  Retained content ages:
:func:`expire_content` blanks it in days before a bound, the results stay.
One writer at a time; readers between see whole days.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, exists

CONTENT_COLUMNS = ("subject", "body", "text", "user_prompt", "system_prompt", "content", "explanation",
                   "alert_reason", "from", "raw_subject", "redacted_subject", "redacted_body")
KEY = ("email_id", "received_at")


def result_store(results: DataFrame, retain_content: bool = False, ts: str = "received_at") -> DataFrame:
    """The rows to store: every result column, minus text content unless
    ``retain_content``; plus a ``dt`` date partition column from ``ts``."""
    out = results if retain_content else results.drop(*[c for c in CONTENT_COLUMNS if c in results.columns])
    if ts in out.columns:
        out = out.withColumn("dt", F.to_date(F.col(ts)))
    return out


def _replace_days(rows: DataFrame, path: str) -> None:
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path))


def _days(rows: DataFrame, among: DataFrame) -> DataFrame:
    """The rows of the days that ``among`` has; a NULL day is a day.  The list
    of days goes into the scan as a filter (one entry a day)."""
    days = [r["dt"] for r in among.select("dt").distinct().collect()]
    named = [d for d in days if d is not None]
    wanted = F.col("dt").isin(named) if named else F.lit(False)
    return rows.where(wanted | F.col("dt").isNull() if None in days else wanted)


def write_result_store(rows: DataFrame, path: str, key: tuple[str, ...] = KEY) -> None:
    """Upsert rows (with ``dt``) by ``key``: a stored row with the key of a new
    one is replaced.  Of new rows with one key the least stays.  Only the days
    of the new rows are read and written; columns that one side lacks are
    NULL."""
    spark = rows.sparkSession
    fields = [c for c in rows.columns if c not in (*key, "dt")]
    one = rows.groupBy("dt", *key).agg(F.min(F.struct(*fields)).alias("_r"))
    new = checkpoint(one.select(*key, *[F.col(f"_r.{c}").alias(c) for c in fields], "dt"))
    if exists(spark, path):
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*key, "dt")]
        old = _days(spark.read.parquet(path), new).alias("o").join(
            new.select(*key, "dt").alias("n"), on=same, how="left_anti")
        # the days are read before they are replaced
        new = checkpoint(new.unionByName(old, allowMissingColumns=True))
    _replace_days(new, path)


def expire_content(spark: SparkSession, path: str, before: _dt.date) -> int:
    """Blank the retained content of days before ``before`` (and of rows
    without a day, whose age is not known); gives the number of days that were
    rewritten.  Days without content are left alone."""
    table = spark.read.parquet(path)
    content = [c for c in CONTENT_COLUMNS if c in table.columns]
    if not content:
        return 0
    old = table.where((F.col("dt") < F.lit(before)) | F.col("dt").isNull())
    kept = F.greatest(*[F.col(c).isNotNull().cast("int") for c in content], F.lit(0))
    due = checkpoint(old.groupBy("dt").agg(F.max(kept).alias("kept")).where("kept = 1"))
    days = due.count()
    if days:
        blank = {c: F.lit(None).cast(table.schema[c].dataType) for c in content}
        _replace_days(checkpoint(_days(old, due).withColumns(blank)), path)
    return days
