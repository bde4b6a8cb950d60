"""Sizes of the batches that go to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes that go to a Python worker at once, at most: texts may be long, and each batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Set the session's batches for Python workers to BATCH_ROWS and BATCH_BYTES, unless they are smaller already."""
    for setting, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{setting}"
        if not 0 < int(spark.conf.get(name).rstrip("bB")) <= most:
            spark.conf.set(name, most)
