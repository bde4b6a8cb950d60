"""Settings of the session that hold while a stream starts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: The order within a micro-batch needs a sort of each partition, which Spark refuses in streams because it knows no end of
#: them, though a batch has one.
SORTED = {"spark.sql.streaming.unsupportedOperationCheck": "false"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings; those of before are put back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
