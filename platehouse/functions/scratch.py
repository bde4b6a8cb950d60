"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session may leave the setting out; it gets a folder of its own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="platehouse-")
    return _LOCAL[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has yet."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written and read again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
