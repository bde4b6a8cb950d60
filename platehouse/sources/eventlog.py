"""A log of event documents that updates rewrite: parts that are only added, a list of those that count, and compaction.

`log.json` names the parts in order, each a folder of JSON lines. An update adds a part with the new revisions of its
events; readers take of each event the highest revision, of equal ones that of the last part. Compaction writes one part of
what counts and lets the list name that alone, so a crash at any time leaves a log that reads as before or as after.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platehouse.sources import files
from platehouse.sources.stores import Store

_LIST = "log.json"


def parts(path: str) -> list[str]:
    """The parts that count, the oldest first."""
    store = Store(path)
    return store.get(_LIST)["parts"] if store.has(_LIST) else []


def _write(events: DataFrame, path: str) -> str:
    name = f"part-{uuid4().hex}"
    events.write.json(f"{path}/{name}")
    return name


def add(events: DataFrame, path: str) -> None:
    """Add event documents: new events, or new revisions of those that the log has. Only they are written."""
    name = _write(events, path)
    Store(path).put(_LIST, {"parts": [*parts(path), name]})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each event once, as it is now; a broken line is an error."""
    found = None
    for place, name in enumerate(parts(path)):
        some = files.read_event_log(spark, f"{path}/{name}").withColumn("_part", F.lit(place))
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], files.EVENT_SCHEMA)
    names = [c for c in found.columns if c != "_part"]
    revision = F.struct(F.coalesce("plate.review.revision", F.lit(0)), "_part", F.xxhash64(*names))
    return found.groupBy("_id").agg(F.max_by(F.struct(*names), revision).alias("_e")).select("_e.*")


def compact(spark: SparkSession, path: str) -> list[str]:
    """Write what counts as one part; returns the parts that nothing names any more, for removal when no reader is left."""
    before = parts(path)
    if len(before) > 1:
        name = _write(read(spark, path), path)
        Store(path).put(_LIST, {"parts": [name]})
        return before
    return []
