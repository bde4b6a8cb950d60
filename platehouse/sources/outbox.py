"""A durable outbox as a Spark data source: records with a sequence number and a checksum, committed in two phases.

    events.select("key", "payload").write.format("outbox").option("path", folder).mode("append").save()
    spark.readStream.format("outbox").option("path", folder).load()     # sequence, key, payload

Each task writes a segment that nobody sees. The commit names all segments of a write, in the order of their partitions,
and gives them their sequence numbers; an abort removes them. Readers take one task a segment. A stream's offset counts
commits, so replay goes on where the last finished batch ended. One writer works on a folder at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from platehouse.sources.stores import Store

SCHEMA = "sequence long, key string, payload string"
_PURGED = "purged.json"
#: Rows that a reader hands over at once.
BATCH_ROWS = 4_096


class CorruptOutbox(Exception):
    """A committed record is not what was written."""


def _checksum(place: int, key: str | None, payload: str | None) -> str:
    return hashlib.sha256(json.dumps([place, key, payload]).encode()).hexdigest()


@dataclass
class Segment(WriterCommitMessage):
    name: str
    rows: int
    part: int


@dataclass
class Committed(InputPartition):
    name: str
    rows: int
    first: int


def _commits(store: Store, after: int = 0, until: int | None = None) -> list[Committed]:
    """Segments of the commits after one up to another, in order."""
    found = []
    for name in store.names("commits"):
        if not name.endswith(".json"):
            continue
        number = int(name.split(".")[0])
        if after < number and (until is None or number <= until):
            found += [Committed(**segment) for segment in store.get(f"commits/{name}")["segments"]]
    return found


def _last(store: Store) -> int:
    return max((int(n.split(".")[0]) for n in store.names("commits") if n.endswith(".json")), default=0)


def _records(store: Store, segment: Committed) -> Iterator[pa.RecordBatch]:
    """A segment's records, each checked. Its last line may be torn off by a crash of the store: it is left out. Any other
    difference is an error."""
    held: list[tuple] = []
    place, rest = 0, b""
    with store.reader(f"segments/{segment.name}") as source:
        while chunk := source.read(1 << 20):
            *lines, rest = (rest + chunk).split(b"\n")
            for line in lines:
                held.append((segment.first + place, *_parsed(segment, place, line)))
                place += 1
                if len(held) == BATCH_ROWS:
                    yield _batch(held)
                    held = []
    if place < segment.rows - 1 or place > segment.rows or (rest and place == segment.rows):
        raise CorruptOutbox(f"{segment.name} has {place} of {segment.rows} records")
    if held:
        yield _batch(held)


def _parsed(segment: Committed, place: int, line: bytes) -> tuple[str | None, str | None]:
    try:
        key, payload, checksum = json.loads(line)
    except ValueError as error:
        raise CorruptOutbox(f"{segment.name}, record {place}") from error
    if checksum != _checksum(place, key, payload):
        raise CorruptOutbox(f"{segment.name}, record {place}")
    return key, payload


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    sequence, key, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(sequence, pa.int64()), pa.array(key, pa.string()), pa.array(payload, pa.string())], names=["sequence", "key", "payload"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segment:
        from pyspark import TaskContext

        name, place = f"{uuid4().hex}.jsonl", 0
        with Store(self.path).writer(f"segments/{name}") as out:
            for batch in iterator:
                lines = []
                for key, payload in zip(batch.column("key").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                    lines.append(json.dumps([key, payload, _checksum(place, key, payload)]) + "\n")
                    place += 1
                out.write("".join(lines).encode())
        return Segment(name, place, TaskContext.get().partitionId())

    def commit(self, messages: list[Segment | None]) -> None:
        store = Store(self.path)
        number = _last(store)
        first = store.get(f"commits/{number:020}.json")["next"] if number else 0
        segments = []
        for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.part):
            segments.append({"name": m.name, "rows": m.rows, "first": first})
            first += m.rows
        store.put(f"commits/{number + 1:020}.json", {"segments": segments, "next": first})

    def abort(self, messages: list[Segment | None]) -> None:
        for m in messages:
            if m is not None:
                Store(self.path).drop(f"segments/{m.name}")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Committed]:
        store = Store(self.path)
        gone = store.get(_PURGED)["commits"] if store.has(_PURGED) else 0
        return _commits(store, gone) or [Committed("", 0, 0)]

    def read(self, partition: Committed) -> Iterator[pa.RecordBatch]:
        return _records(Store(self.path), partition) if partition.name else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, purge: bool):
        self.path, self.purge = path, purge

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": _last(Store(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Committed]:
        return _commits(Store(self.path), start["commits"], end["commits"])

    def read(self, partition: Committed) -> Iterator[pa.RecordBatch]:
        return _records(Store(self.path), partition)

    def commit(self, end: dict) -> None:
        """What lies before a finished batch has been delivered; with `purge` its segments go."""
        if self.purge:
            store = Store(self.path)
            gone = store.get(_PURGED)["commits"] if store.has(_PURGED) else 0
            store.put(_PURGED, {"commits": max(gone, end["commits"])})
            for segment in _commits(store, gone, end["commits"]):
                store.drop(f"segments/{segment.name}")


class Outbox(DataSource):
    """Options: path, and for streams purge (true: remove segments once delivered)."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options["path"], self.options.get("purge", "false") == "true")

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("an outbox is only added to")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Outbox)


def stage(records: DataFrame, order: list[str], path: str) -> None:
    """Add records (key, payload and the order's columns) in that order, which their sequence numbers follow."""
    register(records.sparkSession)
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    records.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "payload").write.format("outbox").option("path", path).mode("append").save()


def replay(spark: SparkSession, path: str) -> DataFrame:
    """All committed records that no stream has purged."""
    register(spark)
    return spark.read.format("outbox").option("path", path).load()
