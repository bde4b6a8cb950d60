"""A detector dataset as one COCO document for each split, in a folder that is there whole or not at all.

    annotations/<split>.json    categories, images and annotations
    manifest.json               classes, and of each split its counts and the document's size and sha256

Tasks write documents into a staging folder beside the target. The commit names them by their split, adds the manifest and
moves the folder into place; an abort removes it. A document is a file that its reader takes whole, so one task writes it,
row by row as they come.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from platehouse.functions.scratch import staged
from platehouse.sources import files
from platehouse.sources.stores import Store

IMAGE, ANNOTATION = 0, 1


@dataclass
class _Documents(WriterCommitMessage):
    written: list[dict] = field(default_factory=list)


class _Document:
    """One split's document while it is written."""

    def __init__(self, store: Store, folder: str, split: str, classes: list[str]):
        self.facts = {"split": split, "file": f"{folder}/{uuid4().hex}.json", "images": 0, "annotations": 0, "bytes": 0}
        self.out, self.sha, self.kind = store.writer(self.facts["file"]), hashlib.sha256(), IMAGE
        categories = [{"id": i, "name": c} for i, c in enumerate(classes, 1)]
        self._put('{"categories":' + json.dumps(categories, separators=(",", ":"), ensure_ascii=False) + ',"images":[')

    def _put(self, text: str) -> None:
        data = text.encode()
        self.out.write(data)
        self.sha.update(data)
        self.facts["bytes"] += len(data)

    def add(self, kind: int, body: str) -> None:
        name = "annotations" if kind == ANNOTATION else "images"
        if kind != self.kind:
            self._put('],"annotations":[')
            self.kind = kind
        self._put(("," if self.facts[name] else "") + body)
        self.facts[name] += 1

    def close(self) -> dict:
        self._put("]}" if self.kind == ANNOTATION else '],"annotations":[]}')
        self.out.close()
        return self.facts | {"sha256": self.sha.hexdigest()}


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, classes: list[str]):
        self.parent, self.name = path.rstrip("/").rsplit("/", 1)
        self.classes, self.staging = classes, f".{self.name}-{uuid4().hex}"
        if Store(self.parent).has(self.name):
            raise ValueError(f"{path} already exists")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Documents:
        store, done, open_ = Store(self.parent), _Documents(), None
        for batch in iterator:
            for split, kind, body in zip(*(batch.column(c).to_pylist() for c in ("split", "kind", "body")), strict=True):
                if open_ is None or open_.facts["split"] != split:
                    if open_ is not None:
                        done.written.append(open_.close())
                    open_ = _Document(store, self.staging, split, self.classes)
                open_.add(kind, body)
        if open_ is not None:
            done.written.append(open_.close())
        return done

    def commit(self, messages: list[_Documents | None]) -> None:
        store, splits = Store(self.parent), {}
        for facts in (f for m in messages if m is not None for f in m.written):
            store.move(facts.pop("file"), f"{self.staging}/whole/annotations/{facts['split']}.json")
            splits[facts.pop("split")] = facts
        store.put(f"{self.staging}/whole/manifest.json", {"classes": self.classes, "splits": splits})
        if store.has(self.name):
            self.abort(messages)
            raise ValueError(f"{self.name} already exists")
        store.move(f"{self.staging}/whole", self.name)
        store.drop(self.staging)

    def abort(self, messages: list[_Documents | None]) -> None:
        Store(self.parent).drop(self.staging)


class CocoSink(DataSource):
    """Options: path and classes (a JSON list). Rows (split, kind, body) come dealt by split, images before annotations."""

    @classmethod
    def name(cls) -> str:
        return "coco"

    def schema(self) -> str:
        return "split string, kind int, body string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], json.loads(self.options["classes"]))


def export(samples: DataFrame, classes: list[str], path: str) -> None:
    """Write a detector dataset. samples: sample_id, group_id, camera_id, split, annotations (class_name, bbox).

    Ids are numbers, each once in the dataset. A class that is not listed, a split without a name or one with a slash is
    an error, as is a path that exists; then nothing is there.
    """
    spark = samples.sparkSession
    spark.dataSource.register(CocoSink)
    name = F.substring(F.sha2("sample_id", 256), 1, 24)
    split = F.when(F.col("split").rlike("^[^/]+$"), F.col("split")).otherwise(F.raise_error(F.lit("a split needs a name without a slash")).cast("string"))
    images = staged(samples.select(split.alias("split"), "sample_id", "group_id", "camera_id", "annotations", (F.monotonically_increasing_id() + 1).alias("id"), F.concat_ws("/", F.lit("images"), "split", F.substring(name, 1, 2), F.concat(name, F.lit(".jpg"))).alias("file_name")), "coco")
    category = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("a.class_name"))
    known = F.when(category > 0, category).otherwise(F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce("a.class_name", F.lit("null")))).cast("long"))
    boxes = images.select("split", F.col("id").alias("image_id"), F.explode("annotations").alias("a")).select("split", (F.monotonically_increasing_id() + 1).alias("id"), "image_id", known.alias("category_id"), F.col("a.bbox").alias("bbox"), (F.col("a.bbox")[2] * F.col("a.bbox")[3]).alias("area"), F.lit(0).alias("iscrowd"))
    rows = images.select("split", F.lit(IMAGE).alias("kind"), "id", F.to_json(F.struct("id", "file_name", "sample_id", "group_id", "camera_id")).alias("body"))
    rows = rows.unionByName(boxes.select("split", F.lit(ANNOTATION).alias("kind"), "id", F.to_json(F.struct("id", "image_id", "category_id", "bbox", "area", "iscrowd")).alias("body")))
    dealt = rows.repartition("split").sortWithinPartitions("split", "kind", "id").select("split", "kind", "body")
    dealt.write.format("coco").option("path", path).option("classes", json.dumps(classes)).mode("append").save()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(split, images, annotations, bytes, sha256) of a committed dataset."""
    splits = F.from_json("value", "splits MAP<STRING, STRUCT<images: LONG, annotations: LONG, bytes: LONG, sha256: STRING>>")["splits"]
    return spark.read.text(f"{path}/manifest.json", wholetext=True).select(F.explode(splits).alias("split", "_f")).select("split", "_f.*")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(split, problem) where a document is not what the manifest says: MISSING, UNKNOWN or CHECKSUM."""
    found = files.inventory(spark, f"{path}/annotations").select(F.regexp_extract("path", "([^/]+)[.]json$", 1).alias("split"), "length", F.col("sha256").alias("_sha"))
    both = manifest(spark, path).select("split", "bytes", "sha256").join(found, "split", "full_outer")
    problem = F.when(F.col("_sha").isNull(), "MISSING").when(F.col("sha256").isNull(), "UNKNOWN").when((F.col("_sha") != F.col("sha256")) | (F.col("length") != F.col("bytes")), "CHECKSUM")
    return both.select("split", problem.alias("problem")).where("problem IS NOT NULL")
