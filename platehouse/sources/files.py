"""Readers and writers: event logs, envelopes, COCO, YOLO labels, CSV and inventories. All paths go to Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platehouse.functions.scratch import staged

#: The event document; open maps are kept as JSON text.
PLATE = "raw STRING, normalized STRING, confidence DOUBLE, observationCount INT, partial BOOLEAN"
EVENT_SCHEMA = (
    "_id STRING, schemaVersion INT, camera STRUCT<id STRING, name STRING, zone STRING>, trackId STRING, vehicleId STRING, eventType STRING, direction STRING, status STRING, "
    f"plate STRUCT<{PLATE}, prediction STRUCT<{PLATE}>, review STRUCT<normalized STRING, revision INT, reviewedAt TIMESTAMP>, final STRING>, "
    "vehicle STRUCT<type STRING, confidence DOUBLE, color STRING>, media STRUCT<snapshotKey STRING, vehicleCropKey STRING, plateCropKey STRING, clipKey STRING>, "
    "occurredAt TIMESTAMP, createdAt TIMESTAMP, metadata STRING"
)
ENVELOPE_SCHEMA = "id STRING, type STRING, source STRING, correlationId STRING, occurredAt TIMESTAMP, data STRING"


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Event documents of a JSON-lines log: blank lines are skipped, a broken line is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", EVENT_SCHEMA, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def write_event_log(events: DataFrame, path: str) -> None:
    """Append event documents as JSON lines."""
    events.write.mode("append").json(path)


def flatten_events(documents: DataFrame) -> DataFrame:
    """Documents of both versions as the columns that operators use: predictions come from plate.prediction or plate."""
    p = lambda f: F.coalesce(F.col(f"plate.prediction.{f}"), F.col(f"plate.{f}"))
    return documents.select(F.col("_id").alias("id"), F.col("schemaVersion").alias("schema_version"), F.col("camera.id").alias("camera_id"), F.col("camera.zone").alias("zone"), F.col("trackId").alias("track_id"), F.col("vehicleId").alias("vehicle_id"), F.col("eventType").alias("event_type"), "direction", "status", p("normalized").alias("plate"), F.coalesce("plate.final", "plate.review.normalized").alias("plate_final"), p("confidence").alias("plate_confidence"), F.col("vehicle.type").alias("vehicle_type"), F.col("vehicle.color").alias("color"), F.col("occurredAt").alias("occurred_at"))


def encode_envelope(documents: DataFrame) -> DataFrame:
    """One JSON text for each event document, as the bus carries it."""
    body = F.to_json(F.struct(*documents.columns))
    return documents.select(F.to_json(F.struct(F.col("_id").alias("id"), F.concat(F.lit("vehicle.event."), F.lower("eventType")).alias("type"), F.concat(F.lit("camera/"), F.col("camera.id")).alias("source"), F.col("trackId").alias("correlationId"), F.col("occurredAt").alias("occurredAt"), body.alias("data"))).alias("value"))


def decode_envelope(messages: DataFrame) -> DataFrame:
    """Messages with `event` and reject_reason, null where id, type, source, track and time agree with the event.

    A filter by reject_reason stops at the generator, as it would otherwise repeat the parsing of JSON for each of its terms.
    """
    e = messages.withColumn("_m", F.from_json("value", ENVELOPE_SCHEMA)).withColumn("event", F.from_json("_m.data", EVENT_SCHEMA))
    agree = {
        "INVALID_JSON": F.col("_m").isNotNull() & F.col("_m.id").isNotNull(), "INVALID_EVENT": F.col("event").isNotNull() & F.col("event._id").isNotNull(), "ID_MISMATCH": F.col("_m.id") == F.col("event._id"),
        "TYPE_MISMATCH": F.col("_m.type") == F.concat(F.lit("vehicle.event."), F.lower("event.eventType")), "SOURCE_MISMATCH": F.col("_m.source") == F.concat(F.lit("camera/"), F.col("event.camera.id")),
        "CORRELATION_MISMATCH": F.col("_m.correlationId") == F.col("event.trackId"), "TIME_MISMATCH": F.col("_m.occurredAt") == F.col("event.occurredAt"),
    }
    reason = F.get(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in agree.items()])), F.lit(0))
    return e.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in messages.columns], "event", reason.alias("reject_reason")))))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, categories and annotations of a COCO file."""
    schema = T.StructType.fromDDL("images ARRAY<STRUCT<id BIGINT, file_name STRING, width INT, height INT>>, categories ARRAY<STRUCT<id BIGINT, name STRING>>, annotations ARRAY<STRUCT<id BIGINT, image_id BIGINT, category_id BIGINT, bbox ARRAY<DOUBLE>>>")
    whole = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return tuple(whole.select(F.inline(c)) for c in ("images", "categories", "annotations"))


def broken_references(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations (id, problem) without an image or category, or with a box that is none."""
    i, c = images.select(F.col("id").alias("image_id"), F.lit(1).alias("_i")), categories.select(F.col("id").alias("category_id"), F.lit(1).alias("_c"))
    box = F.col("bbox")
    bad = F.when(F.col("_i").isNull(), "UNKNOWN_IMAGE").when(F.col("_c").isNull(), "UNKNOWN_CATEGORY").when((F.size(box) != 4) | (F.get(box, F.lit(0)) < 0) | (F.get(box, F.lit(1)) < 0) | (F.get(box, F.lit(2)) <= 0) | (F.get(box, F.lit(3)) <= 0), "INVALID_BOX")
    return annotations.join(i, "image_id", "left").join(c, "category_id", "left").select("id", bad.alias("problem")).where("problem IS NOT NULL")


def parse_yolo_polygons(lines: DataFrame, classes: list[int], width: Column, height: Column) -> DataFrame:
    """Lines (source, line, value) of polygon labels: class_id, points in pixels, box, adjusted, reject_reason.

    Reasons, the first that holds: NON_NUMERIC; SCHEMA (class, fewer than three points, odd count); COORD_RANGE (beyond
    [-0.03, 1.03]); DEGENERATE (a side under one pixel). Coordinates within the range are clamped to [0, 1].
    """
    parts = F.split(F.trim("value"), r"\s+")
    numbers = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("double"))
    t = lines.where(F.trim("value") != "").withColumn("class_id", F.get(parts, F.lit(0)).try_cast("int")).withColumn("_v", numbers)
    clamped = F.transform("_v", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    t = t.withColumn("_c", clamped).withColumn("points", F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("_c") / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct((F.get(F.col("_c"), 2 * i) * width).alias("x"), (F.get(F.col("_c"), 2 * i + 1) * height).alias("y"))))
    low_x, high_x, low_y, high_y = F.array_min("points.x"), F.array_max("points.x"), F.array_min("points.y"), F.array_max("points.y")
    text = F.col("class_id").isNull() | F.exists("_v", lambda v: v.isNull())
    shape = ~F.col("class_id").isin(*classes) | (F.size("_v") < 6) | (F.size("_v") % 2 == 1)
    reason = F.when(text, "NON_NUMERIC").when(shape, "SCHEMA").when(F.exists("_v", lambda v: (v < -0.03) | (v > 1.03)), "COORD_RANGE").when((high_x - low_x < 1) | (high_y - low_y < 1), "DEGENERATE")
    out = t.withColumn("reject_reason", reason).withColumn("adjusted", F.exists("_v", lambda v: (v < 0) | (v > 1))).withColumn("bbox", F.array(low_x, low_y, high_x - low_x, high_y - low_y))
    return out.drop("_v", "_c")


def parse_yolo_boxes(lines: DataFrame, width: Column, height: Column) -> DataFrame:
    """Lines (source, line, value) of class and centre box as corner boxes in pixels; any bad line is an error."""
    parts = F.split(F.trim("value"), r"\s+")
    v = [F.get(parts, F.lit(i)).try_cast("double") for i in range(5)]
    good = F.size(parts) == 5
    for x in v:
        good &= x.isNotNull()
    cx, cy, w, h = v[1:]
    left, right = F.greatest(F.lit(0.0), cx - w / 2), F.least(F.lit(1.0), cx + w / 2)
    top, bottom = F.greatest(F.lit(0.0), cy - h / 2), F.least(F.lit(1.0), cy + h / 2)
    box = F.array(left * width, top * height, (right - left) * width, (bottom - top) * height)
    return lines.where(F.trim("value") != "").select("source", "line", v[0].cast("int").alias("class_id"), F.when(good, box).otherwise(F.raise_error(F.concat(F.lit("bad label: "), "value"))).alias("bbox"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header line and a stated schema."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def usable_boxes(boxes: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Rows of known labels that are no group, depiction or inside view, with class_name."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    flags = F.col("IsGroupOf").cast("int") + F.col("IsDepiction").cast("int") + F.col("IsInside").cast("int")
    return boxes.withColumn("class_name", F.try_element_at(names, F.col("LabelName"))).where(F.col("class_name").isNotNull() & (flags == 0))


#: Bytes of a file that a task holds at once.
PIECE = 1 << 23


def _pieces(path: str) -> Iterator[bytes]:
    """A file's content, a piece at a time. Spark's paths are no encoded URIs, so only scheme and host are parsed."""
    if "://" in path:
        scheme, rest = path.split("://", 1)
        host, _, name = rest.partition("/")
        store, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
        name = f"{root.rstrip('/')}/{name}"
    else:
        store, name = fs.LocalFileSystem(), f"/{path.removeprefix('file:').lstrip('/')}"
    with store.open_input_stream(name) as stream:
        while piece := stream.read(PIECE):
            yield piece


def inventory(spark: SparkSession, path: str, whole: Column | None = None) -> DataFrame:
    """Files below a folder with their size and digest.

    Contents are no rows: a task streams each file by PIECE bytes. `whole` names, from `path`, the file of which a part is
    one; the parts of a name are one file (path: that name) and follow each other in order of their paths.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    files = found.groupBy((F.col("path") if whole is None else whole).alias("path")).agg(F.sum("length").alias("length"), F.sort_array(F.collect_list("path")).alias("_parts"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, length, parts in batch.itertuples(index=False):
                total = hashlib.sha256()
                for part in parts:
                    for piece in _pieces(part):
                        total.update(piece)
                yield pd.DataFrame({"path": [name], "length": [length], "sha256": [total.hexdigest()]})

    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(digest, "path string, length long, sha256 string")


def _content(*columns: str) -> tuple[Column, Column]:
    """Number of rows and a digest of all of them: a sum of hashes, which counts a row as often as it stands."""
    return F.count("*").alias("samples"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("checksum")


def export_labels(samples: DataFrame, path: str) -> DataFrame:
    """Write labels by split as JSON lines and return the manifest: samples and a digest of all columns for each split."""
    samples.write.partitionBy("split").mode("errorifexists").json(path)
    return samples.groupBy("split").agg(*_content(*_covered(samples)))


def _covered(samples: DataFrame) -> list[str]:
    """What a checksum covers: all columns but the split, by name."""
    return sorted(c for c in samples.columns if c != "split")


def verify_export(spark: SparkSession, path: str, schema: str, manifest: DataFrame) -> DataFrame:
    """Splits whose files differ from the manifest."""
    rows = spark.read.schema(schema + ", split STRING").json(path)
    found = rows.groupBy("split").agg(*_content(*_covered(rows)))
    found = found.select("split", F.col("samples").alias("_n"), F.col("checksum").alias("_sum"))
    return manifest.join(found, "split", "full_outer").where(~(F.col("samples").eqNullSafe(F.col("_n")) & F.col("checksum").eqNullSafe(F.col("_sum"))))


_BOX = "STRUCT<className STRING, bbox ARRAY<DOUBLE>>"
SAMPLE_SCHEMA = f"sampleId STRING, imagePath STRING, groupId STRING, cameraId STRING, split STRING, annotations ARRAY<{_BOX}>"


def scan_samples(lines: DataFrame, most_bytes: int = 1_000_000) -> DataFrame:
    """Lines (line, value) of detector annotations: sample and problem (TOO_LONG, INVALID, DUPLICATE), blank lines left out.

    Of lines with one sampleId all but the first are duplicates. A dataset may be built only if no line has a problem.
    """
    parsed = lines.where(F.trim("value") != "").withColumn("sample", F.from_json("value", SAMPLE_SCHEMA)).withColumn("_id", F.col("sample.sampleId"))
    problem = F.when(F.octet_length("value") > most_bytes, "TOO_LONG").when(F.col("_id").isNull() | F.col("sample.imagePath").isNull() | F.col("sample.groupId").isNull(), "INVALID")
    parsed = parsed.withColumn("_problem", problem)
    first = parsed.where("_problem IS NULL").groupBy("_id").agg(F.min("line").alias("_first"))
    return parsed.join(first, "_id", "left").select("line", "sample", F.coalesce("_problem", F.when(F.col("line") > F.col("_first"), "DUPLICATE")).alias("problem"))


def digest_of_lines(lines: DataFrame) -> DataFrame:
    """One row: number of lines and a digest of all, the same in whatever order they are read: the sum of their sha256s' first 60 bits."""
    head = F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return lines.agg(F.count("*").alias("lines"), F.sum(head).cast("decimal(38,0)").cast("string").alias("digest"))


def ordered_digest(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of lines and a digest of files' lines (by..., line, value) that holds their order: two that change places
    change it. A line's number goes into its own hash, so tasks add up their parts in any order; null counts as no text."""
    text = F.concat_ws(":", F.col("line").cast("string"), F.coalesce("value", F.lit("")))
    head = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return lines.groupBy(*(by or [])).agg(F.count("*").alias("lines"), F.sum(head).cast("decimal(38,0)").cast("string").alias("digest"))


def export_coco(samples: DataFrame, classes: list[str], path: str) -> DataFrame:
    """Write a detector dataset and return its manifest, a row for each split.

    samples: sample_id, group_id, camera_id, split, annotations (class_name, bbox [x, y, w, h]). Below path go `images` and
    `annotations` by split, as rows of the COCO lists, `categories`, and last `manifest`: a folder without a manifest is
    no dataset. Image files are named by a hash of the sample in folders of its first two digits. Ids are numbers, each
    once; an unknown class is an error.
    """
    name = F.substring(F.sha2("sample_id", 256), 1, 24)
    numbered = samples.withColumn("image_id", F.monotonically_increasing_id() + 1).withColumn("file_name", F.concat_ws("/", F.lit("images"), "split", F.substring(name, 1, 2), F.concat(name, F.lit(".jpg"))))
    numbered = staged(numbered, "coco")
    numbered.select(F.col("image_id").alias("id"), "file_name", "sample_id", "group_id", "camera_id", "split").write.partitionBy("split").mode("errorifexists").json(f"{path}/images")
    category = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("a.class_name"))
    boxes = numbered.select("split", "image_id", F.explode("annotations").alias("a"))
    known = F.when(category > 0, category).otherwise(F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce("a.class_name", F.lit("null")))).cast("long"))
    boxes = boxes.select((F.monotonically_increasing_id() + 1).alias("id"), "image_id", known.alias("category_id"), F.col("a.bbox").alias("bbox"), (F.col("a.bbox")[2] * F.col("a.bbox")[3]).alias("area"), F.lit(0).alias("iscrowd"), "split")
    boxes.write.partitionBy("split").mode("errorifexists").json(f"{path}/annotations")
    spark = samples.sparkSession
    spark.createDataFrame([(i, c) for i, c in enumerate(classes, 1)], "id long, name string").coalesce(1).write.json(f"{path}/categories")
    manifest = _coco_facts(spark, path)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


_IMAGES = "id LONG, file_name STRING, sample_id STRING, group_id STRING, camera_id STRING, split STRING"
_ANNOTATIONS = "id LONG, image_id LONG, category_id LONG, bbox ARRAY<DOUBLE>, area DOUBLE, iscrowd INT, split STRING"


def read_coco_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories of an exported dataset."""
    read = lambda schema, part: spark.read.schema(schema).json(f"{path}/{part}")
    return read(_IMAGES, "images"), read(_ANNOTATIONS, "annotations"), read("id LONG, name STRING", "categories")


def _coco_facts(spark: SparkSession, path: str) -> DataFrame:
    images, boxes, _ = read_coco_export(spark, path)
    digest = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)")).cast("string")
    i = images.groupBy("split").agg(F.count("*").alias("images"), F.countDistinct("group_id").alias("group_count"), digest("id", "file_name", "sample_id", "group_id", "camera_id").alias("images_digest"))
    a = boxes.groupBy("split").agg(F.count("*").alias("annotations"), F.countDistinct("image_id").alias("_with"), digest("id", "image_id", "category_id", "bbox").alias("annotations_digest"))
    return i.join(a, "split", "full_outer").select("split", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("annotations", F.lit(0)).alias("annotations"), (F.coalesce("images", F.lit(0)) - F.coalesce("_with", F.lit(0))).alias("negatives"), F.coalesce("group_count", F.lit(0)).alias("group_count"), "images_digest", "annotations_digest")


def verify_coco(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """(problem, what, n) of an exported dataset; none where it is as its manifest says.

    CHECKSUM: counts or digests of a split differ; CATEGORIES: not these classes in this order; IMAGE_ID, ANNOTATION_ID:
    not once; FILE_NAME: of several images; GROUP: none, or in several splits (LEAKAGE); REFERENCE: no such image or class.
    """
    images, boxes, categories = read_coco_export(spark, path)
    facts = _coco_facts(spark, path)
    manifest = spark.read.schema(facts.schema).json(f"{path}/manifest")
    mine, theirs = facts.select("split", F.struct(*facts.columns).alias("_a")), manifest.select("split", F.struct(*facts.columns).alias("_b"))
    found = [mine.join(theirs, "split", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(F.lit("CHECKSUM").alias("problem"), F.col("split").alias("what"))]
    wanted = spark.createDataFrame([(i, c) for i, c in enumerate(classes, 1)], "id long, name string")
    odd = wanted.exceptAll(categories).union(categories.exceptAll(wanted))
    found.append(odd.select(F.lit("CATEGORIES"), "name"))
    for rows, column, problem in ((images, "id", "IMAGE_ID"), (images, "file_name", "FILE_NAME"), (boxes, "id", "ANNOTATION_ID")):
        found.append(rows.groupBy(F.col(column).cast("string").alias("_k")).count().where("count > 1").select(F.lit(problem), "_k"))
    found.append(images.where("coalesce(group_id, '') = ''").select(F.lit("GROUP"), "sample_id"))
    found.append(images.where("group_id IS NOT NULL").groupBy("group_id").agg(F.min("split").alias("_a"), F.max("split").alias("_b")).where("_a < _b").select(F.lit("LEAKAGE"), "group_id"))
    lost = boxes.join(images.select(F.col("id").alias("image_id"), F.lit(1).alias("_i")).distinct(), "image_id", "left").where(F.col("_i").isNull() | ~F.col("category_id").between(1, len(classes)) | F.col("category_id").isNull())
    found.append(lost.select(F.lit("REFERENCE"), F.col("id").cast("string")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.groupBy("problem", "what").agg(F.count("*").alias("n"))


def append_audit(entries: DataFrame, path: str) -> None:
    """Append entries (with id) to an audit log of JSON lines; an id that the log or another entry has is an error.

    The log is only ever added to. Its ids are read as one column.
    """
    spark = entries.sparkSession
    try:
        held = spark.read.schema("id STRING").json(path).select("id")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        held = spark.createDataFrame([], "id string")
    twice = entries.groupBy("id").count().where("count > 1").select("id").union(entries.join(held, "id", "left_semi").select("id"))
    first = twice.first()
    if first is not None:
        raise ValueError(f"audit record already exists: {first['id']}")
    entries.write.mode("append").json(path)


def health_metrics(health: DataFrame) -> DataFrame:
    """(metric, camera_id, value) rows of the newest health report of each camera."""
    last = health.groupBy("camera_id").agg(F.max_by(F.struct("status", "fps", "dropped_frames", "reconnects"), "updated_at").alias("h"))
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in (("camera_online", F.col("h.status") == "ONLINE"), ("camera_fps", F.col("h.fps")), ("camera_dropped_frames_total", F.col("h.dropped_frames")), ("camera_reconnects_total", F.col("h.reconnects")))])
    return last.select("camera_id", F.inline(pairs)).select("metric", "camera_id", "value")
