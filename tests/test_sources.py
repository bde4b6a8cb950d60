"""Readers, writers and the event worker."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from platehouse.operators import policy
from platehouse.sources import files
from platehouse.streaming import tracks, worker

EVENT = {
    "_id": "evt_a7", "schemaVersion": 1, "camera": {"id": "north-3", "name": "North", "zone": "N"}, "trackId": "north-3:s:4", "vehicleId": "veh-9", "eventType": "VEHICLE_EXIT", "direction": "EXIT", "status": "NEEDS_REVIEW",
    "plate": {"raw": "43C06172", "normalized": "43C-061.72", "confidence": 0.81, "observationCount": 6, "partial": False}, "vehicle": {"type": "truck", "confidence": 0.64, "color": None}, "occurredAt": "2023-03-04T05:06:07Z", "createdAt": "2023-03-04T05:06:09Z", "metadata": "{}",
}


def test_event_log(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text(json.dumps(EVENT) + "\n\n" + json.dumps(EVENT | {"_id": "evt_b8", "plate": {"prediction": {"normalized": "X"}, "review": {"normalized": "Y", "revision": 1}}}) + "\n")
    rows = {r["id"]: r for r in files.flatten_events(files.read_event_log(spark, str(path))).collect()}
    assert rows["evt_a7"]["plate"] == "43C-061.72" and rows["evt_b8"]["plate"] == "X" and rows["evt_b8"]["plate_final"] == "Y"
    path.write_text("{broken\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        files.read_event_log(spark, str(path)).collect()


def _messages(spark, tmp_path, events):
    path = tmp_path / "e.jsonl"
    path.write_text("\n".join(json.dumps(e) for e in events))
    return files.encode_envelope(files.read_event_log(spark, str(path)))


def test_envelope(spark, tmp_path):
    good = _messages(spark, tmp_path, [EVENT])
    bad = good.withColumn("value", F.regexp_replace("value", '"source":"camera/north-3"', '"source":"camera/other"')).union(spark.createDataFrame([("nonsense",)], "value string"))
    assert [r["reject_reason"] for r in files.decode_envelope(good.union(bad)).select("reject_reason").collect()] == [None, "SOURCE_MISMATCH", "INVALID_JSON"]


def test_worker(spark, tmp_path):
    inbox, n = tmp_path / "in", [0]
    folders = {f: str(tmp_path / f) for f in ("store", "rejects", "alerts", "identities")}
    rules = (policy.Rule("r", "exits", 1, (policy.Condition("direction", "EQ", "EXIT"),)),)

    def send(events):
        n[0] += 1
        (tmp_path / f"w{n[0]}").mkdir()
        _messages(spark, tmp_path / f"w{n[0]}", events).coalesce(1).write.mode("append").text(str(inbox))

    def run():
        stream = spark.readStream.schema("value string").text(str(inbox))
        worker.start(stream, folders["store"], folders["rejects"], str(tmp_path / "cp"), alerts=folders["alerts"], rules=rules, identities=folders["identities"]).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(folders["store"]).collect())

    def written(folder):
        return sorted(r["id"] for r in spark.read.parquet(folders[folder]).collect())

    late, early = EVENT | {"_id": "evt_m"}, EVENT | {"_id": "evt_z", "occurredAt": "2023-03-04T05:06:06Z"}
    send([EVENT, EVENT, late, early])
    assert run() == ["evt_z"]  # the earliest of one camera, track and type
    chain = [EVENT | {"_id": "evt_c", "trackId": "north-3:s:5"}, EVENT | {"_id": "evt_c", "trackId": "north-3:s:6", "occurredAt": "2023-03-04T05:06:08Z"}, EVENT | {"_id": "evt_d", "trackId": "north-3:s:6", "occurredAt": "2023-03-04T05:06:09Z"}]
    send([*chain, early])
    assert run() == ["evt_c", "evt_d", "evt_z"]
    assert written("alerts") == written("identities") == ["evt_a7", "evt_c", "evt_d", "evt_m", "evt_z"]  # duplicates too, once


def test_worker_runs_duplicates_through_later_steps(spark, tmp_path):
    folders = {f: str(tmp_path / f) for f in ("store", "rejects", "alerts")}
    rules = (policy.Rule("r", "exits", 1, (policy.Condition("direction", "EQ", "EXIT"),)),)
    messages = _messages(spark, tmp_path, [EVENT])
    worker.process_batch(messages, 0, folders["store"], folders["rejects"])  # cut short before the rules
    for number in (1, 2):
        worker.process_batch(messages, number, folders["store"], folders["rejects"], alerts=folders["alerts"], rules=rules)
    assert spark.read.parquet(folders["store"]).count() == spark.read.parquet(folders["alerts"]).count() == 1


def test_messages_are_parsed_once(spark):
    messages = spark.createDataFrame([(json.dumps({"id": "evt_a7", "data": json.dumps(EVENT)}), 1), ("broken", 2)], "value string, `at.n` int")
    decoded = files.decode_envelope(messages)
    assert decoded.columns == ["value", "at.n", "event", "reject_reason"] and [r["reject_reason"] for r in decoded.orderBy("`at.n`").collect()] == ["TYPE_MISMATCH", "INVALID_JSON"]
    for found in (decoded.where("reject_reason IS NULL").select("event.*"), decoded.where("reject_reason IS NOT NULL").select("value")):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2  # an envelope and its event


def test_track_stream(spark, tmp_path):
    rows = [("c", 0, 0.0, "a"), ("c", 0, 1.0, "a"), ("c", 0, 3.5, None), ("c", 1, 4.0, "b"), ("c", 1, 5.0, None)]
    path = tmp_path / "ticks"
    spark.createDataFrame(rows, "camera_id string, epoch long, at double, track_id string").withColumn("crossed", F.lit(False)).withColumn("final", F.col("at") == 5.0).coalesce(1).write.parquet(str(path))
    stream = spark.readStream.schema("camera_id string, epoch long, at double, track_id string, crossed boolean, final boolean").parquet(str(path))
    q = tracks.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted((r["track_id"], r["last_seen"], r["observations"], r["cause"]) for r in spark.table("sessions").collect()) == [("a", 1.0, 2, "TIMEOUT"), ("b", 4.0, 1, "END")]


def test_track_stream_closes_by_crossing_and_epoch(spark, tmp_path):
    rows = [("c", 0, 0.0, "a", False), ("c", 0, 1.0, "a", True), ("c", 0, 2.0, "a", False), ("c", 0, 2.0, "b", False), ("c", 1, 2.5, "d", False), ("c", 0, 2.6, "b", False), ("c", 1, 3.0, None, False)]
    path = tmp_path / "ticks"
    schema = "camera_id string, epoch long, at double, track_id string, crossed boolean"
    spark.createDataFrame(rows, schema).withColumn("final", F.lit(False)).coalesce(1).write.parquet(str(path))
    stream = spark.readStream.schema(schema + ", final boolean").parquet(str(path))
    tracks.sessions(stream).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    # the crossed track's later sighting opens nothing; the new connection closes what the old one left open
    assert sorted((r["track_id"], r["last_seen"], r["observations"], r["cause"]) for r in spark.table("closed").collect()) == [("a", 1.0, 2, "CROSSING"), ("b", 2.6, 2, "EPOCH")]


def test_track_stream_holds_one_batch_of_a_camera(spark, tmp_path, monkeypatch):
    class State:
        exists = False

        def update(self, value):
            self.value = value

    read, ticks = [], [pd.DataFrame({"epoch": [0, 0], "at": [i * 2.0, i * 2.0 + 1], "track_id": [f"t{i}", None], "crossed": [True, None], "final": [False, None]}) for i in range(50)]
    monkeypatch.setattr(tracks, "FLUSH", 5)
    out = tracks._walk(("c",), (read.append(i) or b for i, b in enumerate(ticks)), State())
    assert len(next(out)) == 5 and len(read) < 8 and sum(len(x) for x in out) == 45  # rows are handed on before all are read
    rows = spark.range(4000).selectExpr("concat('c', id % 3) AS camera_id", "id div 900 AS epoch", "(id div 12) * 0.7D AS at", "CASE WHEN id % 7 > 0 THEN concat('t', id * 37 % 11) END AS track_id", "id % 53 = 0 AS crossed", "id % 1000 >= 990 AS final")
    rows.repartition(5).write.parquet(str(tmp_path / "ticks"))
    found = {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # ticks go on in the next batch
    try:
        for ordered in (True, False):
            stream, path = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ticks")), str(tmp_path / f"out-{ordered}")
            if ordered:
                tracks.start(stream, path, path + "-cp").awaitTermination()
            else:
                tracks.sessions(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-cp").trigger(availableNow=True).start().awaitTermination()
            found[ordered] = sorted(map(tuple, spark.read.schema(tracks.SESSIONS).parquet(path).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[True] == found[False] and {r[-1] for r in found[True]} == {"CROSSING", "TIMEOUT", "END", "EPOCH"}


def test_exports_that_differ_are_found(spark, tmp_path):
    samples = spark.createDataFrame([("a", "x", "train"), ("a", "x", "train")], "id string, label string, split string")
    manifest = files.export_labels(samples, str(tmp_path / "out"))
    other = files.export_labels(samples.withColumn("id", F.lit("b")).withColumn("label", F.lit("y")), str(tmp_path / "other"))
    check = lambda m: files.verify_export(spark, str(tmp_path / "out"), "id string, label string", m).count()
    assert check(manifest) == 0 and check(other) == 1


def test_coco_export_and_its_verifier(spark, tmp_path):
    rows = [("s1", "g1", "c1", "train", [("plate", [0.0, 1.0, 2.0, 3.0]), ("car", [1.0, 1.0, 1.0, 1.0])]), ("s2", "g2", "c1", "val", []), ("s3", "g1", "c2", "train", [("car", [0.0, 0.0, 5.0, 5.0])])]
    schema = "sample_id string, group_id string, camera_id string, split string, annotations array<struct<class_name:string,bbox:array<double>>>"
    classes, path = ["car", "plate"], str(tmp_path / "set")
    manifest = {r["split"]: (r["images"], r["annotations"], r["negatives"], r["group_count"]) for r in files.export_coco(spark.createDataFrame(rows, schema), classes, path).collect()}
    assert manifest == {"train": (2, 3, 0, 1), "val": (1, 0, 1, 1)} and files.verify_coco(spark, path, classes).count() == 0
    assert {r["problem"] for r in files.verify_coco(spark, path, ["plate", "car"]).collect()} == {"CATEGORIES"}
    with pytest.raises(Exception, match="already exists"):
        files.export_coco(spark.createDataFrame(rows, schema), classes, path)
    with pytest.raises(Exception, match="unknown class"):
        files.export_coco(spark.createDataFrame(rows, schema), ["car"], str(tmp_path / "bad"))
    images, boxes, _ = files.read_coco_export(spark, path)
    images.union(images.where("sample_id = 's1'").withColumn("split", F.lit("val"))).write.partitionBy("split").json(str(tmp_path / "i"))
    (tmp_path / "set" / "images").rename(tmp_path / "old")
    (tmp_path / "i").rename(tmp_path / "set" / "images")
    assert {r["problem"] for r in files.verify_coco(spark, path, classes).collect()} == {"CHECKSUM", "IMAGE_ID", "FILE_NAME", "LEAKAGE"}


def test_audit_log_is_only_added_to(spark, tmp_path):
    entry = lambda *ids: spark.createDataFrame([(i, "login") for i in ids], "id string, action string")
    path = str(tmp_path / "audit")
    files.append_audit(entry("a", "b"), path)
    files.append_audit(entry("c"), path)
    for wrong in (entry("b"), entry("d", "d")):
        with pytest.raises(ValueError, match="already exists"):
            files.append_audit(wrong, path)
    assert spark.read.json(path).count() == 3


def test_csv_boxes_and_inventory(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ImageID,LabelName,IsGroupOf,IsDepiction,IsInside\ni1,/m/1,0,0,0\ni2,/m/1,1,0,0\ni3,/m/9,0,0,0\n")
    boxes = files.read_csv(spark, str(tmp_path / "b.csv"), "ImageID string, LabelName string, IsGroupOf int, IsDepiction int, IsInside int")
    assert [(r["ImageID"], r["class_name"]) for r in files.usable_boxes(boxes, {"/m/1": "car"}).collect()] == [("i1", "car")]
    folder = tmp_path / "media"
    (folder / "deep").mkdir(parents=True)
    (folder / "one").write_bytes(b"x")
    (folder / "deep" / "two").write_bytes(b"x")
    found = files.inventory(spark, str(folder)).collect()
    assert len(found) == 2 and len({r["sha256"] for r in found}) == 1 and {r["length"] for r in found} == {1}


def test_yolo(spark):
    lines = ["0 0.1 0.1 0.5 0.1 0.5 0.5", "0 0.1 x", "7 0.1 0.1 0.5 0.1 0.5 0.5", "0 0.1 0.1 0.5 0.1", "0 0.1 0.1 2 0.1 0.5 0.5", "0 0.1 0.1 0.1 0.1 0.1 0.1", "0 -0.02 0.1 0.5 0.1 0.5 0.5", " "]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "source string, line int, value string")
    got = {r["line"]: (r["reject_reason"], r["adjusted"]) for r in files.parse_yolo_polygons(df, [0, 1], F.lit(100.0), F.lit(100.0)).collect()}
    assert [got[i][0] for i in range(7)] == [None, "NON_NUMERIC", "SCHEMA", "SCHEMA", "COORD_RANGE", "DEGENERATE", None] and got[6][1] and 7 not in got
    box = spark.createDataFrame([("f", 1, "2 0.5 0.5 0.2 0.4")], "source string, line int, value string")
    assert files.parse_yolo_boxes(box, F.lit(100.0), F.lit(10.0)).first()["bbox"] == pytest.approx([40.0, 3.0, 20.0, 4.0])


def test_coco_and_export(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"images": [{"id": 1, "file_name": "a", "width": 1, "height": 1}], "categories": [{"id": 1, "name": "p"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [0, 0, 1, 1]}, {"id": 2, "image_id": 9, "category_id": 1, "bbox": [0, 0, 1, 1]}, {"id": 3, "image_id": 1, "category_id": 1, "bbox": [0, 0, 0, 1]}]}))
    images, categories, annotations = files.read_coco(spark, str(path))
    assert {r["id"]: r["problem"] for r in files.broken_references(annotations, images, categories).collect()} == {2: "UNKNOWN_IMAGE", 3: "INVALID_BOX"}
    samples = spark.createDataFrame([("a", "x", "train"), ("b", "y", "test")], "id string, label string, split string")
    manifest = files.export_labels(samples, str(tmp_path / "out"))
    assert files.verify_export(spark, str(tmp_path / "out"), "id string, label string", manifest).count() == 0
    wrong = manifest.withColumn("samples", F.col("samples") + 1)
    assert files.verify_export(spark, str(tmp_path / "out"), "id string, label string", wrong).count() == 2
