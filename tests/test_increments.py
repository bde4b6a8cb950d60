"""Percentiles, tracker output, bounded histories, partial states, digests, rewritten logs, reviews and merges on small tables."""

import datetime as dt
import json
import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from platehouse.operators import annotations, datasets, evaluation, histories, identity, quality, stats, tracking
from platehouse.sources import eventlog, files

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("sketch", [1000, 4])
def test_percentiles_are_exact(spark, monkeypatch, sketch):
    monkeypatch.setattr(stats, "SKETCH", sketch)
    rng = random.Random(1)
    rows = [("hot", float(rng.randrange(40))) for _ in range(3000)] + [("few", 2.5), ("two", 1.0), ("two", 4.0), ("none", None), (None, 7.0), (None, 8.0)] + [("wide", rng.gauss(0, 1e6)) for _ in range(500)] + [("same", 3.0)] * 200 + [("hot", None)] * 5
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    values = {k: sorted(v for key, v in rows if key == k and v is not None) for k in {k for k, _ in rows}}
    got = {r["k"]: r for r in stats.percentiles(df, "v", shares, ["k"]).collect()}
    near = {r["k"]: r for r in stats.percentiles(df, "v", shares, ["k"], nearest=True).collect()}
    assert got.keys() == near.keys() == values.keys()
    for k, found in values.items():
        for name, share in shares.items():
            if not found:
                assert got[k][name] is None and near[k][name] is None
                continue
            assert got[k][name] == pytest.approx(np.percentile(found, 100 * share), rel=1e-12)
            assert near[k][name] == found[max(1, -int(-share * len(found) // 1)) - 1]
    whole = stats.latency_summary(df, "v").first()
    everything = sorted(v for _, v in rows if v is not None)
    assert whole["count"] == len(everything) and whole["p95"] == pytest.approx(np.percentile(everything, 95), abs=5e-4)
    assert stats.latency_summary(df.limit(0), "v").first()["count"] == 0 and stats.latency_summary(df.limit(0), "v", ["k"]).count() == 0
    assert {r["k"] for r in stats.latency_summary(df, "v", ["k"]).collect()} == values.keys()


def test_tracks_take_the_nearest_centre(spark):
    rng = random.Random(2)
    box = lambda: [float(rng.randrange(-900, 900)), float(rng.randrange(-900, 900)), float(rng.randrange(1, 30)), 4.0]
    found = [(f, i, box()) for f in (1, 2) for i in range(80)] + [(3, 0, [9000.0, 9000.0, 1.0, 1.0]), (3, 1, [9000.0, 9000.0, 1.0, 1.0])]
    boxes = [(rng.choice([1, 2, 3, 4]), 100 + i, rng.choice([None, None, 0, 1, 79, 80, -1]), box()) for i in range(120)]
    centre = lambda b: (b[0] + b[2] / 2, b[1] + b[3] / 2)
    expected = {}
    for frame, track, index, b in boxes:
        there = {i: centre(d) for f, i, d in found if f == frame}
        x, y = centre(b)
        near = min(there, key=lambda i: ((there[i][0] - x) ** 2 + (there[i][1] - y) ** 2, i), default=None)
        expected[track] = (index, "INDEX") if index in there else (near, None if near is None else "NEAREST")
    t = spark.createDataFrame(boxes, "frame_id long, track_id long, index long, bbox array<double>").repartition(3)
    d = spark.createDataFrame(found, "frame_id long, detection_index long, bbox array<double>").repartition(3)
    assert {r["track_id"]: (r["detection_index"], r["by"]) for r in tracking.resolve(t, d).collect()} == expected
    assert {r["by"] for r in tracking.resolve(t, d.limit(0)).collect()} == {None} and tracking.resolve(t.limit(0), d).count() == 0
    assert {r["track_id"]: (r["detection_index"], r["by"]) for r in tracking.resolve(t, d, crowd=10).collect()} == expected  # by grids


def test_tracks_of_small_frames_are_written_once(spark, monkeypatch):
    written, staged = [], tracking.staged
    monkeypatch.setattr(tracking, "staged", lambda df, label: written.append(label) or staged(df, label))
    nan, box = float("nan"), lambda x: [x, 0.0, 2.0, 2.0]
    t = spark.createDataFrame([(1, 1, None, box(500.0)), (1, 2, 0, box(0.0)), (1, 3, None, None), (2, 4, 0, box(nan)), (2, 5, 9, box(1.0)), (None, 6, None, box(0.0))], "frame_id long, track_id long, index long, bbox array<double>")
    d = spark.createDataFrame([(1, 0, box(0.0)), (1, 1, box(0.0)), (2, 0, box(nan)), (2, 1, None)], "frame_id long, detection_index long, bbox array<double>")
    expected = {1: (0, "NEAREST"), 2: (0, "INDEX"), 3: (None, None), 4: (0, "INDEX"), 5: (None, None), 6: (None, None)}
    got = lambda **k: {r["track_id"]: (r["detection_index"], r["by"]) for r in tracking.resolve(t, d, **k).collect()}
    assert got() == expected and written == ["tracks"]  # a far track starts no further round
    assert got(crowd=1) == expected


@pytest.mark.parametrize("most", [0, 1, 5])
def test_admissions_and_buffers(spark, most):
    rng = random.Random(3)
    rows = [("h", START + dt.timedelta(seconds=i // 3), i, f"k{rng.randrange(9)}") for i in range(600)] + [("other", START, i, "x") for i in range(3)]
    df = spark.createDataFrame(rows, "hub string, at timestamp_ntz, seq long, id string").repartition(5)
    held, expected = {}, {}
    for hub, _, seq, key in rows:
        order = held.setdefault(hub, [])
        expected[hub, seq] = key not in order
        if key not in order and most:
            order.append(key)
            held[hub] = order[-most:]
    assert {(r["hub"], r["seq"]): r["admitted"] for r in histories.admissions(df, most).collect()} == expected
    if not most:
        return
    buffers, expected = OrderedDict(), {}
    for hub, _, seq, camera in rows[:600]:
        evicted, gone = None, 0
        if camera in buffers:
            buffers.move_to_end(camera)
            if len(buffers[camera]) == 2:
                evicted, gone = camera, 1
        else:
            if len(buffers) >= most:
                evicted, frames = buffers.popitem(last=False)
                gone = len(frames)
            buffers[camera] = []
        buffers[camera] = [*buffers[camera], seq][-2:]
        expected[seq] = (evicted, gone, len(buffers))
    frames = df.where("hub = 'h'").withColumnsRenamed({"hub": "monitor", "id": "camera_id"})
    assert {r["seq"]: (r["evicted_camera"], r["evicted_frames"], r["cameras"]) for r in histories.live_buffers(frames, most, 2).collect()} == expected


def test_increments_equal_one_run(spark, tmp_path):
    rng = random.Random(4)
    rows = [(START + dt.timedelta(hours=rng.randrange(90)), rng.choice("ab"), "m", rng.choice(["1", None]), rng.choice(["P", None]), rng.choice(["CONFIRMED", "NO_PLATE"]), rng.random() < 0.5, rng.random() < 0.2, rng.choice([None, rng.random()])) for _ in range(300)]
    df = spark.createDataFrame(rows, "occurred_at timestamp_ntz, camera_id string, model_name string, model_version string, plate string, status string, reviewed boolean, corrected boolean, plate_confidence double")
    split = df.withColumn("_i", F.pmod(F.xxhash64(*df.columns), F.lit(4)).cast("int"))
    for i in (0, 1, 2, 3, 2):
        quality.add_increment(split.where(F.col("_i") == i).drop("_i"), str(tmp_path / "s"), i)
    for by in ([], ["day"], ["camera_id", "model_version"]):
        one, parts = (sorted(map(str, quality.merged(s, by, 299).collect())) for s in (quality.partials(df), quality.read_states(spark, str(tmp_path / "s"))))
        assert one == parts and all("truncated=True" in r for r in one)
    whole = quality.merged(quality.partials(df), [], 300).first()
    assert whole["events"] == 300 and not whole["truncated"] and whole["average_confidence"] == pytest.approx(np.mean([r[-1] for r in rows if r[-1] is not None]), abs=1e-8)


def test_digests_hold_order_and_every_column(spark, tmp_path):
    lines = [(1, "a"), (2, "b"), (3, None)]
    digest = lambda rows: tuple(files.ordered_digest(spark.createDataFrame(rows, "line int, value string")).first())
    assert digest(lines) == digest(lines[::-1]) and len({digest(lines), digest([(1, "b"), (2, "a"), (3, None)]), digest(lines[:2])}) == 3
    samples = spark.createDataFrame([("a", "x", 1, "train")], "id string, label string, size int, split string")
    manifest = files.export_labels(samples, str(tmp_path / "one"))
    files.export_labels(samples.withColumn("size", F.lit(2)), str(tmp_path / "two"))
    check = lambda p: files.verify_export(spark, str(tmp_path / p), "size INT, id STRING, label STRING", manifest).count()
    assert check("one") == 0 and check("two") == 1


def _document(key, status, revision=None):
    review = {"normalized": "P", "revision": revision} if revision else None
    return {"_id": key, "status": status, "plate": {"raw": "r", "review": review}, "camera": {"id": "c"}, "occurredAt": "2024-01-01T00:00:00Z"}


def test_updates_write_their_own_events_alone(spark, tmp_path):
    path = tmp_path / "log"

    def documents(*some):
        (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, some)))
        return files.read_event_log(spark, str(tmp_path / "d.jsonl"))

    now = lambda: sorted((r["_id"], r["status"]) for r in eventlog.read(spark, str(path)).collect())
    assert now() == []
    eventlog.add(documents(_document("a", "NEW"), _document("b", "NEW")), str(path))
    first = {f: f.stat().st_mtime_ns for f in path.rglob("*.json") if f.name != "log.json"}
    eventlog.add(documents(_document("b", "SECOND", 2), _document("c", "NEW")), str(path))
    eventlog.add(documents(_document("b", "FIRST", 1)), str(path))
    assert now() == [("a", "NEW"), ("b", "SECOND"), ("c", "NEW")]
    assert all(f.stat().st_mtime_ns == t for f, t in first.items()) and len(eventlog.parts(str(path))) == 3
    gone = eventlog.compact(spark, str(path))
    assert len(gone) == 3 and len(eventlog.parts(str(path))) == 1 and now() == [("a", "NEW"), ("b", "SECOND"), ("c", "NEW")]
    (path / "part-lost").mkdir()  # a crash before the list names a part leaves it unread
    assert len(now()) == 3 and eventlog.compact(spark, str(path)) == []


def test_reviews_need_a_plate_and_the_revision(spark):
    events = spark.createDataFrame([("a", "P", None, None), ("b", None, None, None), ("c", "P", 3, "51H-123.45")], "id string, plate string, review_revision int, plate_final string")
    commands = [("a", 1, "51h 12345", 0), ("a", 2, "51H12345", 0), ("a", 3, "51H12346", 0), ("a", 4, "51H12346", 1), ("a", 5, "hello", 2), ("b", 1, "51H12345", 0), ("z", 1, "51H12345", 0), ("c", 1, "51H12345", 2), ("c", 2, "51H12345", 3), ("c", 3, None, 4)]
    got = datasets.review_commands(events, spark.createDataFrame(commands, "event_id string, seq long, text string, expected_revision int")).orderBy("event_id", "seq").collect()
    assert [(r["outcome"], r["revision"], r["plate_final"]) for r in got] == [
        ("CHANGED", 1, "51H-123.45"), ("UNCHANGED", 1, "51H-123.45"), ("CONFLICT", 1, "51H-123.45"), ("CHANGED", 2, "51H-123.46"), ("INVALID_PLATE", 2, "51H-123.46"), ("NO_PLATE", 0, None), ("UNCHANGED", 3, "51H-123.45"), ("CHANGED", 4, "51H-123.45"), ("INVALID_PLATE", 4, "51H-123.45"), ("NO_EVENT", None, None)]


def test_merges_hold_revisions_and_bounds(spark, monkeypatch):
    monkeypatch.setattr(identity, "MOST_REVIEWED", 3)
    counts = {"a": 1, "b": 2, "c": 1, "d": 4, "e": 1, "f": 0, "g": 1}
    prints = [(f"{v}{i}", v, f"P{v}", 0.5, START + dt.timedelta(seconds=i), "car", 0.9, "red") for v, n in counts.items() for i in range(n)]
    prints = spark.createDataFrame(prints, "id string, vehicle_id string, plate string, plate_confidence double, observed_at timestamp_ntz, vehicle_type string, vehicle_confidence double, color string")
    identities = spark.createDataFrame([(v, "MERGED" if v == "g" else "ACTIVE", 1) for v in counts], "vehicle_id string, status string, revision int")
    reviews = [("r1", "a", "b", 1, 1), ("r2", "b", "c", 1, 1), ("r3", "c", "d", 1, 1), ("r4", "e", "f", 1, 1), ("r5", "e", "g", 1, 1), ("r6", "e", "x", 1, 1), ("r7", "e", "c", 2, 1), ("r8", "e", "e", 1, 1)]
    outcomes, moved, now = identity.apply_merges(identities, prints, spark.createDataFrame(reviews, "review_id string, source string, target string, source_revision int, target_revision int"))
    assert {r["review_id"]: r["outcome"] for r in outcomes.collect()} == {"r1": "APPLIED", "r2": "REVISION", "r3": "TOO_LARGE", "r4": "NO_EVIDENCE", "r5": "NOT_ACTIVE", "r6": "NOT_FOUND", "r7": "REVISION", "r8": "NOT_FOUND"}
    assert moved.where("vehicle_id = 'b'").count() == 3 and moved.where("vehicle_id = 'a'").count() == 0
    state = {r["vehicle_id"]: (r["status"], r["revision"], r["observation_count"]) for r in now.collect()}
    assert state["a"] == ("MERGED", 2, None) and state["b"] == ("ACTIVE", 2, 3) and state["c"] == ("ACTIVE", 1, None) and state["g"] == ("MERGED", 1, None)


def test_full_coverage(spark):
    truths = spark.createDataFrame([(1, [0.0, 0.0, 10.0, 10.0]), (2, [0.0, 0.0, 10.0, 10.0]), (3, [0.0, 0.0, 0.0, 5.0]), (4, [0.0, 0.0, 1.0, 1.0])], "id long, bbox array<double>")
    predictions = spark.createDataFrame([(11, [0.0, 0.0, 10.0, 9.5]), (12, [0.0, 0.0, 10.0, 9.4]), (13, [0.0, 0.0, 10.0, 10.0])], "id long, bbox array<double>")
    matches = spark.createDataFrame([(11, 1), (12, 2), (13, 3), (14, None)], "prediction_id long, truth_id long")
    assert tuple(evaluation.full_coverage(matches, truths, predictions).first()) == (4, 1, 0.25)
    assert tuple(evaluation.full_coverage(matches, truths.limit(0), predictions).first())[:2] == (0, 0)


def test_consensus_takes_medians(spark):
    corners = lambda x: [[x, 0.0], [x + 10, 0.0], [x + 10, 6.0], [x, 6.0]]
    rows = [(1, i, "L", [x, 0.0, 10.0, 6.0], corners(x)) for i, x in enumerate([0.0, 0.1, 0.3, 50.0])]
    got = annotations.consensus(spark.createDataFrame(rows, "image_id long, id long, layout string, bbox array<double>, polygon array<array<double>>")).orderBy("id").collect()
    assert [(r["id"], r["votes"], r["bbox"][0]) for r in got] == [(0, 3, 0.1), (3, 1, 50.0)]
