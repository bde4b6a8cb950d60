"""Work that must grow with the input alone: what is shuffled, and results where rows are many or alike."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platehouse.functions import grouping
from platehouse.operators import annotations, evaluation, reid, topology
from platehouse.sources import files


def shuffled(spark, df):
    """(rows of df, records shuffled while it was made, bytes shuffled)."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return np.array([[stages.apply(i).shuffleWriteRecords(), stages.apply(i).shuffleWriteBytes()] for i in range(stages.size())]).sum(axis=0)

    before = total()
    rows = df().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return rows, *(int(x) for x in total() - before)


@pytest.fixture
def no_small_tables(spark):
    """Joins shuffle, as those of large tables do."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_carry_no_vectors(spark, no_small_tables):
    vectors = spark.range(20).select("id", F.lit("m").alias("model"), F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.sin(F.col("id") * 7 + i)).alias("values"))
    prints = spark.range(400).select(F.col("id").cast("string").alias("id"), F.lit("43C06172").alias("plate"), F.lit("car").alias("vehicle_type"), F.lit("red").alias("color"), (F.col("id") % 21).alias("embedding_id"))
    pairs = spark.range(8000).select((F.col("id") % 400).cast("string").alias("source_id"), (F.col("id") * 13 % 397).cast("string").alias("candidate_id"), F.lit(0.5).alias("time_score"))
    rows, _, size = shuffled(spark, lambda: reid.score_pairs(pairs, prints, vectors))
    values = {r["id"]: np.array(r["values"]) for r in vectors.collect()}
    assert len(rows) == 8000 and size < 4_000_000
    for r in rows[::37]:
        a, b = (values.get(int(r[c]) % 21) for c in ("source_id", "candidate_id"))
        expect = None if a is None or b is None else max(0.0, min(1.0, float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))))
        assert r["embedding_score"] is None if expect is None else abs(r["embedding_score"] - expect) < 1e-12


def test_seeks_are_not_shuffled(spark):
    videos = spark.range(300).select(F.col("id").alias("video_id"), (F.lit(10.0) + F.col("id") % 20).alias("fps"), (F.col("id") % 50 * 7).alias("frame_count"))
    rows, records, _ = shuffled(spark, lambda: annotations.seek_samples(videos.union(videos.where("video_id = 9")), 0.06))
    assert len(rows) > 20_000 and records < 3_000
    assert len({(r["video_id"], r["frame_index"]) for r in rows}) == len(rows)
    two = spark.createDataFrame([(1, 10.0, 12), (1, 20.0, 12), (None, 4.0, 2), (None, 8.0, 2)], "video_id long, fps double, frame_count long")
    got = {(r["video_id"], r["frame_index"]): round(r["offset_seconds"], 6) for r in annotations.seek_samples(two, 0.25).collect()}
    assert got == {(1, 0): 0.0, (1, 3): 0.25, (1, 5): 0.25, (1, 8): 0.75, (1, 10): 0.5, (None, 0): 0.0, (None, 1): 0.25}


def test_nearest_with_many_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(reid, "TILE", 64)
    monkeypatch.setattr(reid, "MOST_FOUND", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 6)).round(2)
    vectors = [[float(x) for x in base[i % 12]] if i % 11 else [0.0] * 6 for i in range(240)]
    vectors[17], vectors[18], vectors[19] = None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]
    df = spark.createDataFrame([(i, f"m{i % 2}" if i % 31 else None, v) for i, v in enumerate(vectors)], "id long, model string, values array<double>")
    rows, records, _ = shuffled(spark, lambda: reid.nearest(df.where("id % 3 = 0"), df, 0.1, 5))

    def cosine(a, b):
        dot = lambda x, y: float(np.add.accumulate(np.multiply(x, y))[-1])
        size = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
        return None if size == 0 else max(-1.0, min(1.0, dot(a, b) / size))

    good = [i for i, v in enumerate(vectors) if v is not None and None not in v and i % 31]
    expect = {}
    for q in good:
        if q % 3 == 0:
            near = [(cosine(vectors[q], vectors[i]), i) for i in good if i != q and i % 2 == q % 2 and len(vectors[i]) == len(vectors[q])]
            for place, (score, i) in enumerate(sorted((x for x in near if x[0] is not None and x[0] >= 0.1), reverse=True)[:5]):
                expect[q, place] = (i, score)
    assert {(r["query_id"], r["place"]): (r["id"], r["score"]) for r in rows} == expect and len(rows) == len(expect)


def test_parts_of_one_file_have_one_digest(spark, tmp_path):
    lines = spark.range(500).select((F.col("id") % 2).alias("side"), "id", F.format_string("%05d %s", "id", F.repeat(F.lit("x"), 2000)).alias("value"))
    path = str(tmp_path / "odd %41 name")
    lines.repartitionByRange(7, "side", "id").sortWithinPartitions("side", "id").select("side", "value").write.partitionBy("side").text(path)
    found = files.inventory(spark, path, F.regexp_extract("path", "side=([^/]+)/", 1)).collect()
    expect = {str(side): "".join(f"{i:05} {'x' * 2000}\n" for i in range(500) if i % 2 == side).encode() for side in (0, 1)}
    assert {r["path"]: (r["length"], r["sha256"]) for r in found} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in expect.items()}
    assert sum(r["length"] for r in files.inventory(spark, path).collect()) == sum(map(len, expect.values()))


@pytest.mark.parametrize(("batch", "pairs"), [(10_000, 2_000_000), (5, 30)])
def test_association_and_suppression_are_plain_walks(spark, monkeypatch, batch, pairs):
    monkeypatch.setattr(evaluation, "MOST_PAIRS", pairs)
    monkeypatch.setattr(evaluation, "map_groups", None, raising=False)  # no row goes through lists
    rng = random.Random(8)
    box = lambda: [float(rng.randrange(9)), float(rng.randrange(9)), float(rng.randrange(0, 9)), 6.0]
    frame = lambda: rng.choice([1] * 8 + list(range(2, 25)) + [None])
    tracks, found = ([(frame(), start + i, box()) for i in range(150)] for start in (0, 500))
    iou = lambda a, b: float(evaluation._ious(np.array(a), np.array([b]))[0])
    used, expected = set(), {}
    for f, t, b in tracks:
        best = max(((iou(b, d[2]), -d[1]) for d in found if d[0] == f and d[1] not in used and iou(b, d[2]) > 0), default=(0, None))[1]
        expected[t] = best and -best
        used.add(expected[t])
    scored = [(i, f, rng.choice("ab"), [b[0], b[1], b[0] + b[2], b[1] + b[3]], rng.choice([0.1, 0.5, 0.9])) for f, i, b in found]
    kept = {}
    for every in (False, True):
        kept[every] = []
        for row in sorted(scored, key=lambda r: (-r[4], r[0])):
            size = lambda c: [c[0], c[1], c[2] - c[0], c[3] - c[1]]
            if not any(k[1] == row[1] and (every or k[2] == row[2]) and iou(size(k[3]), size(row[3])) > 0.4 for k in kept[every]):
                kept[every].append(row)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        t = spark.createDataFrame(tracks, "frame_id long, track_id long, bbox array<double>").repartition(3)
        d = spark.createDataFrame(found, "frame_id long, detection_id long, bbox array<double>").repartition(3)
        assert {r["track_id"]: r["detection_id"] for r in evaluation.associate(t, d).collect()} == expected
        b = spark.createDataFrame(scored, "id long, image_id long, category_id string, bbox array<double>, score double").repartition(3)
        for every in (False, True):
            assert sorted(tuple(r) for r in evaluation.suppress(b, 0.4, every).collect()) == sorted(kept[every])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_average_precision_by_ranges_of_few_predictions(spark, monkeypatch):
    rows = [(i, i % 40, i % 3, [float(i % 7 * 10), float(i % 5 * 10), 9.0 + i % 2, 9.0], (i * 37 % 101) / 101) for i in range(400)]
    p = spark.createDataFrame(rows, "id long, image_id long, category_id long, bbox array<double>, score double")
    t = p.where("category_id < 2 AND id % 4 <> 1").drop("score")
    found = lambda: {(r["threshold"], r["category_id"]): round(r["average_precision"], 9) for r in evaluation.average_precision(t, p, (0.5, 0.95)).collect()}
    whole, parts = found(), []
    monkeypatch.setattr(evaluation, "RANGE", 9)
    monkeypatch.setattr(evaluation, "parts_for", lambda *a: parts.append(grouping.parts_for(*a)) or parts[-1])
    assert found() == whole and parts == [45] and {c for _, c in whole} == {0, 1} and all(0 < x < 1 for x in whole.values())


def test_candidates_are_dealt_into_parts_by_their_number(spark, monkeypatch):
    prints = spark.range(3000).selectExpr("CAST(id AS STRING) AS id", "concat('v', id % 5) AS vehicle_id", "concat('c', id % 2) AS camera_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS observed_at")
    edges = spark.createDataFrame([("a", "c0", "c1", 1.0, 30.0, 60.0, True), ("b", "c1", "c0", 1.0, 5.0, 90.0, True)], "id string, from_camera_id string, to_camera_id string, minimum_travel_seconds double, typical_travel_seconds double, maximum_travel_seconds double, enabled boolean")
    found = lambda: sorted(tuple(r) for r in topology.candidates(prints, edges, per_source=7).collect())
    whole, parts = found(), []
    monkeypatch.setattr(topology, "parts_for", lambda session, rows: parts.append(grouping.parts_for(session, rows, 1000)) or parts[-1])
    assert found() == whole and parts == [9, 21] and len(whole) > 20_000
