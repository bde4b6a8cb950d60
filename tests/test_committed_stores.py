"""Outbox and COCO documents: what a commit shows, what a failed task leaves, and files that were cut or changed."""

import json

import pytest
from pyspark.sql import functions as F

from platehouse.sources import cocosink, files, outbox


def _stage(spark, path, numbers, parts=3):
    rows = spark.createDataFrame([(n, None if n % 5 == 0 else f"c{n % 2}", None if n == 7 else f"é\n{n}") for n in numbers], "n int, key string, payload string")
    outbox.stage(rows.repartition(parts), ["n"], path)


def _read(spark, path):
    return [tuple(r) for r in outbox.replay(spark, path).orderBy("sequence").collect()]


def _expected(numbers, first=0):
    return [(first + i, None if n % 5 == 0 else f"c{n % 2}", None if n == 7 else f"é\n{n}") for i, n in enumerate(numbers)]


def test_records_come_back_in_order(spark, tmp_path):
    path = str(tmp_path / "box")
    _stage(spark, path, range(40))
    _stage(spark, path, [])
    _stage(spark, path, range(100, 110))
    assert _read(spark, path) == _expected(range(40)) + _expected(range(100, 110), 40)
    assert _read(spark, str(tmp_path / "none")) == []


def test_a_failed_write_leaves_no_record(spark, tmp_path):
    path = str(tmp_path / "box")
    _stage(spark, path, range(5))
    bad = spark.range(0, 1000, 1, 4).select(F.col("id").alias("n"), F.lit("k").alias("key"), F.when(F.col("id") == 999, F.raise_error(F.lit("killed"))).otherwise("x").alias("payload"))
    with pytest.raises(Exception, match="killed"):
        bad.select("key", "payload").write.format("outbox").option("path", path).mode("append").save()
    assert _read(spark, path) == _expected(range(5))
    _stage(spark, path, range(5, 8))
    assert _read(spark, path) == _expected(range(8))


def _segments(path):
    commits = sorted((path / "commits").iterdir())
    return [(path / "segments" / s["name"], s) for c in commits for s in json.loads(c.read_text())["segments"]]


def test_a_torn_last_record_is_dropped_and_other_damage_is_an_error(spark, tmp_path):
    path = tmp_path / "box"
    _stage(spark, str(path), range(30))
    file, facts = _segments(path)[-1]
    whole = file.read_bytes()
    file.write_bytes(whole[:-9])
    assert _read(spark, str(path)) == _expected(range(29))
    lines = whole.splitlines(keepends=True)
    for damaged in (b"".join(lines[:-2]), b"".join(lines[:-1]) + b'["k","other","0"]\n', lines[0].replace(b"[", b"{", 1) + b"".join(lines[1:]), whole + lines[0], b""):
        file.write_bytes(damaged)
        with pytest.raises(Exception, match="CorruptOutbox"):
            _read(spark, str(path))
    file.write_bytes(whole)
    assert len(_read(spark, str(path))) == 30 and facts["rows"] == len(lines)


def test_streams_go_on_where_they_ended(spark, tmp_path):
    path, seen = str(tmp_path / "box"), []

    def run(fail=False):
        def deliver(batch, number):
            rows = sorted(tuple(r) for r in batch.collect())
            if fail:
                raise RuntimeError("no delivery")
            seen.append((number, [r[0] for r in rows]))

        query = spark.readStream.format("outbox").option("path", path).option("purge", "true").load().writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(deliver).start()
        query.awaitTermination()

    outbox.register(spark)
    _stage(spark, path, range(6))
    with pytest.raises(Exception, match="no delivery"):
        run(fail=True)
    run()
    _stage(spark, path, range(3))
    run()
    assert [n for n, _ in seen] == [0, 1] and [x for _, some in seen for x in some] == list(range(9))
    assert all(s >= 6 for s, *_ in _read(spark, path))  # what an earlier batch delivered is gone


ROWS = [("s1", "g1", "c1", "train", [("plate", [0.0, 1.0, 2.0, 3.0]), ("car", [1.0, 1.0, 1.0, 1.0])]), ("s2", "g2", "c1", "val", []), ("s3", None, "c\"2", "train", [("car", [0.0, 0.0, 5.0, 5.0])])]
SAMPLES = "sample_id string, group_id string, camera_id string, split string, annotations array<struct<class_name:string,bbox:array<double>>>"


def test_documents_are_one_a_split(spark, tmp_path):
    path = tmp_path / "set"
    cocosink.export(spark.createDataFrame(ROWS, SAMPLES), ["car", "plate"], str(path))
    assert sorted(p.name for p in path.rglob("*") if p.is_file()) == ["manifest.json", "train.json", "val.json"] and [p.name for p in tmp_path.iterdir()] == ["set"]
    train = json.loads((path / "annotations" / "train.json").read_text())
    assert train["categories"] == [{"id": 1, "name": "car"}, {"id": 2, "name": "plate"}]
    of = {i["id"]: i["sample_id"] for i in train["images"]}
    assert sorted(of.values()) == ["s1", "s3"] and sorted((of[a["image_id"]], a["category_id"], a["area"]) for a in train["annotations"]) == [("s1", 1, 1.0), ("s1", 2, 6.0), ("s3", 1, 25.0)]
    assert len({a["id"] for a in train["annotations"]}) == 3
    assert json.loads((path / "annotations" / "val.json").read_text())["annotations"] == []
    assert {(r["split"], r["images"], r["annotations"]) for r in cocosink.manifest(spark, str(path)).collect()} == {("train", 2, 3), ("val", 1, 0)}
    assert cocosink.verify(spark, str(path)).count() == 0 and files.read_coco(spark, str(path / "annotations" / "val.json"))[0].count() == 1
    (path / "annotations" / "val.json").write_text("{}")
    (path / "annotations" / "train.json").rename(path / "annotations" / "odd.json")
    assert {tuple(r) for r in cocosink.verify(spark, str(path)).collect()} == {("val", "CHECKSUM"), ("train", "MISSING"), ("odd", "UNKNOWN")}


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    samples = spark.createDataFrame(ROWS, SAMPLES)
    with pytest.raises(Exception, match="unknown class"):
        cocosink.export(samples, ["car"], str(tmp_path / "bad"))
    with pytest.raises(Exception, match="slash"):
        cocosink.export(samples.withColumn("split", F.lit("a/b")), ["car", "plate"], str(tmp_path / "bad"))
    late = spark.range(0, 50_000, 1, 1).select(F.lit("train").alias("split"), F.lit(0).alias("kind"), F.when(F.col("id") == 49_999, F.raise_error(F.lit("killed"))).otherwise("{}").alias("body"))
    with pytest.raises(Exception, match="killed"):
        late.write.format("coco").option("path", str(tmp_path / "bad")).option("classes", "[]").mode("append").save()
    assert list(tmp_path.iterdir()) == []
    cocosink.export(samples, ["car", "plate"], str(tmp_path / "set"))
    with pytest.raises(Exception, match="already exists"):
        cocosink.export(samples, ["car", "plate"], str(tmp_path / "set"))
    assert [p.name for p in tmp_path.iterdir()] == ["set"] and cocosink.verify(spark, str(tmp_path / "set")).count() == 0
    cocosink.export(samples.limit(0), ["car"], str(tmp_path / "empty"))
    assert cocosink.manifest(spark, str(tmp_path / "empty")).count() == 0
