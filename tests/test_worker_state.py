"""The worker on keyed state: what it knows of earlier batches, cameras that fail, and sessions without a shared folder."""

import json
import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from platehouse.operators import policy
from platehouse.sources import files
from platehouse.streaming import worker

RULES = (policy.Rule("r", "all", 1, (policy.Condition("direction", "EXISTS", True),)),)


def _event(key, camera, track, second):
    return {"_id": key, "schemaVersion": 1, "camera": {"id": camera}, "trackId": track, "eventType": "VEHICLE_EXIT", "direction": "EXIT", "status": "NO_PLATE", "vehicleId": f"v-{key}", "occurredAt": f"2024-02-03T04:05:{second:02d}Z"}


class _Worker:
    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options, self.n = spark, path, options, 0
        self.folders = {f: str(path / f) for f in ("store", "rejects", "alerts", "identities")}

    def send(self, *events, raw=()):
        self.n += 1
        inbox = str(self.path / "in")
        if events:
            lines = self.path / f"e{self.n}"
            lines.write_text("\n".join(json.dumps(e) for e in events))
            files.encode_envelope(files.read_event_log(self.spark, str(lines))).repartition(3).write.mode("append").text(inbox)
        if raw:
            self.spark.createDataFrame([(r,) for r in raw], "value string").write.mode("append").text(inbox)
        stream = self.spark.readStream.schema("value string").text(inbox)
        query = worker.start(stream, self.folders["store"], self.folders["rejects"], str(self.path / "cp"), alerts=self.folders["alerts"], identities=self.folders["identities"], rules=RULES, **self.options)
        query.awaitTermination()
        return query

    def ids(self, folder):
        return sorted(r["id"] for r in self.spark.read.parquet(self.folders[folder]).collect())


def test_batches_know_earlier_ones_by_state_alone(spark, tmp_path):
    w = _Worker(spark, tmp_path)
    w.send(_event("b", "c1", "t1", 5), _event("a", "c1", "t1", 9), _event("x", "c2", "t1", 1))
    assert w.ids("store") == ["b", "x"] and w.ids("alerts") == w.ids("identities") == ["a", "b", "x"]
    for folder in ("store", "alerts", "identities"):
        shutil.rmtree(w.folders[folder])
    query = w.send(_event("b", "c1", "t1", 5), _event("late", "c1", "t1", 1), _event("x", "c9", "t9", 2), _event("y", "c9", "t9", 3), raw=("broken", "broken"))
    # an id that comes again claims no track, so y is the first of its own
    assert w.ids("store") == ["y"] and w.ids("alerts") == ["late", "y"]
    assert spark.read.parquet(w.folders["rejects"]).count() == 2
    seen = [p["observedMetrics"]["worker"] for p in query.recentProgress if p["observedMetrics"]]
    assert sum(m["messages"] for m in seen) == 6


def test_a_camera_that_fails_stops_no_other(spark, tmp_path):
    w = _Worker(spark, tmp_path, attempt=F.when((F.col("id") == "bad") & ~F.lit(os.path.exists(tmp_path / "mended")), "POLICY"), waiting=str(tmp_path / "waiting"), idle_seconds=0.0)
    w.send(_event("one", "c1", "t1", 1), _event("bad", "c1", "t2", 2), _event("behind", "c1", "t3", 3), _event("other", "c2", "t1", 4))
    assert w.ids("store") == ["bad", "behind", "one", "other"] and w.ids("alerts") == ["one", "other"]
    w.send(_event("later", "c1", "t4", 5))  # tried again, and fails again; the new group goes on
    assert w.ids("alerts") == ["later", "one", "other"]
    w.options["attempt"] = F.lit(None).cast("string")
    w.send(_event("last", "c3", "t1", 6))
    assert w.ids("alerts") == w.ids("identities") == ["bad", "behind", "last", "later", "one", "other"]
    w.send(_event("end", "c3", "t2", 7))
    assert w.ids("alerts").count("bad") == 1


def test_rows_that_wait_are_left_until_idle(spark, tmp_path):
    w = _Worker(spark, tmp_path, attempt=F.when(F.col("id") == "bad", "POLICY"), waiting=str(tmp_path / "waiting"), idle_seconds=3600.0)
    w.send(_event("bad", "c1", "t1", 1))
    first = spark.read.parquet(str(tmp_path / "waiting" / "batch=0")).first()
    w.send(_event("new", "c1", "t2", 2))
    second = spark.read.parquet(str(tmp_path / "waiting" / "batch=1")).collect()
    assert w.ids("alerts") == ["new"] and [(r["id"], r["since"], r["reason"]) for r in second] == [("bad", first["since"], "POLICY")]


def test_stages_in_a_session_that_names_no_folder(tmp_path):
    code = """
from pyspark.sql import SparkSession
from platehouse.operators.events import insert_if_absent
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 2, 3)], "id string, track int, n int")
print(sorted(r["n"] for r in insert_if_absent(rows.limit(0), rows, "id", ["track"], ["n"]).collect()))
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env=env, check=False)
    assert done.stdout.strip() == "[1, 3]", done.stderr[-2000:]
